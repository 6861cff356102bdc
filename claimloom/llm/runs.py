"""Periodic runs of words, from the end positions of a suffix automaton's states.

A run is a stretch with smallest period q and at least ``LEAST`` words and ``TIMES`` periods that no
neighbouring word extends. For each stretch of a text that can hold one:

1. A suffix automaton of its words is built; each state stands for the strings that end at
   the same positions, the longest of them of the state's length.
2. States are visited from the longest to the root. A state's end positions are an ordered set, which is merged
   into its suffix link's, the smaller into the larger one.
3. A position that enters a set meets its neighbours there. A distance d to a neighbour
   that does not exceed the state's length seeds a square: the longest string occurs at both
   positions, so the stretch from its first start to the later position has period d.
4. The longest common suffix of two positions is the length of the state where they first meet, so a seed
   reaches as far left as its period does; it is extended to its run where it reaches as far right, too.
   Of seeds with one stretch the smallest period counts.

With four periods or more each run is found so: positions one period apart, at its end, are
neighbours when they meet, since one between them would give the stretch a smaller period.
The number of seeds is bounded by that of insertions, n log n.

Which stretches: in a run every window of ``WINDOW`` words stands again one period on. Windows that do not stand
twice in a stretch of such windows cannot be in a run, and cut it; this is decided for all texts of a
slice at once on hashes of windows, where a collision only keeps a window that cannot matter.

Defined results: a null or empty text has no runs and collapses to an empty text; rows without doc_id
are left as they are written, whatever ``planted`` says of others; repeated rows give a row each; an empty
table gives no rows. Input columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import offsets_of, slices
from claimloom.llm.kernels import mixed, rows_of, window_hashes, word_bounds, word_hashes

#: A run has so many words and periods at least.
LEAST, TIMES = 6, 4
#: Words that stand again one period on in every run: its length less its period, at least.
WINDOW = 5
#: Positions that one list of an ordered set holds at most.
CHUNK = 1024

Run = tuple[int, int, int]  # start, length, period


class Ends:
    """An ordered set of positions in lists of bounded length."""

    __slots__ = ("lists", "size", "tops")

    def __init__(self, first: int | None = None):
        self.lists = [[first]] if first is not None else []
        self.tops = [first] if first is not None else []
        self.size = len(self.tops)

    def add(self, x: int) -> tuple[int, int]:
        """Insert a new position and return its neighbours; -1 where there is none."""
        self.size += 1
        if not self.lists:
            self.lists, self.tops = [[x]], [x]
            return -1, -1
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        held = self.lists[k]
        at = bisect_left(held, x)
        before = held[at - 1] if at else self.tops[k - 1] if k else -1
        after = held[at] if at < len(held) else -1
        held.insert(at, x)
        if at == len(held) - 1:
            self.tops[k] = x
        if len(held) > CHUNK:
            self.lists[k : k + 1] = [held[: CHUNK // 2], held[CHUNK // 2 :]]
            self.tops.insert(k, held[CHUNK // 2 - 1])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for held in self.lists:
            yield from held


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for a clone) of each state of the words' suffix automaton."""
    length, link, end = [0], [-1], [-1]
    steps: list[dict[int, int]] = [{}]
    last = 0
    for i, w in enumerate(words):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        steps.append({})
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = now
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                steps.append(steps[q].copy())
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return length, link, end


def runs_of_stretch(words: list[int]) -> list[Run]:
    """All runs of a list of words, by start, then period."""
    length, link, end = automaton(words)
    n, found = len(words), {}
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[state]
        if up <= 0:  # what meets at the root has nothing in common
            sets[state] = None
            continue
        small, large, sets[state] = sets[state], sets[up], None
        if large is None or small is None:
            sets[up] = large or small
            continue
        if small.size > large.size:
            small, large = large, small
        sets[up], common, last = large, length[up], -1
        for x in small:
            before, after = large.add(x)
            if before == last:  # of the smaller set itself: they have met before
                before = -1
            last = x
            for left, right in ((before, x), (x, after)):
                d = right - left
                # A square, and long enough: ``common`` words reach back from both positions.
                if left < 0 or right < 0 or d > common or common + d < max(LEAST, TIMES * d):
                    continue
                if right + 1 < n and words[right + 1] == words[right + 1 - d]:
                    continue  # a seed further right has the whole run
                key = (right - d - common + 1, right)
                if d < found.get(key, n):
                    found[key] = d
    return sorted((s, e - s + 1, d) for (s, e), d in found.items())


def stretches(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each stretch that can hold a run.

    ``words`` are hashes of all words of a slice, ``row`` says whose they are. A stretch starts as a row; windows
    of it that stand only once cut it, until no window does.
    """
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = window_hashes(words, WINDOW)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    part = row[at].astype(np.int64)
    while len(at):
        keys = mixed(windows[at] ^ mixed(part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        again = np.zeros(len(at), bool)
        same = ranked[1:] == ranked[:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        fewer = at[again]
        # Windows side by side of one former part stay one part.
        cuts = np.concatenate([[True], (np.diff(fewer) > 1) | (np.diff(part[again]) != 0)]) if len(fewer) else np.zeros(0, bool)
        settled = len(fewer) == len(at)
        at, part = fewer, np.cumsum(cuts) - 1
        if settled:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    tails = np.append(heads[1:], len(at)) - 1
    return at[heads], at[tails] + WINDOW


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """Words with a periodic tail, if ``h`` says so: word i >= a becomes word a + (i - a) % p."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that any run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts, out_runs, out_texts = part.column("text").cast(pa.binary()).to_pylist(), [], []
            # Space and the controls from tab to carriage return are what bytes split at.
            split = [repeated((t or b"").split(), h or 1) for t, h in zip(texts, part.column("h").to_pylist(), strict=True)]
            joined = [b" ".join(w) for w in split]
            held = _stretches_of(joined)
            for k, words in enumerate(split):
                runs: list[Run] = []
                for first, last in held.get(k, ()):
                    known: dict[bytes, int] = {}
                    runs += [(first + s, size, q) for s, size, q in runs_of_stretch([known.setdefault(w, len(known)) for w in words[first:last]])]
                out_runs.append([{"start": s, "length": size, "period": q} for s, size, q in sorted(runs, key=lambda r: (r[0], r[2]))])
                out_texts.append(b" ".join(collapsed(words, runs)).decode() if runs else joined[k].decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out_runs, kind), pa.array(out_texts, pa.string())], names=["doc_id", "runs", "collapsed"])


def _stretches_of(joined: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """For each row, the stretches of its words that can hold a run."""
    offsets, raw = offsets_of(pa.array(joined, pa.large_binary()))
    starts, ends, first = word_bounds(raw, offsets)
    row = rows_of(first)
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(starts):
        return out
    for a, b in zip(*(x.tolist() for x in stretches(word_hashes(raw, starts, ends), row)), strict=True):
        k = int(row[a])
        out.setdefault(k, []).append((a - int(first[k]), b - int(first[k])))
    return out


def find(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of each document.

    ``planted``: a tenth of the documents, by crc32 of doc_id, get a periodic tail first.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(_found, schema)


def greatest(runs: str = "runs"):
    """The run with the greatest exact length / period (ties: smallest start, then period); null without runs.

    Quotients are compared by cross-multiplication, so that no rounding decides.
    """
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    better = lambda a, x: a.isNull() | (ahead(x, a) > 0)  # noqa: E731  the runs come by start, then period
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))
