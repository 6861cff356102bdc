"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

The CGK walk reads a word string with a pointer: step ``j`` writes the word under the
pointer and moves on if a random bit of (word, j) says so. Strings a few edits apart
fall into step again, so edit distance becomes Hamming distance between the written
strings. An item of ``n`` words is walked in ``3 n`` steps, enough to reach its end, and so are
windows of ``n`` words of the documents; beyond the end a mark of its own is written, so
nothing outside an item or a window is read, and verbatim copies embed alike.

A repetition has its own random bits and samples ``SAMPLED`` of the written words; their
hash is the signature under which it keeps items of one length. ``REPEATS`` repetitions
reach ``RECALL`` at the most edits allowed: with a fifth of the words edited, walks agree in
0.56 to 0.77 of their steps at 5 to 60 words (simulated), so one repetition proposes an item with
0.31 or more and all of them miss with less than 1e-5, or 4e-3 if a walk agrees in 0.4 of its steps only.
Every proposal is aligned exactly: an item leaks where the edit distance in words to some
stretch of the document is at most ``MOST_EDITS`` of its length, rounded down.

Windows that cannot hold an item are not walked. An item with ``e`` edits allowed is cut in
``e + 1`` pieces of equal length, of one to four words, of which one stands unchanged in any
leak, so windows of ``n`` words are walked only where a piece of an item of ``n`` words stands at the
piece's own offset, up to ``SHIFTS`` words off for what is inserted or deleted before it, and only if
all but ``e`` of their words occur in items of that length. Before the alignment, proposals are
dropped where more than ``e`` of the item's words are nowhere within ``e`` words of
their own position, which an alignment through the unchanged piece rules out.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. Documents
are read once, against all blocks of ``ITEM_BLOCK`` items; nothing is shuffled.

Defined results: null or empty texts and items match nothing; repeated documents are
reported each; an item that leaks several times is reported once for a document, at its best and then
first place; an empty benchmark or table gives an empty result; columns other than
doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import offsets_of, slices
from claimloom.llm.kernels import mixed, ranges, rows_of, window_hashes, word_bounds, word_hashes

#: Steps of a walk for each word, words that a signature samples, repetitions, and the recall that they are to reach.
STEPS, SAMPLED, REPEATS, RECALL = 3, 2, 32, 0.99
#: Share of an item's words that may be edited.
MOST_EDITS = 0.2
#: Items that one scan looks for.
ITEM_BLOCK = 20_000
#: Words that one step of a walk or of the position test holds.
CELLS = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ROLL = np.uint64(0x9FB21C651E98DF25)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the first word of each row."""
    offsets, raw = offsets_of(column)
    starts, ends, first = word_bounds(raw, offsets, _WORD)
    return word_hashes(raw, starts, ends, lower=True), first


def signatures(windows: np.ndarray, repeat: int) -> np.ndarray:
    """Signature of each row, a window of words whose last one is 0 and stands for its end."""
    k, n = windows.shape[0], windows.shape[1] - 1
    rng = np.random.default_rng((77, repeat, n))
    steps = STEPS * n
    places = set(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist())
    flat, at = windows.ravel(), np.arange(k) * (n + 1)
    sign, bits = np.full(k, np.uint64(repeat + 1)), None
    for step in range(max(places) + 1):
        if step % 64 == 0:
            bits = mixed(windows ^ rng.integers(1, 2**63, dtype=np.uint64))
            bits[:, n] = 0
            bits = bits.ravel()
        if step in places:
            sign = (sign * _ROLL) ^ flat[at]
        at += ((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).view(np.int64)
    return mixed(sign)


def most_edits(n):
    """Edits allowed in an item of ``n`` words (a number or an array)."""
    return np.int64(MOST_EDITS * np.asarray(n))


class Items:
    """Index of a block of items: pieces to lengths and offsets, signatures to items, and words for the alignment."""

    def __init__(self, ids: list, texts: list[str | None]):
        words, first = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.flat, self.first = words, first
        sizes = np.diff(first)
        widths = sizes // (most_edits(sizes) + 1)
        self.pieces = {}
        for width in sorted(set(widths[sizes > 0].tolist())):
            of = np.flatnonzero((widths == width) & (sizes > 0))
            count = most_edits(sizes[of]) + 1
            items, offsets = np.repeat(of, count), ranges(np.zeros(len(of), np.int64), count) * width
            entries = np.unique(np.stack([window_hashes(words, width)[first[items] + offsets].view(np.int64), sizes[items], offsets]), axis=1)
            self.pieces[width] = self._table(entries[0].view(np.uint64), entries[1], entries[2])
        self.lengths = {}
        for n in np.unique(sizes[sizes > 0]).tolist():
            of = np.flatnonzero(sizes == n)
            own = self._windows(words, first[of], first[of + 1], n)
            self.lengths[n] = np.unique(own[:, :n]), [self._table(signatures(own, r), of, of) for r in range(REPEATS)]

    @staticmethod
    def _windows(words: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """``n`` words from each start, and 0 where a text ends and after them."""
        at = start[:, None] + np.arange(n + 1)
        inside = (at < end[:, None]) & (np.arange(n + 1) < n)
        return np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))

    @staticmethod
    def _table(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << 16, bool)
        seen[key >> np.uint64(48)] = True
        return key[order], a[order], b[order], seen

    @staticmethod
    def _hits(sign: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``sign`` and what ``table`` has under the same key."""
        key, items, offsets, seen = table
        at = np.flatnonzero(seen[sign >> np.uint64(48)])
        low, high = np.searchsorted(key, sign[at], "left"), np.searchsorted(key, sign[at], "right")
        times = high - low
        ends = np.cumsum(times)
        entry = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - times), times)
        return np.repeat(at, times), items[entry], offsets[entry]

    def _near(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether all but the allowed edits of an item's words stand near their own positions from ``start``, within ``low`` and ``high``."""
        sizes = np.diff(self.first)[item]
        out = np.zeros(len(item), bool)
        for n in np.unique(sizes):
            of, most = np.flatnonzero(sizes == n), int(most_edits(n))
            step = max(1, CELLS // int(n))
            for some in (of[at : at + step] for at in range(0, len(of), step)):
                own = self.flat[self.first[item[some], None] + np.arange(n)]
                stands = np.zeros(own.shape, bool)
                for shift in range(-most, most + 1):
                    at = start[some, None] + np.arange(n) + shift
                    stands |= (words[np.clip(at, 0, len(words) - 1)] == own) & (at >= low[some, None]) & (at < high[some, None])
                out[some] = stands.sum(1) >= n - most
        return out

    def _known(self, words: np.ndarray, first: np.ndarray, rows: np.ndarray, starts: np.ndarray, wide: int, before: int, vocabulary: np.ndarray) -> np.ndarray:
        """How many of the ``wide`` words from ``before`` words before each start, within its row, are in ``vocabulary``."""
        low = np.maximum(first[rows], starts - before)
        high = np.minimum(first[rows + 1], starts - before + wide)
        out = np.zeros(len(rows), np.int64)
        step = max(1, CELLS // wide)
        for k in range(0, len(rows), step):
            around = self._windows(words, low[k : k + step], high[k : k + step], wide)
            out[k : k + step] = (vocabulary[np.minimum(np.searchsorted(vocabulary, around), len(vocabulary) - 1)] == around).sum(1)
        return out

    def _places(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of items the rows and starts of the windows that can hold one."""
        row = rows_of(first)
        held = [np.stack([row[at], at - offset, n]) for at, n, offset in (self._hits(window_hashes(words, width), table) for width, table in self.pieces.items())]
        held = np.unique(np.concatenate(held, axis=1), axis=1)
        for n in np.unique(held[2]).tolist():
            rows, starts = held[:2, held[2] == n]
            most, vocabulary = int(most_edits(n)), self.lengths[n][0]
            # An edit before the piece moves it by a word, so an item may start as many words off as it has edits.
            around = self._known(words, first, rows, starts, n + 4 * most, 2 * most, vocabulary)
            rows, starts = rows[around >= n - most], starts[around >= n - most]
            shifts = np.arange(-most, most + 1)
            rows, starts = np.repeat(rows, len(shifts)), (starts[:, None] + shifts).ravel()
            starts = np.clip(starts, first[rows], first[rows + 1] - 1)
            rows, starts = np.unique(np.stack([rows, starts]), axis=1)
            have = self._known(words, first, rows, starts, n + 2 * most, most, vocabulary)
            rows, starts = rows[have >= n - most], starts[have >= n - most]
            if len(rows):
                yield n, rows, starts

    def leaks(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, first word, edits) for each item found in each text.

        Texts are read some at a time, and the windows that are left are walked together.
        """
        parts, windows, marks, base = [], {}, {}, 0
        for piece in slices(pa.RecordBatch.from_arrays([column], names=["text"])) if self.pieces else ():
            words, first = words_of(piece.column("text"))
            found = list(self._places(words, first)) if len(words) else []
            for n, rows, starts in found:
                windows.setdefault(n, []).append(self._windows(words, starts, first[rows + 1], n))
                marks.setdefault(n, []).append(np.stack([np.full(len(rows), len(parts)), rows, starts]))
            if found:
                parts.append((base, words, first))
            base += piece.num_rows
        proposed = []
        for n, some in windows.items():
            rows, at = np.concatenate(some), np.concatenate(marks[n], axis=1)
            step = max(1, CELLS // (n + 1))
            for k in range(0, len(rows), step):
                for repeat, table in enumerate(self.lengths[n][1]):
                    which, item, _ = self._hits(signatures(rows[k : k + step], repeat), table)
                    proposed.append(np.vstack([at[:, k + which], item]))
        if not proposed:
            return []
        place = np.unique(np.concatenate(proposed, axis=1), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for part in np.unique(place[0]).tolist():
            base, words, first = parts[part]
            rows, starts, items = place[1:, place[0] == part]
            near = self._near(words, first[rows], first[rows + 1], items, starts)
            for r, start, k in zip(rows[near].tolist(), starts[near].tolist(), items[near].tolist(), strict=True):
                n = len(self.words[k])
                most = int(most_edits(n))
                if best.get((base + r, k), (1, 0))[0] == 0:
                    continue
                low, high = max(int(first[r]), start - most), min(int(first[r + 1]), start + n + most)
                edits, where = aligned(self.words[k], words[low:high])
                if edits <= most:
                    got = (edits, low + where - int(first[r]))
                    if (base + r, k) not in best or got < best[base + r, k]:
                        best[base + r, k] = got
        return [(r, k, where, edits) for (r, k), (edits, where) in sorted(best.items())]


def aligned(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits that turn ``item`` into some run of words of ``stretch``, and where the run starts."""
    m = len(stretch)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), steps.copy()
    for word in item:
        # Costs and starts in one number: the smaller start wins among equal costs.
        packed = cost * (m + 2) + start
        new = packed + (m + 2)
        if m:
            np.minimum(new[1:], packed[:-1] + (stretch != word) * (m + 2), out=new[1:])
        new = np.minimum.accumulate(new - steps * (m + 2)) + steps * (m + 2)
        cost, start = new // (m + 2), new % (m + 2)
    at = int(np.argmin(cost))
    return int(cost[at]), int(start[at])


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Items, pa.DataType]]:
    """Indexes of the benchmark's items, ``ITEM_BLOCK`` at most or about as many in each."""
    blocks = max(1, -(-benchmark.count() // ITEM_BLOCK))
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        rows = rows.select("item_id", "text").where("text IS NOT NULL").distinct().toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()), rows.schema.field("item_id").type


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_edits and n_item_words for every leak of ``benchmark`` (item_id, text) in ``docs``."""
    kinds = dict(docs.dtypes), dict(benchmark.dtypes)
    schema = f"doc_id {kinds[0]['doc_id']}, item_id {kinds[1]['item_id']}, first_word long, n_edits int, n_item_words int"
    shared = [(docs.sparkSession.sparkContext.broadcast(items), kind) for items, kind in _blocks(benchmark)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, kind in ((s.value, k) for s, k in shared):
                got = items.leaks(batch.column("text"))
                if got:
                    r, k, where, edits = (list(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(r)), pa.array([items.ids[i] for i in k], kind), pa.array(where, pa.int64()), pa.array(edits, pa.int32()), pa.array([len(items.words[i]) for i in k], pa.int32())],
                        names=["doc_id", "item_id", "first_word", "n_edits", "n_item_words"],
                    )

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no item of ``benchmark`` leaks, with all columns; nothing is shuffled."""
    shared = [docs.sparkSession.sparkContext.broadcast(items) for items, _ in _blocks(benchmark)]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for items in (s.value for s in shared):
                stay[[r for r, *_ in items.leaks(batch.column("text"))]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(kept, docs.schema)
