"""Exact Jaccard join of word-shingle sets by index lists with skipping at two levels.

Index level. Under a global order of shingles (rare before frequent, then by hash)
two sets that link share a shingle in their prefixes, so only prefixes are indexed.
Lists are cut in blocks by set size. A block is skipped as a whole where its sizes or
positions cannot reach the overlap: of two sets that link, the smaller holds the
shared shingle among its first ``n - least_overlap(n, n)`` places, so a block without such a
place, or without a set of its own size step, has no link. Inside a block, bitmaps bound the
overlap from above.

Answer level. Sets answer from one another: equal sets are one set from the start. In a
first round each set is compared with its most similar neighbour in a few lists, and in
a list of many blocks also with the blocks' leaders, the sets nearest to what most sets
of a block hold. The classes that follow are the answers that neighbours inherit: a
block of one class is skipped, and a set is met only with sets of other classes. What such
a block links next extends the classes at once, so each set's remaining comparisons are
derived from what similar sets have answered. Skipping loses no class: what is skipped is
linked already.

Rows, not pairs, travel: the first round proposes at most one neighbour and one leader
for a set in a block, and the second round sends on the sets that may still link and
verifies them where they meet, giving at most one link for each set of a block. In a
list of many blocks only sets outside the list's largest class meet all blocks.

Frequent shingles are those in more than ``4 * sqrt(documents)`` prefixes; their
number is bounded by prefix entries over that count, and the ``MOST_FREQUENT`` top
ones are broadcast. The order only has to be the same for all sets, so a frequent
shingle that is left out costs time, not links. Every link is verified on the
shingle sets of the whole texts.

Defined results: a null text, or one without words, has an empty set, links with
nothing and is its own component; a text of fewer than ``width`` words is one shingle;
rows with the same doc_id and different texts are sets of their own that share the
id, so their links meet in it; a row without doc_id has its count, no component and no
links; an empty table gives an empty result; other columns are not read. doc_id is an integer.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.llm.common import give_back, offsets_of, removed, shared_folder, slices, small, written
from claimloom.llm.components import components
from claimloom.llm.kernels import mixed, rows_of, window_hashes, word_bounds, word_hashes

#: Words in a shingle; a link needs 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 3, 90
#: Frequent shingles that are broadcast at most (8 bytes each).
MOST_FREQUENT = 1 << 20
#: Lists that a set looks up in the first round.
FIRST_LISTS = 3
#: Sets in a block of an index list, and leaders that all sets of a long list meet.
BLOCK, LEADERS = 1024, 64
#: Shingles of decoded sets that a task keeps at hand.
DECODED = 1 << 22
#: Rows of blocks with the same smallest set that are compared in one place.
TOGETHER = 2048
#: Text that is cut into shingles at a time, in bytes; 64-bit words of bitmaps that are compared at a time.
TEXT_BYTES, COMPARED = 1 << 18, 1 << 20
#: Entries of a list that one task holds.
HOT = 1 << 16
#: Ids whose texts are picked out by a broadcast; more are picked out by a shuffle.
MOST_IDS = 500_000


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that sets of n and m must share to link: ceil(p (n + m) / (100 + p))."""
    return -(-(percent * (n + m)) // (100 + percent))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the first of each row (one more than rows)."""
    offsets, raw = offsets_of(column)
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    count = np.diff(first)
    row = rows_of(first)
    whole = window_hashes(words, width)
    inside = row[: len(whole)] == row[width - 1 :] if len(whole) else np.zeros(0, bool)
    parts, rows = [whole[inside]], [row[: len(whole)][inside]]
    for n in range(1, width):  # short texts: the whole sequence is the one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            at = first[short]
            parts.append(window_hashes(words, n)[at])
            rows.append(short)
    tokens, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    tokens, row = tokens[new], row[new]
    return tokens, np.searchsorted(row, np.arange(len(column) + 1))


def _prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(p n / 100) + 1: the smallest overlap with any set that can link."""
    return np.where(n > 0, n - -(-(percent * n) // 100) + 1, 0)


def _common(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Shingles of prefixes a little longer than needed, for counting."""
    for batch in batches:
        for part in slices(batch, limit=TEXT_BYTES):
            tokens, first = shingle_sets(part.column("text"), width)
            n = np.diff(first)
            upto = np.minimum(n, _prefix_lengths(n, percent) * 5 // 4 + 4)
            at = np.arange(len(tokens)) - np.repeat(first[:-1], n)
            found, count = np.unique(tokens[at < np.repeat(upto, n)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int32))], names=["token", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=TEXT_BYTES):
            tokens, first = shingle_sets(part.column("text"), width)
            n = np.diff(first)
            row = rows_of(first)
            zero = np.zeros(1, np.uint64)
            sums = np.concatenate([zero, np.cumsum(tokens, dtype=np.uint64)]), np.concatenate([zero, np.cumsum(mixed(tokens), dtype=np.uint64)])
            d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            if len(frequent) and len(tokens):
                late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                order = np.lexsort((late, row))  # stable: by hash inside
                tokens = tokens[order]
            keep = np.arange(len(tokens)) - np.repeat(first[:-1], n) < np.repeat(_prefix_lengths(n, percent), n)
            offsets = np.concatenate([[0], np.cumsum(_prefix_lengths(n, percent))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2), lists], names=["doc_id", "n", "d1", "d2", "prefix"])


def _listed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle and doc_id, those that can meet another of their list by size and position.

    The smaller of two sets that link has the shingle at a low place, and the larger is
    at most ``100 / percent`` times as large. A list that is dealt over tasks is kept whole.
    """
    for rows, group in _whole_groups(batches, ("token",)):
        token, doc, n, pos, salts = (rows.column(k).to_numpy() for k in ("token", "doc_id", "n", "pos", "salts"))
        new = np.ones(len(rows), bool)  # repeated rows
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])
        n, pos, group = n[new].astype(np.int64), pos[new].astype(np.int64), group[new]
        low = pos <= n - least_overlap(n, n, percent)
        key = group.astype(np.int64) << 32
        every, lows = np.sort(key + n), np.sort((key + n)[low])
        between = lambda x, a, b: (np.searchsorted(x, key + a, "left"), np.searchsorted(x, key + b, "right"))
        a, b = between(every, n, 100 * n // percent)
        as_smaller = low & (b - a > 1)
        a, b = between(lows, -(-(percent * n) // 100), n)
        least = (lows[np.minimum(a, len(lows) - 1)] & 0xFFFFFFFF) if len(lows) else n
        as_larger = (b - a - low > 0) & (n - pos >= least_overlap(n, least, percent))
        keep = np.flatnonzero(new)[as_smaller | as_larger | (salts[new] > 1)]
        if len(keep):
            yield from rows.take(pa.array(keep)).combine_chunks().to_batches()


def _bitmap_bits(n: int, percent: int) -> int:
    """A power of two, within bounds, so wide that two sets of n with little in common show to differ by more than a link allows.

    Of n bits each sets 0.63 and holds 0.23 alone, of 2 n it holds 0.48 alone; a link of 90 percent
    allows 0.05, one of 80 percent 0.11 and near copies that fall short of it little more.
    """
    wanted = n * max(1, round(20 * (100 - percent) / (100 + percent)))
    return min(1 << 16, max(64, 1 << (max(wanted, 1) - 1).bit_length()))


def _packed(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Compressed texts and the bitmaps of their sets."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in slices(batch, limit=TEXT_BYTES):
            tokens, first = shingle_sets(part.column("text"), width)
            maps = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                size = _bitmap_bits(b - a, percent)
                bits = np.zeros(size, bool)
                bits[(tokens[a:b] >> np.uint64(7)) & np.uint64(size - 1)] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            texts = [squeeze((t or "").encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()), pa.array(maps, pa.binary())], names=["doc_id", "packed", "bits"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys``, some groups at a time, none cut, with the number of each row's group."""
    held: list[pa.Table] = []
    for batch in _ended(batches):
        if batch is not None and batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if not held or batch is not None and not batch.num_rows:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        change = np.zeros(len(rows), bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        cut = len(rows) if batch is None else int(np.flatnonzero(change)[-1]) if change.any() else 0
        held = [rows.slice(cut)] if cut < len(rows) else []
        if cut:
            yield rows.slice(0, cut), np.cumsum(change[:cut])
        if batch is None:
            del rows
            give_back()


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _folded(maps: list[bytes], widths: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each row's place among those of its width, and for each width their bitmaps folded to it, as 64-bit words."""
    place = np.zeros(len(maps), np.int64)
    out = {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        place[at] = np.arange(len(at))
        out[width] = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, width // 64), axis=0) for i in at])
    return place, out


def _maps(rows: pa.Table, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The width at which each row's group compares bitmaps, and the folded bitmaps.

    One width for a size step: sets of the step and of the next have bitmaps as wide or wider.
    """
    bits = rows.column("bits").to_pylist()
    low = np.floor((100 / percent) ** rows.column("at").to_numpy().astype(np.float64)).astype(np.int64)
    widths = np.array([_bitmap_bits(int(x), percent) for x in low])
    have = np.array([len(b) * 8 for b in bits])  # rounding at a step's edge
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    widths = np.minimum(widths, np.minimum.reduceat(have, heads)[group])
    return widths, *_folded(bits, widths)


def _over(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray, widths: np.ndarray, place: np.ndarray, maps: dict[int, np.ndarray]) -> np.ndarray:
    """For pairs of rows, by how much the bound on their overlap exceeds what a link needs."""
    out = np.empty(len(a), np.int64)
    for width, m in maps.items():
        k = np.flatnonzero(widths[a] == width)
        step = max(1, COMPARED // (width // 64))
        for some in (k[at : at + step] for at in range(0, len(k), step)):
            x, y = m[place[a[some]]], m[place[b[some]]]
            out[some] = np.minimum(n[a[some]] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n[b[some]] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64)) - need[some]
    return out


def _lags(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group: each row with the one before it, then with the one before that."""
    i, lag = np.arange(1, len(group)), 1
    while len(i):
        i = i[i >= lag]
        i = i[group[i] == group[i - lag]]
        if len(i):
            yield i, i - lag
        lag += 1


def _nearest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each set of a block its likeliest partner; a leader is a partner only, and partners of its list's sets are leaders only."""
    for rows, group in _whole_groups(batches, ("head", "at", "part", "lead", "token")):
        doc, n, pos, upper, role = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "n", "pos", "upper", "role"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        widths, place, maps = _maps(rows, group, percent)
        best, partner = np.full(len(rows), -1), np.full(len(rows), -1)
        for i, j in _lags(group):
            need = least_overlap(n[i], n[j], percent)
            fits = (doc[i] != doc[j]) & ~(upper[i] & upper[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ((role[i] == 0) & (role[j] == 0) | (role[i] != role[j]))
            a, b = i[fits], j[fits]
            over = _over(a, b, n, need[fits], widths, place, maps)
            for x, y in ((a, b), (b, a)):
                better = (over > best[x]) & (role[x] < 2) & ((x is a) | (role[y] == 2))
                best[x[better]], partner[x[better]] = over[better], y[better]
        a = np.flatnonzero(partner >= 0)
        if len(a):
            a, b = doc[a], doc[partner[a]]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], names=["a", "b"])


def _leaders(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each block of a long list the set whose bitmap is nearest to the bits that most of its sets hold."""
    for rows, group in _whole_groups(batches, ("token", "at", "part")):
        widths, place, maps = _maps(rows, group, percent)
        doc = rows.column("doc_id").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(rows))
        chosen = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            bits = np.unpackbits(maps[int(widths[a])][place[a:b]].view(np.uint8), axis=1)
            far = (bits != (2 * bits.sum(0, dtype=np.int64) > b - a)).sum(1)
            chosen.append(a + int(np.lexsort((doc[a:b], far))[0]))
        yield from rows.select(["token", "at", "doc_id", "n", "pos", "upper", "bits"]).take(pa.array(chosen)).combine_chunks().to_batches()


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The sets of a block that may link with one of another class."""
    keys = ["head", "salt", "at", "kind", "block", "other"]
    for rows, group in _whole_groups(batches, (*keys, "token")):
        doc, n, pos, comp, side, upper = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "n", "pos", "comp", "side", "upper"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        widths, place, maps = _maps(rows, group, percent)
        may = np.zeros(len(rows), bool)
        for i, j in _lags(group):
            need = least_overlap(n[i], n[j], percent)
            fits = (comp[i] != comp[j]) & (side[i] | side[j] == 3) & ~(upper[i] & upper[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ~(may[i] & may[j])
            a, b = i[fits], j[fits]
            able = _over(a, b, n, need[fits], widths, place, maps) >= 0
            may[a[able]] = may[b[able]] = True
        at = np.flatnonzero(may)
        if len(at):
            # Lists of the same smallest set hold much the same sets: once each.
            place_of = np.stack([rows.column(k).to_numpy()[at].astype(np.int64) for k in (*keys, "doc_id")])
            order = at[np.unique(place_of, axis=1, return_index=True)[1]]
            yield from rows.select([*keys, "doc_id", "n", "comp", "side", "upper"]).take(pa.array(order)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between classes among the open sets of a block, each verified; a link joins two classes at once."""
    expand = zstandard.ZstdDecompressor().decompress
    for rows, group in _whole_groups(batches, ("head", "salt", "at", "kind", "block", "other")):
        doc, n, comp, side, upper = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "n", "comp", "side", "upper"))
        n = n.astype(np.int64)
        widths, place, maps = _maps(rows, group, percent)
        packed = rows.column("packed")
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while top.get(c, c) != c:
                top[c] = top.get(top[c], top[c])
                c = top[c]
            return c

        sets: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0

        def tokens(k: int) -> np.ndarray:
            nonlocal size
            if k in sets:
                sets.move_to_end(k)
            else:
                sets[k] = shingle_sets(pa.array([expand(packed[k].as_py())], pa.binary()), width)[0]
                size += len(sets[k])
                while size > DECODED and len(sets) > 2:
                    size -= len(sets.popitem(last=False)[1])
            return sets[k]

        out: list[tuple[int, int]] = []
        for i, j in _lags(group):
            need = least_overlap(n[i], n[j], percent)
            fits = (comp[i] != comp[j]) & (side[i] | side[j] == 3) & ~(upper[i] & upper[j]) & (np.minimum(n[i], n[j]) >= need)
            a, b = i[fits], j[fits]
            able = _over(a, b, n, need[fits], widths, place, maps) >= 0
            for x, y, least in zip(a[able].tolist(), b[able].tolist(), need[fits][able].tolist(), strict=True):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    left, right = tokens(x), tokens(y)
                    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                    if int((right[at] == left).sum()) >= least:
                        top[max(p, q)] = min(p, q)
                        out.append((int(doc[x]), int(doc[y])))
        if out:
            a, b = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    last, left = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            b = pa.array([expand(x) for x in part.column("packed_b").to_pylist()], pa.binary())
            tokens, first = shingle_sets(b, width)
            keep = []
            for k, (doc, packed) in enumerate(zip(part.column("a").to_pylist(), part.column("packed_a"), strict=True)):
                if doc != last:
                    left = shingle_sets(pa.array([expand(packed.as_py())], pa.binary()), width)[0]
                    last = doc
                right = tokens[first[k] : first[k + 1]]
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def _stepped(lists: DataFrame, percent: int) -> DataFrame:
    """Entries in the block of their own size step and, as upper, in the block below, where they meet the sets of the step before."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    return lists.withColumn("step", step).withColumn("at", F.explode(F.array(F.col("step"), F.col("step") - 1))).withColumn("upper", F.col("at") != F.col("step")).drop("step")


def _useful(entries: DataFrame, keys: list[str], percent: int, classes: bool) -> DataFrame:
    """Blocks that can hold a link, with their smallest set and a share of the blocks that have the same one."""
    low = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    differs = [F.min("comp").alias("c0"), F.max("comp").alias("c1")] if classes else [F.min("doc_id").alias("c0"), F.max("doc_id").alias("c1")]
    met = entries.groupBy("token", *keys).agg(*differs, F.min("doc_id").alias("head"), F.min("upper").alias("all_upper"), F.max(F.col("pos") <= low).alias("low"), F.count("*").alias("rows"))
    met = met.where("c0 <> c1 AND NOT all_upper AND low")
    weight = F.sum("rows").over(W.partitionBy("head", *keys))
    return met.select("token", *keys, "head", F.pmod(F.xxhash64("token"), F.ceil(weight / F.lit(TOGETHER))).cast("int").alias("salt"))


def _first_pairs(few: DataFrame, bits: DataFrame, folder: str, percent: int) -> DataFrame:
    """One likely neighbour for each set of a block, and one leader in the lists of many blocks; ``few`` has token, doc_id, n, pos, parts."""
    entries = _stepped(few, percent).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    names = ["token", "at", "part", "head", "salt", "doc_id", "n", "pos", "upper"]
    useful = _useful(entries, ["at", "part"], percent, False)
    blocks = written(entries.join(useful, ["token", "at", "part"]).select(*names, "parts"), folder, "blocks")
    rows = blocks.drop("parts").join(bits, "doc_id").withColumns({"lead": F.lit(0), "role": F.lit(0)})
    long = written(blocks.where("parts > 1").drop("head", "salt").join(bits, "doc_id"), folder, "long-blocks")
    if not long.isEmpty():
        turn, heads = 0, long
        while True:
            found = heads.repartition("token", "at", "part").sortWithinPartitions("token", "at", "part", "doc_id")
            leaders = written(found.mapInArrow(lambda it: _leaders(it, percent), "token long, at int, doc_id long, n int, pos int, upper boolean, bits binary"), folder, f"leaders-{turn}")
            many = leaders.groupBy("token", "at").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"), F.count("*").alias("n_leaders"))
            if many.where(F.col("n_leaders") > LEADERS).isEmpty():
                break
            # Too many blocks: the leaders themselves meet in blocks and choose leaders.
            turn, heads = turn + 1, leaders.join(many.select("token", "at", "parts"), ["token", "at"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("parts")).cast("int"))
        own = F.pmod(F.xxhash64("token", "at", "part"), F.lit(1 << 30)).cast("int")
        met = long.select("token", "at", "part").distinct().join(leaders, ["token", "at"]).withColumn("role", F.lit(2))
        asked = long.drop("parts").withColumn("role", F.lit(1)).unionByName(met)
        rows = rows.unionByName(asked.withColumns({"head": F.lit(-1).cast("long"), "salt": own, "lead": F.lit(1)}))
    order = ["head", "at", "part", "lead", "token"]
    return (
        rows.repartition("head", "at", "part", "lead", "salt")
        .sortWithinPartitions(*order, "doc_id")
        .mapInArrow(lambda it: _nearest(it, percent), "a long, b long")
        .distinct()
    )


def _other_links(classed: DataFrame, bits: DataFrame, texts: DataFrame, folder: str, width: int, percent: int) -> DataFrame:
    """Links between sets of different classes; ``classed`` has token, doc_id, n, pos, parts, salt, salts and comp."""
    spread = classed.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("salts").alias("salts")).where("c0 <> c1")
    spread = spread.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mixed_lists = written(classed.join(spread, ["token", "salt"], "left_semi"), folder, "mixed")
    # In a list of many blocks the largest class is not compared with itself.
    sizes = mixed_lists.where("parts > 1").groupBy("token", "comp").agg(F.count("*").alias("held"))
    most = sizes.groupBy("token").agg(F.max(F.struct("held", "comp")).alias("most"), F.sum("held").alias("all"))
    blocks_of = lambda x: F.ceil(x / F.lit(BLOCK)).cast("int")
    most = most.select("token", F.col("most.comp").alias("largest"), blocks_of(F.col("most.held")).alias("wide"), F.greatest(F.lit(1), blocks_of(F.col("all") - F.col("most.held"))).alias("rest"))
    entries = mixed_lists.drop("salt", "salts", "parts").join(small(written(most, folder, "most")), "token", "left")
    large = F.coalesce(F.col("comp") == F.col("largest"), F.lit(False))
    wide, rest = F.coalesce("wide", F.lit(0)), F.coalesce("rest", F.lit(1))
    turn = F.xxhash64("doc_id")
    mine, theirs = F.pmod(turn, F.greatest(wide, F.lit(1))).cast("int"), F.pmod(turn, rest).cast("int")
    place = lambda kind, block, other, side: F.struct(F.lit(kind).alias("kind"), block.alias("block"), other.alias("other"), side.alias("side"))
    upto = lambda x: F.when(x > 0, F.sequence(F.lit(0), x - 1)).otherwise(F.array().cast("array<int>"))
    across = F.transform(upto(rest), lambda k: place(0, mine, k, F.lit(1)))
    along = F.transform(upto(wide), lambda k: place(0, k, theirs, F.lit(2)))
    within = F.transform(upto(rest), lambda k: place(1, F.least(theirs, k), F.greatest(theirs, k), F.when(theirs == k, 3).when(theirs < k, 1).otherwise(2)))
    entries = entries.withColumn("place", F.explode(F.when(large, across).otherwise(F.concat(along, within))))
    entries = _stepped(entries.select("token", "doc_id", "n", "pos", "comp", "place.*"), percent)
    keys = ["at", "kind", "block", "other"]
    blocks = entries.join(_useful(entries, keys, percent, True), ["token", *keys])
    order = ["head", "salt", *keys]
    open_schema = "head long, salt int, at int, kind int, block int, other int, doc_id long, n int, comp long, side int, upper boolean"
    opened = (
        blocks.join(bits, "doc_id")
        .repartition(*order)
        .sortWithinPartitions(*order, "token", "doc_id")
        .mapInArrow(lambda it: _open(it, percent), open_schema)
    )
    opened = written(opened, folder, "open")
    return (
        opened.distinct()
        .join(_needed(texts, opened.select("doc_id")), "doc_id")
        .repartition(*order)
        .sortWithinPartitions(*order, "doc_id")
        .mapInArrow(lambda it: _links(it, width, percent), "a long, b long")
    )


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with these ids, repeated ones once."""
    found = texts.join(small(ids.distinct(), MOST_IDS), "doc_id", "left_semi")
    return found.dropDuplicates(["doc_id", "packed"])


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    lean = _needed(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).select("doc_id", "packed")
    return (
        pairs.join(lean.select(F.col("doc_id").alias("b"), F.col("packed").alias("packed_b")), "b")
        .join(lean.select(F.col("doc_id").alias("a"), F.col("packed").alias("packed_a")), "a")
        .select("a", "b", "packed_a", "packed_b")
        .mapInArrow(lambda it: _verified(it, width, percent), "a long, b long")
    )


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_shingles and component_id, one row for each row."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.count()
    counted = docs.select("text").mapInArrow(lambda it: _common(it, width, percent), "token long, n int")
    often = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * max(1.0, total) ** 0.5)
    often = written(often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT), folder, "often")
    top = often.select("token").toArrow().column("token").to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(top.astype(np.int64).view(np.uint64)))

    sets = written(docs.mapInArrow(lambda it: _prefixes(it, frequent.value, width, percent), "doc_id long, n long, d1 long, d2 long, prefix array<long>"), folder, "sets")
    # Equal sets are one set; its smallest doc_id stands for it.
    heads = written(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node")), folder, "heads")
    # A very frequent shingle's entries are dealt over several tasks.
    salts = often.where(F.col("n") > HOT).select("token", F.ceil(F.col("n") / F.lit(HOT)).cast("int").alias("salts"))
    one = sets.join(heads.select(F.col("node").alias("doc_id"), "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_semi")
    entries = one.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    entries = entries.join(small(salts), "token", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    entries = entries.select("token", "doc_id", "n", "pos", "salts").repartition("token", salt).sortWithinPartitions("token", "doc_id", "n")
    lists = written(entries.mapInArrow(lambda it: _listed(it, percent), "token long, doc_id long, n int, pos int, salts int"), folder, "lists")
    long = written(lists.groupBy("token").agg(F.count("*").alias("length")).where(F.col("length") > BLOCK), folder, "long")
    parts = F.coalesce(F.ceil(F.col("length") / F.lit(BLOCK)), F.lit(1)).cast("int")
    cut = lists.join(small(long), "token", "left").select("token", "doc_id", "n", "pos", salt.alias("salt"), "salts", parts.alias("parts"))
    texts = written(docs.where("doc_id IS NOT NULL").mapInArrow(lambda it: _packed(it, width, percent), "doc_id long, packed binary, bits binary"), folder, "texts")
    bits = texts.select("doc_id", "bits").join(lists.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "bits"])
    bits = written(bits, folder, "bits")

    turn = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    few = cut.withColumn("turn", turn).where(F.col("turn") <= FIRST_LISTS).select("token", "doc_id", "n", "pos", "parts")
    pairs = written(_first_pairs(few, bits, folder, percent), folder, "pairs")
    removed(spark, *[f"{folder}/{name}" for name in ("blocks", "long-blocks", "leaders-*")])
    links = written(_verify(pairs, texts, width, percent), folder, "links-1")
    known = components(links, folder, "first")
    classed = cut.join(known, cut.doc_id == known.node, "left").select("token", "doc_id", "n", "pos", "parts", "salt", "salts", F.coalesce("component", "doc_id").alias("comp"))
    more = written(_other_links(classed, bits, texts, folder, width, percent), folder, "links-2")
    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), folder, "all")
    # The result is made of sets, heads and the last components; the rest would only hold disk.
    removed(spark, *[f"{folder}/{name}" for name in ("often", "lists", "long", "texts", "bits", "pairs", "links-*", "first-*", "mixed", "most", "open")])

    classes = heads.join(joined, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    out = sets.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
