"""Incremental removal of repeated word windows by a log-structured fingerprint index.

A window of ``WINDOW`` words picks its anchor: the run of ``GRAM`` words in it whose
hash is least, the first of these on a tie. Equal windows pick equal anchors, so an
index entry stands for all windows around one anchor: ``gram`` is the anchor's hash
and ``context`` that of all words in those windows. About one word in eight has an
entry. Runs are immutable tables of entries in the order of gram and context.

A batch is merged with the runs in that order, one pass over sorted rows:

* an entry whose context came earlier repeats it whole: all its windows are covered;
* an entry whose gram has other contexts is contested: some of its windows may recur.

Contested entries are verified on the texts: their windows are cut out, and a window
is covered if the words of an earlier one have the same 128-bit digest. The entries
that are first of their context become the batch's run, and ``compact`` merges runs
once there are ``FAN_IN`` of them. Since earlier windows always stand in the index,
a batch's result does not depend on how the documents are cut into batches.

Map tasks settle the repeats they see themselves and send them on under random keys,
so a passage in a third of all documents does not meet in one task; the merge keeps
one row at a time of any group.

Defined results: a null or empty text has no words; a text shorter than a window loses
nothing; a row that is repeated whole gets the same result each time, since it is the
same document; a row without doc_id has no place in the order, so it loses nothing and takes nothing
from others (``dedup``; an index takes rows with an id only); an empty table gives an empty
result; other columns are not read. doc_id is an integer and rises from batch to batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import offsets_of, shared_folder, slices, written
from claimloom.llm.kernels import mixed, powers, ranges, rows_of, window_hashes, word_bounds, word_hashes

WINDOW, GRAM = 20, 6
#: Runs that are merged into one.
FAN_IN = 4
#: Batches that the registered query cuts its table into.
BATCHES = 2
_T = 0xA0761D6478BD642F | 1
_RUN = "gram long, context long, doc_id long, place long"
#: place = first window start * 32 + number of windows.
_STEP = 32


def _entries(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            offsets, raw = offsets_of(part.column("text"))
            starts, ends, first = word_bounds(raw, offsets)
            words, row = word_hashes(raw, starts, ends), rows_of(first)
            if len(words) < window:
                continue
            grams = window_hashes(words, gram)
            s = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
            if not len(s):
                continue
            view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
            anchor = np.concatenate([s[a : a + 65536] + view[s[a : a + 65536]].argmin(1) for a in range(0, len(s), 65536)])
            new = np.ones(len(s), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(s)))
            low, anchor = s[at], anchor[at]
            up, down = powers(_T, len(words) + 1)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mixed(words) * up[: len(words)], out=total[1:])
            context = mixed((total[low + count + window - 1] - total[low]) * down[low] + ((anchor - low) * _STEP + count).astype(np.uint64))
            a, c = grams[anchor].view(np.int64), context.view(np.int64)
            doc = part.column("doc_id").to_numpy()[row[low]]
            place = (low - first[row[low]]) * _STEP + count
            order = np.lexsort((place, doc, c, a))
            head = np.ones(len(order), bool)
            head[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            done = np.zeros(len(order), bool)
            done[order] = (doc[lead] != doc[order]) | (place[lead] != place[order])
            # Settled here: any key will do.
            key = np.where(done, mixed((doc.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64)).view(np.int64), a)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(doc), pa.array(place), pa.array(done)], names=["gram", "context", "doc_id", "place", "done"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of sorted entries: 0 alone, 1 covered, 2 contested; old entries only if contested.

    Only the last open entry and the leader of the last context wait for the next batch.
    """
    names = ["gram", "context", "doc_id", "place", "old", "state"]

    def out(g, c, d, p, old, state) -> pa.RecordBatch:
        keep = ~old | (state == 2)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (g, c, d, p, old, state.astype(np.int32))], names=names)

    open_row = None  # (gram, context, doc, place, old, contested): leader of the last context
    for batch in batches:
        g, c, d, p, old, done = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("gram", "context", "doc_id", "place", "old", "done"))
        if done.any():
            yield out(g[done], c[done], d[done], p[done], old[done], np.ones(int(done.sum())))
            g, c, d, p, old = (x[~done] for x in (g, c, d, p, old))
        if not len(g):
            continue
        carried = open_row is not None
        if carried:
            g, c, d, p, old = (np.concatenate([np.array([v], x.dtype), x]) for v, x in zip(open_row[:5], (g, c, d, p, old), strict=True))
        head = np.ones(len(g), bool)
        head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        heads = np.flatnonzero(head)
        lead = heads[np.cumsum(head) - 1]
        same = (d == d[lead]) & (p == p[lead])
        hg = g[heads]
        rival = np.zeros(len(heads), bool)
        rival[1:] |= hg[1:] == hg[:-1]
        rival[:-1] |= hg[1:] == hg[:-1]
        if carried:
            rival[0] |= open_row[5]
        state = np.where(head, np.where(rival, 2, 0)[np.cumsum(head) - 1], np.where(same, 3, 1))
        last = heads[-1]
        open_row = (g[last], c[last], d[last], p[last], old[last], bool(rival[-1]))
        emit = state != 3  # the leader's own repeats say nothing new
        emit[last] = False
        if emit.any():
            yield out(*(x[emit] for x in (g, c, d, p, old, state)))
    if open_row is not None:
        yield out(*(np.array([v]) for v in open_row[:5]), np.array([2 if open_row[5] else 0]))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in slices(batch):
            texts = [squeeze((t or "").encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _words(packed: bytes) -> list[bytes]:
    # bytes.split() cuts at the six ASCII white spaces alone.
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of contested entries."""
    for batch in batches:
        docs, starts, olds, digests = [], [], [], []
        for doc, packed, places in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("places").to_pylist(), strict=True):
            words = _words(packed.as_py())
            for place in places:
                old, place = place < 0, abs(place)
                for s in range(place // _STEP, place // _STEP + place % _STEP):
                    docs.append(doc)
                    starts.append(s)
                    olds.append(old)
                    digests.append(hashlib.blake2b(b" ".join(words[s : s + window]), digest_size=16).digest())
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(olds, pa.bool_())],
            names=["h1", "h2", "doc_id", "start", "old"],
        )


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, sha, texts = [], [], [], []
        for packed, places in zip(batch.column("packed"), batch.column("places"), strict=True):
            words = _words(packed.as_py())
            if places.is_valid and len(words):
                place = places.values.to_numpy()
                at = np.zeros(len(words) + 1, np.int64)
                np.add.at(at, np.minimum(place // _STEP, len(words)), 1)
                np.add.at(at, np.minimum(place // _STEP + place % _STEP + window - 1, len(words)), -1)
                stay = np.cumsum(at[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k])
                removed.append(int(len(words) - stay.sum()))
            else:
                kept = b" ".join(words)
                removed.append(0)
            total.append(len(words))
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


class Index:
    """Runs of fingerprints in a folder that all executors share."""

    def __init__(self, spark, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.folder = spark, folder or shared_folder(spark)
        self.window, self.gram, self.fan_in = window, gram, fan_in
        self.runs: list[DataFrame] = []
        self.made = 0

    def entries(self) -> DataFrame:
        """All entries, each the first of its context."""
        out = self.spark.createDataFrame([], _RUN)
        for run in self.runs:
            out = out.unionByName(run)
        return out

    def compact(self) -> None:
        """Merge all runs into one sorted run."""
        self.made += 1
        run = written(self.entries().repartition("gram").sortWithinPartitions("gram", "context"), self.folder, f"compacted-{self.made}")
        self.runs = [run]

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Deduplicate ``batch`` (doc_id, text) against itself and all before, and index it.

        ``history`` has the texts of earlier batches, for verification. Returns doc_id,
        n_words, n_removed and kept_sha256 for each row of the batch.
        """
        window, gram = self.window, self.gram
        self.made += 1
        name = f"{self.made}"
        batch = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        fresh = batch.mapInArrow(lambda it: _entries(it, window, gram), _RUN + ", done boolean").withColumn("old", F.lit(False))
        known = self.entries().withColumns({"done": F.lit(False), "old": F.lit(True)})
        order = ["gram", "context", F.desc("old"), "doc_id", "place"]
        rows = fresh.unionByName(known) if self.runs else fresh
        merged = rows.repartition("gram").sortWithinPartitions(*order).mapInArrow(_merged, _RUN + ", old boolean, state int")
        merged = written(merged, self.folder, f"merged-{name}")

        contested = merged.where("state = 2")
        if self.runs:
            newly = contested.where("NOT old").select("gram").distinct()
            contested = contested.where("NOT old").unionByName(contested.where("old").join(newly, "gram", "left_semi"))
        texts = batch if history is None or not self.runs else batch.unionByName(history.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        # Old places are negative: place is at least 1.
        marks = contested.groupBy("doc_id").agg(F.collect_list(F.when(F.col("old"), -F.col("place")).otherwise(F.col("place"))).alias("places"))
        packed = texts.mapInArrow(_squeezed, "doc_id long, packed binary")
        cut = packed.join(marks, "doc_id").mapInArrow(lambda it: _windows(it, window), "h1 long, h2 long, doc_id long, start long, old boolean")
        cut = written(cut, self.folder, f"windows-{name}")
        first = cut.groupBy("h1", "h2").agg(F.min(F.struct(~F.col("old"), "doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = cut.where("NOT old").join(first.select("h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.start").alias("s")), ["h1", "h2"]).where("doc_id <> d OR start <> s")
        covered = merged.where("state = 1").select("doc_id", "place").unionByName(again.select("doc_id", (F.col("start") * _STEP + 1).alias("place")))
        lists = covered.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        result = batch.mapInArrow(_squeezed, "doc_id long, packed binary").join(lists, "doc_id", "left")
        result = result.mapInArrow(lambda it: _kept(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")

        self.runs.append(merged.where("NOT old AND state <> 1").select("gram", "context", "doc_id", "place"))
        if len(self.runs) > self.fan_in:
            self.compact()
        return result


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Feed ``docs`` to a fresh index in ``batches`` ranges of doc_id, in rising order."""
    index = Index(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low, high, without = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    alone = docs.where("doc_id IS NULL").mapInArrow(_squeezed, "doc_id long, packed binary").withColumn("places", F.lit(None).cast("array<long>"))
    window = index.window
    alone = alone.mapInArrow(lambda it: _kept(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    docs = docs.where("doc_id IS NOT NULL") if without else docs
    if low is None:
        return alone if without else index.add(docs)
    cuts = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
    out = None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        result = index.add(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)), docs.where(F.col("doc_id") < a))
        out = result if out is None else out.unionByName(result)
    return out.unionByName(alone) if without else out
