"""Exact top-k search of binary codes by incremental multi-index hashing.

Vectors become 64-bit codes, the signs of fixed random projections. A code is cut
into ``m`` parts, the fewest of at most log2(codes) bits, each indexed by its value. Wider
parts would meet fewer codes, but take more probes, and a probe is shuffled and sorted
while a code that it meets is only compared. Round ``r`` looks up, for every open query and part, all values at
distance ``r``: by the pigeonhole principle every code within ``m * (r + 1) - 1`` has
then been met. A query closes once its kth verified distance is within that bound, so
its answer is proven complete; only the open ones go on to the next radius.

The kth distance met so far bounds the final one from above. So a part ``i`` is probed
at radius ``r`` only if ``m * r + i`` is within it (a farther code has no other way in),
and codes beyond it are dropped where they are met.

Equal codes are one entry with its smallest ids (no more than k can ever be
returned), and equal queries are asked once, so a very common vector costs one entry.

Ties are broken by the smaller id. Defined results: a null vector, or one with a null
or of another length than most, has no code and is neither query nor answer; with
fewer than k codes all are returned; repeated rows are answers each; an empty table
gives an empty result; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.llm.common import shared_folder, written

BITS, K = 64, 10


def codes(vectors: DataFrame, seed: int = 3) -> DataFrame:
    """``vectors`` (vec_id, embedding) with their code; rows without one are left out."""
    sized = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")
    most = sized.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = most["d"] if most else 1

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(width, BITS)).astype(np.float64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                bits = np.packbits(x.astype(np.float64) @ planes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(bits)], names=["vec_id", "code"])

    return sized.where(F.size("embedding") == width).mapInArrow(signed, f"vec_id {dict(vectors.dtypes)['vec_id']}, code long")


def parts_of(entries: int) -> list[tuple[int, int]]:
    """First bit and width of each part: 64 / log2(entries) parts, rounded up."""
    edges = np.linspace(0, BITS, max(2, int(np.ceil(BITS / np.log2(max(4, entries))))) + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(code: str, first: int, width: int):
    return F.shiftrightunsigned(F.col(code), first).bitwiseAND(F.lit((1 << width) - 1))


def _probes(batches: Iterator[pa.RecordBatch], radius: int, parts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    masks = {width: np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64) for _, width in parts}
    for batch in batches:
        q, far = batch.column("q").to_numpy(), batch.column("far").to_numpy()
        for k, (first, width) in enumerate(parts):
            mask, able = masks[width], np.flatnonzero(far >= len(parts) * radius + k)
            step = max(1, (1 << 18) // max(1, len(mask)))
            for at in range(0, len(able), step):
                some = able[at : at + step]
                value = (q[some].view(np.uint64) >> np.uint64(first)).view(np.int64) & ((1 << width) - 1)
                n = len(some) * len(mask)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q[some], len(mask))), pa.array(np.repeat(far[some], len(mask))), pa.array(np.full(n, k, np.int32)), pa.array((value[:, None] ^ mask[None]).ravel())],
                    names=["q", "far", "part", "value"],
                )


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest codes of ``vectors`` (vec_id, embedding) for each row of ``queries`` (query_id, code).

    Returns query_id, rank (from 1), vec_id and distance.
    """
    folder = shared_folder(vectors.sparkSession)
    coded = written(codes(vectors), folder, "codes")
    # Of each code the k smallest ids: numbered in shards of the id first, then over the few that are left.
    near = coded.withColumn("n", F.row_number().over(W.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id"))).where(F.col("n") <= k)
    ids = near.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k).alias("ids"))
    entries = written(ids, folder, "entries")
    parts = parts_of(entries.count())
    index = written(entries.select("code", F.size("ids").alias("held"), F.posexplode(F.array(*[_part("code", *p) for p in parts])).alias("part", "value")), folder, "index")
    asked = written(queries.select("query_id", "code"), folder, "asked")
    pending = asked.select(F.col("code").alias("q"), F.lit(BITS).alias("far")).distinct()
    answers, best, last = [], None, max(width for _, width in parts)
    for radius in range(last + 1):
        probes = pending.mapInArrow(lambda it, r=radius: _probes(it, r, parts), "q long, far int, part int, value long")
        # Probes are far more than their queries, which Spark's estimate of their size does not know.
        within = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))) <= F.col("far")
        meets = (probes.part == index.part) & (probes.value == index.value) & within
        met = probes.join(index.hint("merge"), meets).select("q", "code", "held").distinct()
        met = met.withColumn("d", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))))
        if best is not None:
            met = met.unionByName(best.join(pending, "q", "left_semi").select("q", "code", "held", "d")).distinct()
        # A code stays if fewer than k answers are nearer; equally near codes all stay, for the ties.
        nearer = F.coalesce(F.sum("held").over(W.partitionBy("q").orderBy("d").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        best = written(met.withColumn("nearer", nearer).where(F.col("nearer") < k).drop("nearer"), folder, f"best-{radius}")
        bound = len(parts) * (radius + 1) - 1
        reach = best.groupBy("q").agg(F.max("d").alias("far"), F.sum("held").alias("held"))
        closed = reach.where((F.col("held") >= k) & (F.col("far") <= bound)) if radius < last else reach
        closed = written(closed.select("q"), folder, f"closed-{radius}")
        answers.append(best.join(closed, "q", "left_semi"))
        known = reach.select("q", F.when(F.col("held") >= k, F.col("far")).otherwise(BITS).cast("int").alias("far"))
        pending = pending.select("q").join(closed, "q", "left_anti").join(known, "q", "left").select("q", F.coalesce("far", F.lit(BITS)).alias("far"))
        pending = written(pending, folder, f"pending-{radius}")
        if pending.isEmpty():
            break
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    flat = found.join(entries, "code").select("q", "d", F.explode("ids").alias("vec_id"))
    flat = flat.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return asked.join(flat, asked.code == flat.q).select("query_id", "rank", "vec_id", F.col("d").cast("int").alias("distance"))
