"""Spans over texts: islands of tags, interval joins, boundary segments, edits and offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window as W


@F.pandas_udf(ArrayType(IntegerType()))
def starts_of(lengths: pd.Series) -> pd.Series:
    """Where each piece of a text starts, from the pieces' lengths with one separator between two; inside the row, so nothing is shuffled."""
    return lengths.map(lambda n: np.cumsum(np.concatenate([[0], np.asarray(n)[:-1] + 1])).astype(np.int32) if n is not None and len(n) else np.zeros(0, np.int32))


def pieces(frame: DataFrame, split: Column, keys: list[str], at: str, value: str) -> DataFrame:
    """The pieces of a split text in order, with half-open code-point offsets."""
    parts = frame.select(*keys, split.alias("_p")).withColumn("_s", starts_of(F.transform("_p", lambda x: F.length(x))))
    rows = parts.select(*keys, F.posexplode(F.arrays_zip("_p", "_s")).alias(at, "_r"))
    start = F.col("_r._s").cast("long")
    return rows.select(*keys, at, F.col("_r._p").alias(value), start.alias("char_start"), (start + F.length("_r._p")).alias("char_end"))


def words(documents: DataFrame) -> DataFrame:
    """Words of each text with code-point offsets, half open; a null text has none."""
    return pieces(documents, F.split("text", " "), ["doc_id"], "tok_idx", "surface")


def surfaces(documents: DataFrame) -> DataFrame:
    """``words`` without their offsets, which take a pass of their own over each text."""
    return documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("tok_idx", "surface"))


def islands(tokens: DataFrame) -> DataFrame:
    """Spans of BIO tags: ``B`` always opens, ``I`` opens where no span of its type goes on; the confidence is the geometric mean."""
    w = W.partitionBy("doc_id").orderBy("tok_idx")
    typed = tokens.select("doc_id", "tok_idx", "conf", F.col("tag").startswith("I-").alias("inner"), F.when(F.col("tag") != "O", F.substring("tag", 3, 100)).alias("kind"))
    goes_on = F.col("inner") & F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    numbered = typed.withColumn("opens", F.when(F.col("kind").isNull() | goes_on, 0).otherwise(1)).withColumn("span", F.sum("opens").over(w)).where("kind IS NOT NULL")
    # A span is of one kind; as a key it leaves numbers alone to be aggregated, which needs no second sort.
    return numbered.groupBy("doc_id", "span", "kind").agg(
        F.min("tok_idx").alias("tok_start"), (F.max("tok_idx") + 1).alias("tok_end"), F.round(F.exp(F.avg(F.log(F.greatest("conf", F.lit(1e-9))))), 6).alias("conf")
    ).select("doc_id", "tok_start", "tok_end", "kind", "conf")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Pairs of spans of one ``key`` that overlap (``start < end2 AND end > start2``), met by position bins."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    a, b = left.withColumn("cell", cells("start", "end")), right.withColumn("cell", cells("start2", "end2"))
    first = F.floor(F.greatest("start", "start2") / width)  # each pair counts in the first cell it shares
    return a.join(b, [key, "cell"]).where("start < end2 AND end > start2").where(F.col("cell") == first).drop("cell")


def overlapping_pairs(spans: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Pairs of spans of one table that overlap, the one that starts first on the left; equal starts are no pair."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)))
    a = spans.withColumn("cell", cells)
    b = spans.select(F.col(key).alias("_key"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    b = b.withColumn("_cell", F.floor(F.col("start2") / width))  # the later start's cell is one that both share
    meets = (a[key] == b["_key"]) & (a["cell"] == b["_cell"]) & (a["start"] < b["start2"]) & (a["end"] > b["start2"])
    return a.join(b, meets).select(key, "start", "end", "start2", "end2")


def boundary_segments(spans: DataFrame, key: str) -> DataFrame:
    """Texts cut at every boundary of overlapping spans, with how many cover each piece."""
    events = spans.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(key, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(key).orderBy("start")
    return steps.select(key, "start", F.lead("start").over(w).alias("end"), F.sum("d").over(w).alias("depth")).where("end IS NOT NULL AND depth > 0")


def shifted(targets: DataFrame, edits: DataFrame) -> DataFrame:
    """Tracked spans after edits (key, start, end, delta): edits that end before a span move it, those inside stretch it."""
    joined = targets.join(edits.select("key", F.col("start").alias("e0"), F.col("end").alias("e1"), "delta"), "key", "left")
    before = F.sum(F.when(F.col("e1") <= F.col("start"), F.col("delta")).otherwise(0))
    inside = F.sum(F.when((F.col("e0") >= F.col("start")) & (F.col("e1") <= F.col("end")) & (F.col("e1") > F.col("start")), F.col("delta")).otherwise(0))
    return joined.groupBy("key", "start", "end").agg(before.alias("b"), inside.alias("i")).select("key", (F.col("start") + F.col("b")).alias("new_start"), (F.col("end") + F.col("b") + F.col("i")).alias("new_end"))


def segment_softmax(edges: DataFrame) -> DataFrame:
    """Attention over the edges into each node: ``exp(score - max) / sum``."""
    w = W.partitionBy("doc_id", "dst")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return edges.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def _held(text: str, start: int, end: int) -> str:
    """What SQL's ``substring(text, start + 1, end - start)`` gives: a negative position counts from the end."""
    if start < -1:
        start, end = len(text) + start + 1, len(text) + end + 1
    elif start == -1:
        start, end = 0, end + 1
    return text[max(start, 0) : max(end, 0)]


def broken_offsets(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans whose text is not what the document holds there; empty if all is well.

    A text comes before its spans in one sorted stream, so it is held once and a span takes no longer the further in it stands.
    """
    texts = documents.select("doc_id", F.col("text").alias("_text"), F.lit(False).alias("_span"))
    names = spans.columns
    rows = texts.unionByName(spans.withColumn("_span", F.lit(True)), allowMissingColumns=True).where("doc_id IS NOT NULL")

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, texts = None, []
        for batch in batches:
            found = []
            for k, (own, text, span, start, end, surface) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_text", "_span", "char_start", "char_end", "surface")), strict=True)):
                if own != doc:
                    doc, texts = own, []
                if not span:
                    texts += [text] if text is not None else []
                elif texts and start is not None and end is not None and surface is not None:
                    found += [k for t in texts if (t[start:end] if 0 <= start <= end else _held(t, start, end)) != surface]
            yield batch.select(names).take(pa.array(found, pa.int64()))

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "_span").mapInArrow(broken, spans.schema)
