"""From files to stored claims: reading, content-hash dedupe, extraction, resolution, identity and routing, in batches or as a stream.

Every batch of files has a number and writes its documents, entities and claims under it, so a batch that runs again
replaces what it wrote and nothing is stored twice. A batch reads what earlier ones stored and never rewrites it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimloom.functions.text import uuid5
from claimloom.operators import evals, extraction, feed, resolve, routing
from claimloom.sources import documents as sources
from claimloom.sources.durable import cut

#: Namespace of this library's name-based identifiers.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
#: Places that a document takes in the order of mentions: two for each character of the longest text.
PLACES = 2 * (sources.MOST_CHARS + 1)
FILES = "path string, modificationTime timestamp, length long, content binary"


class Stored(NamedTuple):
    """What a batch adds: documents (document_no, path, title, content_sha, text), entities (entity_id, surface, alias) and claims."""

    documents: DataFrame
    entities: DataFrame
    claims: DataFrame


def numbered(documents: DataFrame, first: int) -> DataFrame:
    """``documents`` with document_no from ``first`` on in the order of their paths; no task sorts them all."""
    placed = evals.running(documents.withColumn("_one", F.lit(1)), ["path"], "_one")
    return placed.withColumn("document_no", F.col("before") + F.lit(first)).drop("_one", "before", "total")


def claims_of(documents: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims stated in ``documents`` (document_no, text), and the names of entities that are new or have not been met before.

    Names are resolved in the order of documents and places against ``entities`` (entity_id, surface, alias). Of a claim stated both
    ways in a document the surest direction stays, and a claim of a party with itself is none. A claim's id comes from its document, span, relation and parties.
    """
    drafts = cut(extraction.lexical_drafts(documents.select("document_no", "text")))
    side = lambda c, k: F.struct(F.lit(k).alias("k"), F.col(c).alias("surface"))
    place = F.col("document_no") * PLACES + F.col("start2") * 2 + F.col("m.k")
    mentions = drafts.select("*", F.explode(F.array(side("subject", 0), side("object", 1))).alias("m")).select(F.lit(0).alias("org_id"), place.alias("position"), "m.surface")
    known = None if entities is None else entities.select(F.lit(0).alias("org_id"), "entity_id", "surface", "alias")
    found = cut(resolve.resolved(mentions, known))
    who = found.select("position", "entity_id")
    at = F.col("document_no") * PLACES + F.col("start2") * 2
    both = drafts.withColumn("position", at).join(who.withColumnRenamed("entity_id", "subject_id"), "position").withColumn("position", at + 1).join(who.withColumnRenamed("entity_id", "object_id"), "position")
    name = F.concat_ws("|", F.lit("claim"), *[F.col(c).cast("string") for c in ("document_no", "start2", "end2", "relation", "subject_id", "object_id")])
    claims = both.where("subject_id <> object_id").select(
        uuid5(NAMESPACE, name).alias("claim_id"), F.col("document_no").alias("document_id"), F.col("start2").alias("char_start"), F.col("end2").alias("char_end"), "subject_id", "object_id", "subject", "object", "relation", "confidence",
    )
    names = found.groupBy("entity_id", "surface").agg(F.bool_and(F.col("method") != "new").alias("alias"))
    if known is not None:
        names = names.join(known.select("entity_id", "surface"), ["entity_id", "surface"], "left_anti")
    return feed.one_direction(claims), names


def ingested(files: DataFrame, before: Stored | None = None) -> Stored:
    """What ``files`` (path, content, as Spark's binaryFile gives them) add to what is stored; files that cannot be used add nothing."""
    usable = sources.texts_of(files).where("error IS NULL").select("path", "title", "content_sha", "text")
    once = usable.groupBy("content_sha").agg(F.min_by(F.struct("path", "title", "text"), "path").alias("d")).select("d.path", "d.title", "content_sha", "d.text")
    first = 0
    if before is not None:
        once = once.join(before.documents.select("content_sha"), "content_sha", "left_anti")
        first = before.documents.agg(F.coalesce(F.max("document_no") + 1, F.lit(0))).first()[0]
    documents = cut(numbered(cut(once), first).select("document_no", "path", "title", "content_sha", "text"))
    claims, names = claims_of(documents, before.entities if before is not None else None)
    return Stored(documents, cut(names), cut(claims))


def routed(claims: DataFrame) -> DataFrame:
    """Stored claims with risk, routing and reasons, each in the context of all."""
    return claims.join(routing.scored(claims.withColumn("vacuity", F.lit(0.0))), "claim_id")


def stored(spark: SparkSession, path: str, until: int | None = None) -> Stored:
    """All that the batches below ``path`` stored, or those before number ``until``."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    earlier = lambda df: (df if until is None else df.where(F.col("batch") < until)).drop("batch")
    return Stored(*[earlier(read(name)) for name in Stored._fields])


def write(files: DataFrame, path: str, number: int) -> None:
    """Ingest one batch of files under its number."""
    added = ingested(files, stored(files.sparkSession, path, number) if number else None)
    for name, table in zip(Stored._fields, added, strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def stream(spark: SparkSession, folder: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Ingest the files that come to ``folder``, those of a micro-batch at a time."""
    files = spark.readStream.schema(FILES).format("binaryFile").load(folder)
    return files.writeStream.foreachBatch(lambda batch, number: write(batch, path, number)).option("checkpointLocation", checkpoint)
