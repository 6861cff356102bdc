"""The claim feed: tenant scope, filters, keyset pages and lookups."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows on a page, at most and by default.
MOST_ROWS, ROWS = 100, 25
#: Columns that the feed sorts by.
SORTS = ("created_at", "confidence", "vacuity", "fragility")


def scoped(frame: DataFrame, org_id: int) -> DataFrame:
    """Rows of one tenant; the first step of every query on tenant data."""
    return frame.where(F.col("org_id") == org_id)


def scoped_child(child: DataFrame, parent: DataFrame, org_id: int, key: str) -> DataFrame:
    """Rows of a table without tenants, by way of its parent."""
    return child.join(scoped(parent, org_id).select(key), key, "left_semi")


def filtered(claims: DataFrame, relations=None, min_confidence=None, max_confidence=None, min_vacuity=None, entity=None, document=None, text=None, routing=None, resolved_by=None) -> DataFrame:
    """The feed's filters; those that are None do not apply. All reach the scan."""
    tests = [
        (relations, lambda v: F.col("relation").isin(*v)),
        (routing, lambda v: F.col("routing").isin(*v)),
        (resolved_by, lambda v: F.col("resolved_by") == v),
        (min_confidence, lambda v: F.col("confidence") >= v),
        (max_confidence, lambda v: F.col("confidence") <= v),
        (min_vacuity, lambda v: F.col("vacuity") >= v),
        (entity, lambda v: (F.col("subject_id") == v) | (F.col("object_id") == v)),
        (document, lambda v: F.col("document_id") == v),
        (text, lambda v: F.contains(F.lower("sentence_text"), F.lower(F.lit(v)))),
    ]
    for value, test in tests:
        if value is not None:
            claims = claims.where(test(value))
    return claims


def page(frame: DataFrame, sort: str, key: str = "claim_id", after: tuple | None = None, descending: bool = True, rows: int = ROWS) -> DataFrame:
    """The rows after the pivot ``(sort value, key)``; one more than asked, to tell if more follow."""
    if not 1 <= rows <= MOST_ROWS:
        raise ValueError(f"rows must be 1 to {MOST_ROWS}")
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    value = F.coalesce(F.col(sort), F.lit(0.0)) if sort == "fragility" else F.col(sort)
    if after is not None:
        pivot, last = F.lit(after[0]), F.lit(after[1])
        beyond = (value < pivot) | ((value == pivot) & (F.col(key) < last)) if descending else (value > pivot) | ((value == pivot) & (F.col(key) > last))
        frame = frame.where(beyond)
    order = [value.desc(), F.col(key).desc()] if descending else [value.asc(), F.col(key).asc()]
    return frame.orderBy(*order).limit(rows + 1)


def cursor(value, key) -> str:
    """An opaque pivot: unpadded base64url of a JSON object; a time is written in ISO form, a number in full."""
    timed = isinstance(value, datetime)
    return base64.urlsafe_b64encode(json.dumps({"v": value.isoformat() if timed else value, "t": timed, "id": key}).encode()).decode().rstrip("=")


def pivot(cursor: str) -> tuple:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return datetime.fromisoformat(found["v"]) if found.get("t") else found["v"], found["id"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError("malformed cursor") from e


def zero_filled(counts: DataFrame, key: str, domain: tuple[str, ...], value: str = "n") -> DataFrame:
    """Counts with a row for each value of a fixed domain."""
    spark = counts.sparkSession
    return spark.createDataFrame([(d,) for d in domain], f"{key} string").join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def stats(claims: DataFrame, tau: float = 0.625) -> DataFrame:
    return claims.agg(
        F.count("*").alias("n_claims"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"),
        F.count_if(F.col("vacuity") >= tau).alias("n_vacuous"),
    )


def per_document(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of each document, 0 where it has none."""
    counts = claims.groupBy("document_id").agg(F.count("*").alias("n_claims"))
    return documents.join(counts, "document_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)).cast("long"))


def best(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return frame.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def one_direction(claims: DataFrame) -> DataFrame:
    """Of claims that say the same of a pair both ways, the surest; the earlier one on a tie."""
    low, high = F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")
    return best(claims.withColumns({"_low": low, "_high": high}), ["document_id", "relation", "_low", "_high"], [F.desc("confidence"), F.asc("claim_id")]).drop("_low", "_high")


def touched_most(claims: DataFrame, n: int = 10) -> DataFrame:
    """Entities by the claims that touch them."""
    ends = claims.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("n_claims")).orderBy(F.desc("n_claims"), "entity_id").limit(n)
