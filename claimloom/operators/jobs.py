"""Ingest jobs, stored snapshots and sinks that can be repeated: each function gives the table as it is to be stored.

Null keys are no keys: rows with one are kept as they are. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The states of a job in order; the last two are final.
STATES = ("queued", "extracting", "tagging", "resolving", "relating", "routing", "done", "failed")
STAGES, FINAL = STATES[1:6], STATES[6:]


def active(jobs: DataFrame) -> DataFrame:
    """Jobs that are neither done nor failed."""
    return jobs.where(~F.col("state").isin(*FINAL))


def with_stages(jobs: DataFrame, progress: str = "progress") -> DataFrame:
    """Jobs with a number for each stage, 0 where ``progress`` (a map) has none, and the mean over all as ``ratio``."""
    filled = [F.coalesce(F.try_element_at(progress, F.lit(s)), F.lit(0.0)).alias(s) for s in STAGES]
    out = jobs.select(*[c for c in jobs.columns if c != progress], *filled)
    return out.withColumn("ratio", sum((F.col(s) for s in STAGES), F.lit(0.0)) / len(STAGES))


def next_state(state: Column, succeeded: Column) -> Column:
    """The state after the one at hand has succeeded or not; final states stay."""
    order = F.array(*[F.lit(s) for s in STATES])
    on = F.element_at(order, (F.array_position(order, state) + 1).cast("int"))
    return F.when(state.isin(*FINAL), state).when(succeeded, on).otherwise("failed")


def may_retry(state: Column) -> Column:
    """Only a job that has come to its end may be run again."""
    return state.isin(*FINAL)


def documents_of_job(jobs: DataFrame, documents: DataFrame, job_id: int) -> DataFrame:
    """The documents of one job in the order in which they were received."""
    ids = jobs.where(F.col("job_id") == job_id).select(F.explode("doc_ids").alias("document_id")).distinct()
    return documents.join(ids, "document_id", "left_semi").orderBy("received_at", "document_id")


def computed_once(frame: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``frame`` with what ``compute`` makes of each different text, worked out once for each digest.

    ``compute`` gets digest and text and returns digest with columns of its own.
    """
    keyed = frame.withColumn("digest", F.sha2(text, 256))
    once = keyed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.any_value(text).alias(text))
    return keyed.join(compute(once), "digest", "left")


def from_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (claim_id, digest) with the stored answer of their digest, and those without one."""
    known = cache.dropDuplicates(["digest"])
    return requests.join(known, "digest"), requests.join(known.select("digest"), "digest", "left_anti")


def replaced_claims(claims: DataFrame, runs: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with those of ``documents`` replaced by ``new``, and runs without those of the claims that went."""
    ids = documents.select("document_id").distinct()
    gone = claims.join(ids, "document_id", "left_semi").select("claim_id")
    return claims.join(ids, "document_id", "left_anti").unionByName(new), runs.join(gone, "claim_id", "left_anti")


def replaced_trials(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Trials with those of the claims in ``new`` replaced; vacuous ones are not stored."""
    return stored.join(new.select("claim_id").distinct(), "claim_id", "left_anti").unionByName(new.where("NOT vacuous").drop("vacuous"))


def rebuilt_cases(stored: DataFrame, new: DataFrame, org_id: int, split: str) -> DataFrame:
    """Cases with one tenant's split replaced."""
    return stored.where(~((F.col("org_id") == org_id) & (F.col("split") == split))).unionByName(new)


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """A log with more rows; nothing in it is ever changed."""
    return log.unionByName(rows, allowMissingColumns=True)


def with_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots with ``new`` ones; a current one ends its tenant's earlier. A repeated (org_id, key) is an error."""
    if new.where("key IS NOT NULL").join(snapshots, ["org_id", "key"], "left_semi").limit(1).count():
        raise ValueError("the idempotency key is taken")
    ends = new.where("is_current").select("org_id", F.lit(True).alias("_ends")).distinct()
    kept = snapshots.join(ends, "org_id", "left").withColumn("is_current", F.col("is_current") & F.col("_ends").isNull()).drop("_ends")
    return kept.unionByName(new)


def replayed(snapshots: DataFrame, key: str) -> DataFrame:
    """The stored result of a key: its post snapshot with the last baseline at or before it; empty for a new key."""
    post = snapshots.where((F.col("key") == key) & (F.col("label") == "post")).select("org_id", "created_at", F.col("ece").alias("after"), "n_cases")
    base = snapshots.where("label = 'baseline'").select("org_id", F.col("created_at").alias("at"), F.col("ece").alias("before"))
    met = post.join(base, "org_id").where(F.col("at") <= F.col("created_at"))
    return met.groupBy("org_id", "created_at", "after", "n_cases").agg(F.max_by("before", "at").alias("before"))


def improvement(before: Column, after: Column) -> tuple[Column, Column]:
    """The change and the change relative to before (0 if that is 0), to four digits."""
    change = after - before
    return F.round(change, 4), F.round(F.coalesce(F.try_divide(change, F.abs(before)), F.lit(0.0)), 4)


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Snapshots by time; of one time the baseline first."""
    return snapshots.orderBy("created_at", F.when(F.col("label") == "baseline", 0).otherwise(1))


def purged(tables: dict[str, DataFrame], org_id: int, children: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Tables without a tenant's rows. ``children`` names for tables without org_id the parent and its key."""
    out = {}
    for name, frame in tables.items():
        if name in children:
            parent, key = children[name]
            out[name] = frame.join(tables[parent].where(F.col("org_id") == org_id).select(key), key, "left_anti")
        else:
            out[name] = frame.where(~F.col("org_id").eqNullSafe(F.lit(org_id)))
    return out


def latest(frame: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def newest(frame: DataFrame, key: str, value, at: str, most: int = 20) -> DataFrame:
    """The newest rows of one key."""
    return frame.where(F.col(key) == value).orderBy(F.desc(at)).limit(most)


def manifest(frame: DataFrame) -> DataFrame:
    """Rows as lines of JSON."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("line"))
