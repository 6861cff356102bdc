"""Rule-based risk routing, the uncertainty gate and the cascade with second opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import graph

#: Base risks, additions, thresholds.
BASE = {"OWNED_BY": 0.45, "WIRED_FUNDS_TO": 0.35, "SHARES_ADDRESS_WITH": 0.30, "SIGNATORY_OF": 0.25, "INVOICED": 0.15}
IN_CYCLE, SHARED, COSIGNED, KINDS = 0.30, 0.15, 0.15, 0.10
ESCALATE, FLAG = 0.80, 0.60
GATE_VACUITY, GATE_DISSONANCE, GATE_CONFIDENCE = 0.625, 0.35, 0.75


def pair(a: str = "subject_id", b: str = "object_id") -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def relation_kinds(claims: DataFrame) -> DataFrame:
    """Distinct relations of each unordered pair."""
    return claims.groupBy(*pair()).agg(F.count_distinct("relation").alias("kinds"))


def shared_pairs(claims: DataFrame) -> DataFrame:
    return claims.where("relation = 'SHARES_ADDRESS_WITH'").select(*pair()).distinct()


def cosigned_pairs(claims: DataFrame) -> DataFrame:
    """Pairs of organisations that one signatory signs for."""
    signed = claims.where("relation = 'SIGNATORY_OF'").select("subject_id", F.col("object_id").alias("org")).distinct()
    return signed.alias("a").join(signed.alias("b"), "subject_id").where("a.org < b.org").select(F.col("a.org").alias("low"), F.col("b.org").alias("high")).distinct()


def cosigned_among(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Those of ``pairs`` (low, high) that one signatory signs for, without the pairs of a signatory of very many."""
    signed = claims.where("relation = 'SIGNATORY_OF'").select("subject_id", "object_id").distinct()
    one = pairs.where("low < high").join(signed.withColumnRenamed("object_id", "low"), "low")
    return one.join(signed.withColumnRenamed("object_id", "high"), ["subject_id", "high"], "left_semi").select("low", "high").distinct()


def additions(keyed: DataFrame, claims: DataFrame, members: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``keyed`` (subject_id, object_id, relation and more) with ``added`` (what its relation and the context of all ``claims`` give) and ``reasons``.

    ``members`` has the nodes on cycles by relation. A claim whose two ends are members of
    the same relation's cycles gets the cycle's addition once, whatever its own relation is. Rows whose pair ``claims`` do not have
    are left out, or with ``how`` "left" kept.
    """
    rows = keyed.withColumns({"low": F.least("subject_id", "object_id"), "high": F.greatest("subject_id", "object_id")})
    if members is None:
        members = graph.cycle_members(graph.grouped_edges(graph.routing_by_confidence(claims)))
    # Ownership comes first where both ends are members of either.
    loops = members.groupBy("node").agg(F.max(F.col("relation") == "OWNED_BY").alias("owns"), F.max(F.col("relation") == "WIRED_FUNDS_TO").alias("funds"))
    ends = lambda c: loops.select(F.col("node").alias(c), F.struct("owns", "funds").alias(f"{c}_in"))
    pairs = claims.groupBy(*pair()).agg(F.count_distinct("relation").alias("kinds"), F.max(F.col("relation") == "SHARES_ADDRESS_WITH").alias("shared"))
    context = pairs.join(cosigned_among(pairs.select("low", "high"), claims).withColumn("cosigned", F.lit(True)), ["low", "high"], "left")
    joined = rows.join(ends("subject_id"), "subject_id", "left").join(ends("object_id"), "object_id", "left").join(context, ["low", "high"], how)
    both = lambda k: F.coalesce(F.col(f"subject_id_in.{k}") & F.col(f"object_id_in.{k}"), F.lit(False))
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[F.col("relation")], F.lit(0.15))
    tests = [
        ("ownership_cycle", IN_CYCLE, both("owns")),
        ("funds_cycle", IN_CYCLE, both("funds") & ~both("owns")),
        ("shared_address", SHARED, F.coalesce("shared", F.lit(False)) & (F.col("relation") != "SHARES_ADDRESS_WITH")),
        ("common_signatory", COSIGNED, F.coalesce("cosigned", F.lit(False))),
        ("multi_relation", KINDS, F.col("kinds") >= 3),
    ]
    added = sum((F.when(t, F.lit(v)).otherwise(0.0) for _, v, t in tests), base)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, _, t in tests])), ",")
    return joined.select(*keyed.columns, added.alias("added"), reasons.alias("reasons"))


def raw_risk(added: Column, confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), added * (0.5 + 0.5 * confidence)))


def by_risk(raw: Column) -> Column:
    return F.when(raw >= ESCALATE, "escalate").when(raw >= FLAG, "flag").otherwise("auto_file")


def scored(claims: DataFrame, members: DataFrame | None = None, digits: int = 4, changed: DataFrame | None = None, key: str = "claim_id") -> DataFrame:
    """``key``, risk, routing and reasons of each claim in the context of all, as ``additions`` gives it.

    ``changed`` are claims (subject_id, object_id, relation, confidence and ``key``) to route instead, such as one claim at
    several confidences, in the fixed context of ``claims``.
    """
    keyed = claims if changed is None else changed
    rows = additions(keyed.select(*dict.fromkeys([key, "subject_id", "object_id", "relation", "confidence"])), claims, members)
    return rows.withColumn("raw", raw_risk(F.col("added"), F.col("confidence"))).select(key, F.round("raw", digits).alias("risk"), by_risk(F.col("raw")).alias("routing"), "reasons")


def gate_reason(routing: Column) -> Column:
    """Why a claim goes to a second opinion; ``none`` if it does not. The first reason wins."""
    return F.when(F.col("vacuity") >= GATE_VACUITY, "vacuity").when(F.col("dissonance") >= GATE_DISSONANCE, "dissonance").when((routing == "escalate") & (F.col("confidence") < GATE_CONFIDENCE), "low_confidence").otherwise("none")


def cascade(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims (with routing and gate) after second opinions: gated ones take the decision unless it is degraded or missing."""
    joined = claims.join(decisions, "claim_id", "left")
    took = (F.col("gate") != "none") & F.col("decision").isNotNull() & ~F.coalesce("degraded", F.lit(True))
    return joined.select(
        "claim_id",
        F.col("routing").alias("classical"),
        F.when(took, F.col("decision")).otherwise(F.col("routing")).alias("routing"),
        F.when(took, "second_opinion").otherwise("classical").alias("resolved_by"),
        ((F.col("gate") != "none") & ~took).alias("degraded"),
    )
