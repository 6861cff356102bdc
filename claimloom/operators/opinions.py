"""Second opinions: prompt text and digests, and the parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import sanitized

#: Accepted decisions, longest rationale.
DECISIONS = ("auto_file", "flag", "escalate")
RATIONALE = 600


def prompt(citation: Column, relation: Column, confidence: Column, vacuity: Column, neighbours: Column, most: int = 8) -> Column:
    """A question about one claim; numbers to three digits, at most eight neighbours."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("citation: "), sanitized(citation)),
        F.concat(F.lit("relation: "), relation),
        F.format_string("confidence: %.3f vacuity: %.3f", confidence, vacuity),
        F.concat(F.lit("context: "), F.array_join(F.slice(neighbours, 1, most), "; ")),
    )


def digest(system: str, user: Column) -> Column:
    return F.sha2(F.concat(F.lit(system + "\n\n"), user), 256)


def degraded_digest(claim_id: Column) -> Column:
    """The digest that stands for a question which was never asked."""
    return F.sha2(F.concat(F.lit("degraded:"), claim_id.cast("string")), 256)


def parsed(raw: Column) -> Column:
    """decision, rationale and confidence of an answer that may stand in a fence or between other text; null if invalid."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "decision string, rationale string, confidence double")
    valid = got["decision"].isin(*DECISIONS) & F.length(got["rationale"]).between(1, RATIONALE) & got["confidence"].between(0.0, 1.0)
    return F.when(valid, got)


def answers(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Every request with its parsed answer; one without a valid answer is degraded."""
    got = raw.select("claim_id", parsed(F.col("raw")).alias("a"))
    return requests.join(got, "claim_id", "left").select("claim_id", F.col("a.decision").alias("decision"), F.col("a.rationale").alias("rationale"), F.col("a").isNull().alias("degraded"))


def neighbours(edges: DataFrame, most: int = 8) -> DataFrame:
    """Sorted distinct context lines of each node."""
    both = edges.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node"), F.format_string("%d %s %d", "subject_id", "relation", "object_id").alias("line"))
    return both.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("line")), 1, most).alias("lines"))
