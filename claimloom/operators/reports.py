"""Report tables: macro scores, medians, contrasts, economics, sweeps, verdicts and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.operators import evals

#: Bands of a correlation's strength, rows that a report needs, bounds of the gate's tuning.
STRENGTH = ((0.6, "strong"), (0.35, "moderate"), (0.15, "weak"))
LEAST_ROWS = 10
ESCALATION, CLEAN = (0.08, 0.20), 0.08


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy_and_macro_f1(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Accuracy over all cases and the mean F1 of the labels, those without a case included as 0."""
    f1 = evals.per_class(cases, labels).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))
    return cases.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col("truth") == F.col("predicted")).cast("double")), F.lit(0.0)), 6).alias("accuracy")).join(F.broadcast(f1))


def median_and_p95(frame: DataFrame, value: str) -> DataFrame:
    """The whole part of the median (the mean of the middle two) and the lower 95th percentile, over non-null values."""
    keyed = frame.where(F.col(value).isNotNull()).select(F.lit(0).alias("_k"), value)
    steps = evals.running(keyed.groupBy("_k", value).agg(F.count("*").alias("_n")), [value], "_n")
    last = F.col("total") - 1
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("_n"))
    pick = lambda at: F.max(F.when(holds(at), F.col(value)))
    found = steps.agg(pick(F.floor(last / 2)).alias("a"), pick(F.ceil(last / 2)).alias("b"), pick(F.floor(0.95 * last)).alias("p95"), F.max("total").alias("n"))
    return found.select("n", ((F.col("a") + F.col("b")) / 2).cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"))


def quartile_bounds(frame: DataFrame, value: str) -> DataFrame:
    """Four (low, high) pairs of the values at positions ``int(q * n / 4)``; the last one ends at the largest."""
    steps = evals.running(frame.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), [value], "_n")
    at = lambda k: F.max(F.when((F.col("before") <= F.floor(F.col("total") * k / 4)) & (F.floor(F.col("total") * k / 4) < F.col("before") + F.col("_n")), F.col(value)))
    cuts = steps.agg(*[at(k).alias(f"c{k}") for k in range(4)], F.max(value).alias("c4"))
    return cuts.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("quartile"), F.col(f"c{k}").alias("low"), F.col(f"c{k + 1}").alias("high")) for k in range(4)])).alias("r")).select("r.*")


def quartile_contrast(table: DataFrame) -> DataFrame:
    """The top quartile's flip rate over the bottom's (null if that is 0), and both."""
    top, bottom = (F.max(F.when(F.col("quartile") == q, F.col("flip_rate"))) for q in (4, 1))
    return table.agg(top.alias("top"), bottom.alias("bottom"), F.round(F.when(bottom > 0, top / bottom), 6).alias("times"))


def worst_family(table: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """The family with the greatest flip rate, the first in order on a tie."""
    order = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    return table.agg(F.max_by("family", F.struct("flip_rate", -order)).alias("family"), F.max("flip_rate").alias("flip_rate"))


def economics(arms: DataFrame, calls: Column, all_calls: Column) -> DataFrame:
    """What the cascade recovers of the gain of asking always (1 if there is none), and the calls it saves."""
    gain = F.col("opinion_on_all") - F.col("classical")
    recovered = F.when(gain <= 0, F.lit(1.0)).otherwise((F.col("cascade") - F.col("classical")) / gain)
    return arms.select(F.round(recovered, 6).alias("recovered"), F.round(F.lit(1.0) - ratio(calls, all_calls), 6).alias("saved"))


def strength(rho: Column, n: Column, p: Column) -> Column:
    """A verdict on a correlation from its sign, significance and size."""
    word = F.lit("negligible")
    for bound, name in reversed(STRENGTH):
        word = F.when(F.abs(rho) >= bound, name).otherwise(word)
    sign = F.when(rho >= 0, "positive").otherwise("negative")
    return F.when(n < LEAST_ROWS, "too few rows").when(p >= 0.05, "not significant").otherwise(F.concat_ws(" ", word, sign))


def token_scores(tokens: DataFrame, nothing: str = "O") -> DataFrame:
    """Micro precision, recall and F1 of tags (predicted, gold) by token; ``O`` is no tag."""
    said, true = F.count_if(F.col("predicted") != nothing), F.count_if(F.col("gold") != nothing)
    hit = F.count_if((F.col("predicted") == F.col("gold")) & (F.col("gold") != nothing))
    return tokens.agg(F.round(ratio(hit, said), 6).alias("precision"), F.round(ratio(hit, true), 6).alias("recall"), F.round(ratio(2 * hit, said + true), 6).alias("f1"))


def span_scores_by_type(predicted: DataFrame, gold: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Exact spans by type: precision, recall and F1."""
    a, b = predicted.select(*keys, kind).distinct().withColumn("_p", F.lit(1)), gold.select(*keys, kind).distinct().withColumn("_g", F.lit(1))
    both = a.join(b, [*keys, kind], "full_outer").groupBy(kind).agg(F.count("_p").alias("p"), F.count("_g").alias("g"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("hit"))
    return both.select(kind, F.round(ratio(F.col("hit"), F.col("p")), 6).alias("precision"), F.round(ratio(F.col("hit"), F.col("g")), 6).alias("recall"), F.round(ratio(2 * F.col("hit"), F.col("p") + F.col("g")), 6).alias("f1"))


def relation_scores(examples: DataFrame, nothing: str = "NONE") -> DataFrame:
    """Micro scores of relations (predicted, gold) without the null class, and accuracy with it."""
    return token_scores(examples, nothing).join(F.broadcast(examples.agg(F.round(F.avg((F.col("predicted") == F.col("gold")).cast("double")), 6).alias("accuracy"))))


def document_coverage(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with gold triples, those of which a prediction hits one, and their share."""
    hit = gold.join(predicted.select("document_id", *keys).distinct(), ["document_id", *keys], "left_semi").select("document_id").distinct().withColumn("_hit", F.lit(1))
    every = gold.select("document_id").distinct().join(hit, "document_id", "left")
    return every.agg(F.count("*").alias("documents"), F.count("_hit").alias("covered"), F.round(ratio(F.count("_hit"), F.count("*")), 6).alias("share"))


def counters(claims: DataFrame, band: str, routing: str) -> DataFrame:
    """One row for each counter of a corpus: claims by band and by routing, and distinct parties."""
    by = lambda c: claims.groupBy(F.concat(F.lit(f"{c}:"), F.col(c)).alias("counter")).agg(F.count("*").alias("n"))
    parties = claims.select(F.explode(F.array("subject_id", "object_id")).alias("e")).agg(F.lit("entities").alias("counter"), F.count_distinct("e").alias("n"))
    return by(band).unionByName(by(routing)).unionByName(parties.select("counter", "n"))


def band_separation(frame: DataFrame, band: str, value: str, correct: Column) -> DataFrame:
    """By band: mean, whole median and accuracy; and for all whether means never fall, and the last less the first."""
    means = frame.groupBy(band).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))
    lower = evals.lower_percentile(frame, [band], value, 0.5).withColumnRenamed("p50", "median")
    one = W.partitionBy(F.lit(0))  # as many rows as bands
    falls = means.withColumn("_f", F.col("_m") < F.lag("_m").over(one.orderBy(band)))
    whole = one.orderBy(band).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = falls.withColumns({"monotonic": ~F.coalesce(F.max("_f").over(whole), F.lit(False)), "separation": F.round(F.last("_m").over(whole) - F.first("_m").over(whole), 6)})
    return marked.join(lower, band).select(band, "n", F.round("_m", 6).alias("mean"), "median", "accuracy", "monotonic", "separation")


def ablation_sweep(runs: DataFrame) -> DataFrame:
    """By edge count and mode: mean and largest change, shares that carry load, flips of routing and of relation."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return runs.groupBy("edge_count", "mode").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs("change")), 6).alias("mean_change"), F.round(F.max(F.abs("change")), 6).alias("max_change"),
        F.round(F.avg((F.abs("change") > 0.10).cast("double")), 6).alias("large"), rate("routing_changed").alias("flips"), rate("relation_changed").alias("relation_changes"),
    )


def smallest_load_bearing(runs: DataFrame) -> DataFrame:
    """The fewest masked edges that carry load for each claim; null where no run does."""
    return runs.groupBy("claim_id").agg(F.min(F.when(F.col("load_bearing"), F.col("edge_count"))).alias("edges"))


def tuned_thresholds(demo: DataFrame, clean: DataFrame, flags: list[float], escalations: list[float]) -> DataFrame:
    """The pair of thresholds of least penalty, the first in order on a tie; pairs outside the bounds are left out.

    ``demo`` and ``clean`` have risk. One pass over each; only the grid's sums meet.
    """
    grid = [(f, e) for f in flags for e in escalations if f < e]
    share = lambda test: F.avg(test.cast("double"))
    of = lambda name: [x for i, (f, e) in enumerate(grid) for x in (share(F.col("risk") >= e).alias(f"{name}e{i}"), share((F.col("risk") >= f) & (F.col("risk") < e)).alias(f"{name}f{i}"))]
    sums = demo.agg(*of("d")).join(F.broadcast(clean.agg(*of("c"))))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("flag"), F.lit(e).alias("escalate"), F.col(f"de{i}").alias("es"), F.col(f"df{i}").alias("fs"), F.col(f"ce{i}").alias("ces"), F.col(f"cf{i}").alias("cfs")) for i, (f, e) in enumerate(grid)])
    flat = sums.select(F.explode(cells).alias("r")).select("r.*").where(F.col("es").between(*ESCALATION) & (F.col("ces") <= CLEAN))
    over = lambda c, bound: F.greatest(F.col(c) - bound, F.lit(0.0))
    penalty = F.round(F.abs(F.col("es") - 0.13) + 0.25 * over("fs", 0.35) + 0.5 * over("cfs", 0.20), 9)
    return flat.withColumn("penalty", penalty).orderBy("penalty", "i").limit(1).select("flag", "escalate", F.round("penalty", 6).alias("penalty"))


def tuned_vacuity(cases: DataFrame, candidates: list[float], target: float = 0.13) -> DataFrame:
    """The vacuity threshold whose gate rate is nearest the target, the first on a tie."""
    sums = cases.agg(*[F.avg((F.col("vacuity") >= c).cast("double")).alias(f"r{i}") for i, c in enumerate(candidates)])
    flat = sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("vacuity"), F.col(f"r{i}").alias("rate")) for i, c in enumerate(candidates)])).alias("r")).select("r.*")
    return flat.orderBy(F.round(F.abs(F.col("rate") - target), 9), "i").limit(1).select("vacuity", F.round("rate", 6).alias("rate"))


def confusion_totals(matrix: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """A confusion matrix with the totals of its rows and, as a last row, of its columns."""
    rows = matrix.withColumn("total", sum((F.col(x) for x in labels), F.lit(0)))
    return rows.unionByName(rows.agg(F.lit("total").alias("truth"), *[F.sum(x).alias(x) for x in (*labels, "total")]))
