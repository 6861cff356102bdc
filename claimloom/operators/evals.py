"""Evaluation: calibration, confusion, cascade arms, fragility, rank statistics and sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from claimloom.functions import trust
from claimloom.sources.durable import cut

BINS = 10
#: Weights of a flip, a loss and a change of confidence in a trial's instability.
FLIP, LOSS, CHANGE = 0.5, 0.3, 0.2


def reliability_bins(cases: DataFrame, confidence: Column, correct: Column) -> DataFrame:
    """Ten rows: size, mean confidence and accuracy of each tenth; a confidence of 1 is in the last."""
    tenth = F.least(F.floor(confidence * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    found = cases.select(tenth, confidence.alias("c"), correct.cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("conf"), F.avg("y").alias("acc"))
    every = cases.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("conf"), zero("acc"))


def calibration_error(cases: DataFrame, confidence: Column, correct: Column) -> DataFrame:
    """Expected and maximum calibration error and the Brier score."""
    tenth = F.least(F.floor(confidence * BINS), F.lit(BINS - 1)).alias("bin")
    y = correct.cast("double")
    parts = cases.select(tenth, confidence.alias("c"), y.alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("conf"), F.avg("y").alias("acc"), F.sum((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))).alias("squares"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    return parts.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("squares") / F.sum("n"), 6).alias("brier"))


def confusion(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """A row for each true label, a column for each predicted one, zeros included."""
    found = cases.groupBy("truth").pivot("predicted", list(labels)).count()
    every = cases.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    return every.join(found, "truth", "left").select("truth", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in labels])


def per_class(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1 and support; 0 where a denominator is."""
    marks = cases.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("truth") == x).alias("t"), (F.col("predicted") == x).alias("p")) for x in labels])).alias("m"))
    sums = marks.groupBy("m.label").agg(F.count_if(F.col("m.t") & F.col("m.p")).alias("hit"), F.count_if("m.p").alias("said"), F.count_if("m.t").alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        "label",
        F.round(ratio(F.col("hit"), F.col("said")), 6).alias("precision"),
        F.round(ratio(F.col("hit"), F.col("support")), 6).alias("recall"),
        F.round(ratio(2 * F.col("hit"), F.col("said") + F.col("support")), 6).alias("f1"),
        "support",
    )


def arms(cases: DataFrame) -> DataFrame:
    """Accuracy of the cascade, of classical routing and of second opinions on all (the cascade's where there is none)."""
    hit = lambda c: F.round(F.avg((c == F.col("truth")).cast("double")), 6)
    return cases.agg(
        F.count("*").alias("n"),
        hit(F.col("predicted")).alias("cascade"),
        hit(F.coalesce("classical", "predicted")).alias("classical"),
        hit(F.coalesce("opinion", "predicted")).alias("opinion_on_all"),
    )


def instability() -> Column:
    parts = FLIP * F.col("flipped").cast("double") + LOSS * F.col("lost").cast("double") + CHANGE * F.least(F.abs("delta"), F.lit(1.0))
    return F.least(parts, F.lit(1.0))


def fragility(trials: DataFrame) -> DataFrame:
    return trials.groupBy("claim_id").agg(F.round(F.avg(instability()), 6).alias("fragility"))


def by_family(trials: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return trials.groupBy("family").agg(F.count("*").alias("n"), rate("flipped").alias("flip_rate"), F.round(F.avg(F.least(F.abs("delta"), F.lit(1.0))), 6).alias("mean_change"), rate("lost").alias("loss_rate"))


def running(steps: DataFrame, order: list[str], value: str) -> DataFrame:
    """``steps`` with ``before``, the sum of ``value`` over all rows before in ``order``, and ``total``.

    Rows are dealt by ranges of the order; only one sum for each range meets in one place, so
    no task sorts them all.
    """
    dealt = cut(steps.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    one = W.partitionBy(F.lit(0))
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(one.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_sum").over(one).alias("total"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inner", inner).join(F.broadcast(bases), "_range").withColumn("before", F.col("_base") + F.col("_inner")).drop("_range", "_inner", "_base")


def rank_quartile(frame: DataFrame, value: str) -> DataFrame:
    """Quartile by the lowest position among equals: ties stay together, unlike ``ntile``.

    Positions come from counts of distinct values, so no task sorts all rows.
    """
    steps = running(frame.groupBy(value).agg(F.count("*").alias("_n")), [value], "_n")
    placed = steps.select(value, F.least(F.floor(4 * F.col("before") / F.col("total")) + 1, F.lit(4)).cast("int").alias("quartile"))
    return frame.join(placed, value)


def quartile_table(trials: DataFrame) -> DataFrame:
    """By quartile of vacuity: claims, their mean fragility, and flips among their trials."""
    claims = trials.groupBy("claim_id", "vacuity").agg(F.avg(instability()).alias("fragility"), F.count("*").alias("n_trials"), F.count_if("flipped").alias("n_flips"))
    return rank_quartile(claims, "vacuity").groupBy("quartile").agg(
        F.count("*").alias("n"), F.round(F.avg("fragility"), 6).alias("mean_fragility"), F.round(F.sum("n_flips") / F.sum("n_trials"), 6).alias("flip_rate")
    )


def correlations(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman with mid-ranks; 0 below three rows or for a constant column."""

    def ranked(column: str) -> DataFrame:
        steps = running(frame.groupBy(column).agg(F.count("*").alias("_n")), [column], "_n")
        return steps.select(column, (F.col("before") + (F.col("_n") + 1) / 2).alias(f"_{column}"))

    both = frame.select(x, y).join(ranked(x), x).join(ranked(y), y)

    def r(a: str, b: str) -> Column:
        value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        return F.round(F.when(F.count("*") >= 3, F.coalesce(value, F.lit(0.0))).otherwise(0.0), 6)

    return both.agg(F.count("*").alias("n"), r(x, y).alias("pearson"), r(f"_{x}", f"_{y}").alias("spearman"))


def p_value(rho: float, n: int) -> float:
    """Two-sided tail of Student's t for a correlation of ``n`` rows, at 1e-12 least."""
    if n < 3 or abs(rho) >= 1:
        return 1.0 if n < 3 else 1e-12
    return max(1e-12, min(1.0, t_tail(rho * rho / (1 - rho * rho), n - 2)))


def t_tail(u: float, df: int) -> float:
    """P(t * t > u * df) for Student's t: the regularised incomplete beta of df / 2 and 1/2 at 1 / (1 + u).

    Powers and the ratio of gamma functions are taken from their logarithms' small parts, so that no digits
    are lost where df is large; the continued fraction needs about sqrt(df) terms.
    """
    if u <= 0:
        return 1.0
    a, b, x, y = df / 2, 0.5, 1 / (1 + u), u / (1 + u)
    front = math.exp(-a * math.log1p(u)) * math.sqrt(y / math.pi) * _gamma_ratio(a)  # x^a y^(1/2) / B(a, 1/2)
    if (a + b) * y > b:
        return front / _fraction(x, y, a, b)
    return 1 - front / _fraction(y, x, b, a)


def _gamma_ratio(a: float) -> float:
    """Gamma(a + 1/2) / Gamma(a)."""
    if a < 40:
        return math.gamma(a + 0.5) / math.gamma(a)
    z = 1 / a
    return math.sqrt(a) * (1 - z / 8 + z**2 / 128 + 5 * z**3 / 1024 - 21 * z**4 / 32768 - 399 * z**5 / 262144 + 869 * z**6 / 4194304)


def _fraction(x: float, y: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta for x + y = 1, by Lentz's method, until a factor is 1.

    Its terms hold a - (a + b) x as (a + b) y - b, so that nothing cancels where x is close to 1.
    """
    tiny, m = 1e-300, 0

    def terms(m: int) -> tuple[float, float]:
        at = a + 2 * m
        top = (a + m - 1) * (a + b + m - 1) * m * (b - m) * x * x / (at - 1) ** 2 if m else 0.0
        return top, m + (m * (b - m) * x / (at - 1) if m else 0.0) + (a + m) * ((a + b) * y - b + 1 + m * (1 + y)) / (at + 1)

    value = c = terms(0)[1] or tiny
    d = 0.0
    while True:
        m += 1
        top, bottom = terms(m)
        d = 1 / (bottom + top * d or tiny)
        c = bottom + top / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            return value


def lower_percentile(frame: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at position int(share * (n - 1)) of each group, not interpolated; from counts of distinct values."""
    steps = running(frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), [*keys, value], "_n")
    groups = steps.groupBy(*keys).agg(F.min("before").alias("_base"), F.sum("_n").alias("_all"))
    placed = steps.join(groups, keys) if keys else steps.crossJoin(F.broadcast(groups))  # one row without keys
    at = F.floor(share * (F.col("_all") - 1))
    from_base = F.col("before") - F.col("_base")
    return placed.where((from_base <= at) & (at < from_base + F.col("_n"))).select(*keys, F.col(value).alias(f"p{round(share * 100)}"))


def correlation_test(frame: DataFrame, x: str, y: str) -> DataFrame:
    """``correlations`` with the two-sided p-value of Spearman's, from one row of statistics."""
    p = F.udf(p_value, DoubleType())
    return correlations(frame, x, y).withColumn("p_value", F.round(p("spearman", "n"), 12))


def trend(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line; null for a constant x or fewer than two rows."""
    fine = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return fine.agg(F.round(slope, 6).alias("slope"), F.round(F.avg(y) - slope * F.avg(x), 6).alias("intercept"))


def hard_negatives(cases: DataFrame, least: float = 0.70) -> DataFrame:
    """Sure classical outcomes that a second opinion overruled."""
    return cases.where((F.col("resolved_by") == "second_opinion") & F.col("classical").isNotNull() & (F.col("classical") != F.col("routing")) & (F.col("confidence") >= least))


def threshold_sweep(scored: DataFrame, flags: list[float], escalations: list[float], target: float = 0.13) -> DataFrame:
    """Shares of outcomes and a penalty for each pair of thresholds, in one pass over the claims."""
    grid = [(f, e) for f in flags for e in escalations if f < e]
    sums = [x for i, (f, e) in enumerate(grid) for x in (F.avg((F.col("risk") >= e).cast("double")).alias(f"e{i}"), F.avg(((F.col("risk") >= f) & (F.col("risk") < e)).cast("double")).alias(f"f{i}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(e).alias("escalate"), F.col(f"f{i}").alias("flag_share"), F.col(f"e{i}").alias("escalate_share")) for i, (f, e) in enumerate(grid)]))
    flat = scored.agg(*sums).select(rows.alias("r")).select("r.*")
    penalty = F.abs(F.col("escalate_share") - target) + 0.25 * F.greatest(F.col("flag_share") - 0.35, F.lit(0.0))
    return flat.select("flag", "escalate", F.round("flag_share", 6).alias("flag_share"), F.round("escalate_share", 6).alias("escalate_share"), F.round(penalty, 6).alias("penalty"))


def latest_as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left``: both in one sorted stream by key."""
    marked = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_left", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy(at, "_left").rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")


def fitted_temperature(logits: DataFrame, target: str, grid: int = 32, rounds: int = 3) -> float:
    """The temperature (0.25 to 5) of least softmax cross-entropy, by ever finer grids on its logarithm.

    Each round sums the losses at all temperatures of its grid, as columns of numbers inside the tasks; one row of sums leaves
    each task. As the loss has one minimum, the next grid lies between the neighbours of the least. A case whose target is
    none of its six values has no loss and does not count.
    """
    cases = cut(logits.where(F.size("z") == 6).select("z", F.col(target).alias("target")).where("target BETWEEN 0 AND 5 AND NOT exists(z, x -> x IS NULL)"))

    def summed(points: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, np.zeros(len(points))
            for batch in batches:
                z = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 6)
                own = z[np.arange(len(z)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)]
                top = z.max(axis=1, initial=-np.inf)
                below = z - top[:, None]
                n += len(z)
                sums += [(np.log(np.exp(below / math.exp(p)).sum(axis=1)) + (top - own) / math.exp(p)).sum() for p in points]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(sums), pa.array([n] * len(points), pa.int64())], names=["k", "loss", "n"])

        return losses

    low, high = math.log(0.25), math.log(5.0)
    for _ in range(rounds):
        points = [low + (high - low) * k / grid for k in range(grid + 1)]
        sums = cases.mapInArrow(summed(points), "k int, loss double, n long").groupBy("k").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        found = {r.k: r.loss / r.n for r in sums.where("n > 0").collect()}  # one row for each point
        if not found:
            return 1.0
        best = min(range(grid + 1), key=found.__getitem__)
        low, high = points[max(0, best - 1)], points[min(grid, best + 1)]
    return round(math.exp((low + high) / 2), 3)


def span_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of exact spans: rows of both sides that agree on ``keys``."""
    a, b = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = a.join(b, keys, "full_outer").agg(F.count("_p").alias("p"), F.count("_g").alias("g"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("hit"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return both.select("hit", ratio(F.col("hit"), F.col("p")).alias("precision"), ratio(F.col("hit"), F.col("g")).alias("recall"), ratio(2 * F.col("hit"), F.col("p") + F.col("g")).alias("f1"))


def class_weights(frame: DataFrame, label: str, most: float = 4.0) -> DataFrame:
    """Inverse root frequency of each class, relative to an even share, capped."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    one = W.partitionBy(F.lit(0))
    return counts.select(label, F.round(F.least(F.lit(most), F.sqrt(F.sum("n").over(one) / (F.count("*").over(one) * F.col("n")))), 6).alias("weight"))


def band_summary(frame: DataFrame, band: str, value: str, confidence: str) -> DataFrame:
    """By band: size, mean, 90th lower percentile, mean confidence, and whether the mean is no less than the band's before."""
    ninth = lower_percentile(frame, [band], value, 0.9)
    means = frame.groupBy(band).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.round(F.avg(confidence), 6).alias("mean_confidence"))
    rises = F.coalesce(F.col("_m") >= F.lag("_m").over(W.partitionBy(F.lit(0)).orderBy(band)), F.lit(True))
    return means.join(ninth, band).select(band, "n", F.round("_m", 6).alias("mean"), "p90", "mean_confidence", rises.alias("rises"))


def recalibrated(cases: DataFrame, negatives: DataFrame, current: float) -> DataFrame:
    """Calibration (ece, mce, brier) at the current temperature and at the one fitted on the hard negatives, as two rows.

    ``cases`` have z and target. Without negatives, or where the fit gives the current
    temperature, the second row is the first one's: nothing is measured anew.
    """
    fitted = current if negatives.isEmpty() else fitted_temperature(negatives, "target")

    def measured(t: float) -> DataFrame:
        e = cases.select("target", trust.evidence(trust.at_temperature(F.col("z"), t)).alias("e"))
        return calibration_error(e, trust.confidence(F.col("e")), F.array_position("e", F.array_max("e")) - 1 == F.col("target"))

    before = cut(measured(current))
    after = before if fitted == current else measured(fitted)
    return before.select(F.lit("baseline").alias("label"), F.lit(current).alias("temperature"), "*").unionByName(after.select(F.lit("post").alias("label"), F.lit(fitted).alias("temperature"), "*"))
