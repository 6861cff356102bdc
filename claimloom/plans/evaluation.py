"""Registered queries on evaluation, calibration and ablation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import trust
from claimloom.operators import ablation, answers, evals, extraction, fuzz, reports, routing, views
from claimloom.plans import catalog as C
from claimloom.plans import fixtures as X
from claimloom.plans.fixtures import ABLATIONS, BUCKETS, CASES, CLAIMS, GOLD, RUNS, TRIALS, table
from claimloom.plans.registry import query
from claimloom.sources.durable import cut

ROUTED = C.ROUTED


@query(f"WITH {CLAIMS} SELECT r.resolver, count(claim_id) AS n FROM (VALUES ('classical'), ('second_opinion'), ('manual')) r(resolver) LEFT JOIN (SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN 'second_opinion' ELSE 'classical' END AS resolver FROM claims) c USING (resolver) GROUP BY 1")
def claims_by_resolver(spark, sf_dir):
    from claimloom.operators import feed

    resolver = F.when(F.col("claim_id") % 3 == 0, "second_opinion").otherwise("classical")
    return feed.zero_filled(X.claims(spark, sf_dir).groupBy(resolver.alias("resolver")).agg(F.count("*").alias("n")), "resolver", ("classical", "second_opinion", "manual"))


@query("SELECT count(*) AS documents FROM documents")
def document_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))


MIDDLE = "list_sort(list({0}))[CAST(floor((count(*) - 1) / 2.0) AS BIGINT) + 1] + list_sort(list({0}))[CAST(ceil((count(*) - 1) / 2.0) AS BIGINT) + 1]"


@query(f"WITH {CLAIMS}, {RUNS} SELECT count(*) AS n, CAST(floor(({MIDDLE.format('latency_ms')}) / 2.0) AS BIGINT) AS p50, CAST(list_sort(list(latency_ms))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS BIGINT) AS p95 FROM runs WHERE NOT degraded")
def latency_of_runs(spark, sf_dir):
    return reports.median_and_p95(X.runs(spark, sf_dir).where("NOT degraded"), "latency_ms")


@query(C.SQL["per_class_prf"].replace("SELECT label, round", ", f AS (SELECT label, round").rstrip() + ") SELECT (SELECT count(*) FROM cases) AS n, (SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) FROM cases) AS accuracy, round(avg(f1), 4) AS macro_f1 FROM f")
def accuracy_and_macro_f1(spark, sf_dir):
    return reports.accuracy_and_macro_f1(X.eval_cases(spark, sf_dir), BUCKETS)


@query(f"WITH {CLAIMS}, s AS (SELECT list_sort(list(vacuity)) AS v, count(*) AS n FROM claims) SELECT CAST(q AS INTEGER) AS quartile, v[CAST(floor(n * (q - 1) / 4.0) AS BIGINT) + 1] AS low, v[CASE WHEN q = 4 THEN n ELSE CAST(floor(n * q / 4.0) AS BIGINT) + 1 END] AS high FROM s, range(1, 5) r(q)")
def quartile_bounds(spark, sf_dir):
    return reports.quartile_bounds(X.claims(spark, sf_dir), "vacuity")


@query(C.SQL["vacuity_quartiles"].replace("SELECT CAST(quartile", ", t AS (SELECT CAST(quartile") + ") SELECT max(flip_rate) FILTER (quartile = 4) AS top, max(flip_rate) FILTER (quartile = 1) AS bottom, round(max(flip_rate) FILTER (quartile = 4) / max(flip_rate) FILTER (quartile = 1), 6) AS times FROM t")
def quartile_contrast(spark, sf_dir):
    return reports.quartile_contrast(evals.quartile_table(X.trials(spark, sf_dir)))


@query(C.SQL["perturbation_stats"].replace("SELECT family", ", t AS (SELECT family") + ") SELECT family, flip_rate FROM t ORDER BY flip_rate DESC, list_position(['synonym','rename','boilerplate','reorder','punctuation'], family) LIMIT 1")
def worst_family(spark, sf_dir):
    return reports.worst_family(evals.by_family(X.trials(spark, sf_dir)), X.FAMILIES)


@query(C.SQL["cascade_arms"].replace("SELECT count(*) AS n", ", z AS (SELECT count(*) AS n") + ") SELECT round(CASE WHEN opinion_on_all <= classical THEN 1.0 ELSE (cascade - classical) / (opinion_on_all - classical) END, 6) AS recovered, 0.75 AS saved FROM z")
def cascade_economics(spark, sf_dir):
    name = F.array(*[F.lit(b) for b in BUCKETS])
    cases = X.eval_cases(spark, sf_dir).withColumns({"classical": F.when(F.col("claim_id") % 3 > 0, name[(F.col("claim_id") % 4 % 3).cast("int")]), "opinion": F.when(F.col("claim_id") % 5 == 0, F.col("truth"))})
    return reports.economics(evals.arms(cases), F.lit(10), F.lit(40))


TAGS = "tags AS (SELECT CASE claim_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-ORG' ELSE 'I-ORG' END AS predicted, CASE claim_id % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-ORG' ELSE 'I-ORG' END AS gold FROM claims)"
SCORED_TAGS = "round(h / s, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (s + t), 6) AS f1"
COUNTED = "count(*) FILTER (predicted <> '{0}') AS s, count(*) FILTER (gold <> '{0}') AS t, count(*) FILTER (gold <> '{0}' AND gold = predicted) AS h"


def _tags(spark, sf_dir):
    pick = lambda n: F.when(F.col("claim_id") % n == 0, "O").when(F.col("claim_id") % n == 1, "B-ORG").otherwise("I-ORG")
    return X.claims(spark, sf_dir).select(pick(3).alias("predicted"), pick(4).alias("gold"))


@query(f"WITH {CLAIMS}, {TAGS} SELECT {SCORED_TAGS} FROM (SELECT {COUNTED.format('O')} FROM tags)")
def token_scores(spark, sf_dir):
    return reports.token_scores(_tags(spark, sf_dir))


@query(f"WITH {CLAIMS}, {TAGS} SELECT {SCORED_TAGS}, accuracy FROM (SELECT {COUNTED.format('O')}, round(avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM tags)")
def relation_scores(spark, sf_dir):
    return reports.relation_scores(_tags(spark, sf_dir), "O")


@query(f"WITH {CLAIMS}, p AS (SELECT DISTINCT document_id, subject_id, relation FROM claims WHERE claim_id % 3 > 0), g AS (SELECT DISTINCT document_id, subject_id, relation FROM claims WHERE claim_id % 4 > 0), h AS (SELECT relation, count(*) AS h FROM (SELECT * FROM p INTERSECT SELECT * FROM g) GROUP BY 1) SELECT relation, round(h / s, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (s + t), 6) AS f1 FROM (SELECT relation, count(*) AS s FROM p GROUP BY 1) JOIN (SELECT relation, count(*) AS t FROM g GROUP BY 1) USING (relation) JOIN h USING (relation)")
def scores_by_relation(spark, sf_dir):
    claims = X.claims(spark, sf_dir)
    return reports.span_scores_by_type(claims.where("claim_id % 3 > 0"), claims.where("claim_id % 4 > 0"), ["document_id", "subject_id"], "relation")


@query(f"WITH {CLAIMS}, p AS (SELECT * FROM claims WHERE claim_id % 30 = 1), g AS (SELECT * FROM claims WHERE claim_id % 4 > 0) SELECT (SELECT count(DISTINCT document_id) FROM g) AS documents, (SELECT count(DISTINCT g.document_id) FROM g JOIN p USING (document_id, subject_id, object_id, relation)) AS covered, round((SELECT count(DISTINCT g.document_id) FROM g JOIN p USING (document_id, subject_id, object_id, relation)) / (SELECT count(DISTINCT document_id) FROM g), 6) AS share")
def document_coverage(spark, sf_dir):
    claims = X.claims(spark, sf_dir)
    return reports.document_coverage(claims.where("claim_id % 30 = 1"), claims.where("claim_id % 4 > 0"), ["subject_id", "object_id", "relation"])


@query(f"WITH {CLAIMS}, {ROUTED}, b AS (SELECT *, ['A','B','C','D'][claim_id % 4 + 1] AS band FROM routed) SELECT 'band:' || band AS counter, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'routing:' || routing, count(*) FROM b GROUP BY 1 UNION ALL SELECT 'entities', count(*) FROM (SELECT subject_id FROM b UNION SELECT object_id FROM b)")
def corpus_counters(spark, sf_dir):
    band = F.element_at(F.array(*[F.lit(b) for b in "ABCD"]), (F.col("claim_id") % 4 + 1).cast("int"))
    return reports.counters(C._routed(spark, sf_dir).withColumn("band", band), "band", "routing")


@query(f"WITH {CLAIMS}, b AS (SELECT ['A','B','C','D'][claim_id % 4 + 1] AS band, vacuity, claim_id % 3 > 0 AS ok FROM claims), m AS (SELECT band, count(*) AS n, avg(vacuity) AS m, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy, list_sort(list(vacuity))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS median FROM b GROUP BY 1) SELECT band, n, round(m, 6) AS mean, median, accuracy, NOT coalesce(bool_or(f) OVER (), false) AS monotonic, round(last_value(m) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(m) OVER (ORDER BY band), 6) AS separation FROM (SELECT *, m < lag(m) OVER (ORDER BY band) AS f FROM m)")
def band_separation(spark, sf_dir):
    band = F.element_at(F.array(*[F.lit(b) for b in "ABCD"]), (F.col("claim_id") % 4 + 1).cast("int"))
    return reports.band_separation(X.claims(spark, sf_dir).withColumn("band", band), "band", "vacuity", F.col("claim_id") % 3 > 0)


@query(f"WITH {CLAIMS}, {ABLATIONS} SELECT edge_count, mode, count(*) AS n, round(avg(abs(change)), 6) AS mean_change, round(max(abs(change)), 6) AS max_change, round(avg(CASE WHEN abs(change) > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS large, round(avg(CAST(routing_changed AS INTEGER)), 6) AS flips, round(avg(CAST(relation_changed AS INTEGER)), 6) AS relation_changes FROM ablations GROUP BY 1, 2")
def ablation_sweep(spark, sf_dir):
    return reports.ablation_sweep(X.ablations(spark, sf_dir))


@query(f"WITH {CLAIMS}, {ABLATIONS} SELECT claim_id, min(edge_count) FILTER (load_bearing) AS edges FROM ablations GROUP BY 1")
def smallest_load_bearing(spark, sf_dir):
    return reports.smallest_load_bearing(X.ablations(spark, sf_dir))


@query(f"WITH {CLAIMS}, {ABLATIONS} SELECT run_id, CASE WHEN abs(change) > 0.25 THEN 'decisive' WHEN abs(change) > 0.1 THEN 'strong' WHEN abs(change) > 0.02 THEN 'slight' ELSE 'negligible' END AS verdict FROM ablations")
def ablation_verdicts(spark, sf_dir):
    return X.ablations(spark, sf_dir).select("run_id", ablation.magnitude(F.col("change")).alias("verdict"))


EDGES = "e AS (SELECT document_id AS doc_id, object_id % 7 AS dst, claim_id AS src, confidence * 4 - vacuity AS score, dissonance AS value, claim_id % 5 = 0 AS mask FROM claims)"


@query(f"WITH {CLAIMS}, {EDGES}, b AS (SELECT doc_id, dst, sum(exp(score) * value) / sum(exp(score)) AS x FROM e GROUP BY 1, 2), a AS (SELECT doc_id, dst, sum(exp(score) * value) / sum(exp(score)) AS y FROM e WHERE NOT mask GROUP BY 1, 2) SELECT doc_id, dst, round(x, 6) AS before, round(coalesce(y, 0), 6) AS after, round(coalesce(y, 0) - x, 6) AS change, abs(coalesce(y, 0) - x) > 0.1 AS load_bearing FROM b LEFT JOIN a USING (doc_id, dst)")
def ablation_effect(spark, sf_dir):
    e = X.claims(spark, sf_dir).select(F.col("document_id").alias("doc_id"), (F.col("object_id") % 7).alias("dst"), F.col("claim_id").alias("src"), (F.col("confidence") * 4 - F.col("vacuity")).alias("score"), F.col("dissonance").alias("value"), (F.col("claim_id") % 5 == 0).alias("mask"))
    return ablation.effect(e, F.col("mask"))


@query(f"WITH {CLAIMS}, {EDGES}, w AS (SELECT doc_id, src, exp(score) / sum(exp(score)) OVER (PARTITION BY doc_id, dst) AS weight FROM e) SELECT doc_id, src FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, src) <= 3")
def heaviest_edges(spark, sf_dir):
    from claimloom.operators import spans

    e = X.claims(spark, sf_dir).select(F.col("document_id").alias("doc_id"), (F.col("object_id") % 7).alias("dst"), F.col("claim_id").alias("src"), (F.col("confidence") * 4 - F.col("vacuity")).alias("score"))
    return ablation.top_edges(spans.segment_softmax(e).withColumn("weight", F.round("weight", 9)), 3).select("doc_id", "src")


TUNED = ", r4 AS (SELECT round(r, 4) AS r, claim_id % 2 AS clean FROM raw), g AS (SELECT CAST(f AS DOUBLE) AS flag, CAST(e AS DOUBLE) AS escalate, row_number() OVER () AS i FROM (VALUES (0.2),(0.3),(0.4)) a(f), (VALUES (0.3),(0.35),(0.4),(0.5)) b(e) WHERE f < e), " \
    "s AS (SELECT flag, escalate, avg(CASE WHEN r >= escalate THEN 1.0 ELSE 0.0 END) FILTER (clean = 0) AS es, avg(CASE WHEN r >= flag AND r < escalate THEN 1.0 ELSE 0.0 END) FILTER (clean = 0) AS fs, avg(CASE WHEN r * 0.5 >= escalate THEN 1.0 ELSE 0.0 END) FILTER (clean = 1) AS ces, avg(CASE WHEN r * 0.5 >= flag AND r * 0.5 < escalate THEN 1.0 ELSE 0.0 END) FILTER (clean = 1) AS cfs FROM r4, g GROUP BY 1, 2) " \
    "SELECT flag, escalate, round(p, 6) AS penalty FROM (SELECT *, round(abs(es - 0.13) + 0.25 * greatest(fs - 0.35, 0) + 0.5 * greatest(cfs - 0.20, 0), 9) AS p FROM s WHERE es BETWEEN 0.08 AND 0.20 AND ces <= 0.08) ORDER BY p, flag, escalate LIMIT 1"


@query(C.SCORED + TUNED)
def tuned_thresholds(spark, sf_dir):
    risk = cut(routing.scored(X.claims(spark, sf_dir)).select("claim_id", "risk"))  # read twice
    return reports.tuned_thresholds(risk.where("claim_id % 2 = 0"), risk.where("claim_id % 2 = 1").withColumn("risk", F.col("risk") * 0.5), [0.2, 0.3, 0.4], [0.3, 0.35, 0.4, 0.5])


@query(f"WITH {CLAIMS}, c AS (SELECT CAST(0.5 + 0.02 * i AS DOUBLE) AS v FROM range(25) r(i)), s AS (SELECT v, avg(CASE WHEN vacuity >= round(v, 2) THEN 1.0 ELSE 0.0 END) AS rate FROM claims, c GROUP BY 1) SELECT round(v, 2) AS vacuity, round(rate, 6) AS rate FROM s ORDER BY round(abs(rate - 0.13), 9), v LIMIT 1")
def tuned_vacuity(spark, sf_dir):
    return reports.tuned_vacuity(X.claims(spark, sf_dir), [round(0.5 + 0.02 * i, 2) for i in range(25)])


@query(C.SQL["confusion_matrix"].replace("SELECT truth, count", ", m AS (SELECT truth, count") + ") SELECT *, auto_file + flag + escalate AS total FROM m UNION ALL SELECT 'total', sum(auto_file), sum(flag), sum(escalate), sum(auto_file + flag + escalate) FROM m")
def confusion_totals(spark, sf_dir):
    out = reports.confusion_totals(evals.confusion(X.eval_cases(spark, sf_dir), BUCKETS), BUCKETS)
    return out.select("truth", *[F.col(c).cast("long").alias(c) for c in (*BUCKETS, "total")])


@query(f"WITH {CLAIMS}, c AS (SELECT document_id, (claim_id % 41 - 20) / 20.0 AS rho, claim_id % 30 AS n, (claim_id % 7) / 50.0 AS p, claim_id FROM claims) SELECT claim_id, CASE WHEN n < 10 THEN 'too few rows' WHEN p >= 0.05 THEN 'not significant' ELSE (CASE WHEN abs(rho) >= 0.6 THEN 'strong' WHEN abs(rho) >= 0.35 THEN 'moderate' WHEN abs(rho) >= 0.15 THEN 'weak' ELSE 'negligible' END) || ' ' || (CASE WHEN rho >= 0 THEN 'positive' ELSE 'negative' END) END AS verdict FROM c")
def correlation_verdicts(spark, sf_dir):
    k = F.col("claim_id")
    return X.claims(spark, sf_dir).select("claim_id", reports.strength((k % 41 - 20) / 20.0, k % 30, (k % 7) / 50.0).alias("verdict"))


@query(f"""WITH {CLAIMS}, r AS (SELECT vacuity, confidence, rank() OVER (ORDER BY vacuity) + (count(*) OVER (PARTITION BY vacuity) - 1) / 2 AS a, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS b FROM claims),
c AS (SELECT count(*) AS n, round(corr(vacuity, confidence), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r),
g AS (SELECT *, n - 2 AS df, atan(abs(spearman) / sqrt(1 - spearman * spearman)) AS low, 12 / sqrt(n - 2) AS wide FROM c),
area AS (SELECT n, pearson, spearman, df, low, wide, w * (CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS w, i FROM g, (SELECT i, CAST(1 AS DOUBLE) AS w FROM range(20001) t(i)))
SELECT any_value(n) AS n, any_value(pearson) AS pearson, any_value(spearman) AS spearman,
  round(sum(w * cos(low + wide * i / 20000) ** (df - 1)) / sum(w * cos(wide * i / 20000) ** (df - 1)), 9) AS p_value FROM area""")
def correlation_test(spark, sf_dir):
    return evals.correlation_test(X.claims(spark, sf_dir), "vacuity", "confidence").withColumn("p_value", F.round("p_value", 9))


@query(C.EVIDENCE + ", p AS (SELECT claim_id, list_transform(e, lambda x: round((x + 1) / s, 6)) AS p FROM st) SELECT claim_id, p[1] AS p0, list_max(p) AS top FROM p")
def probabilities(spark, sf_dir):
    e = X.logits(spark, sf_dir).select("claim_id", trust.probabilities(trust.evidence(F.col("z"))).alias("p"))
    return e.select("claim_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.array_max("p"), 6).alias("top"))


@query()
def recalibrated(spark, sf_dir):
    """The temperature fitted on hard negatives, with calibration before and after."""
    cases = X.logits(spark, sf_dir).join(X.claims(spark, sf_dir).select("claim_id"), "claim_id").withColumn("target", (F.col("claim_id") % 6).cast("int"))
    return evals.recalibrated(cases, cases.where("claim_id % 4 = 0"), 1.0)


@query(C.CASCADE + f", {GOLD} SELECT r.claim_id, CASE WHEN g.note IS NOT NULL THEN g.note || ' ' ELSE '' END || 'Seen: ' || r.routing || ' for ' || g.truth || CASE WHEN r.degraded THEN '; no second opinion came' WHEN r.resolved_by = 'second_opinion' THEN '; after a second opinion' ELSE '' END || '.' AS note FROM gold g JOIN resolved r ON r.claim_id = g.position WHERE r.routing <> g.truth")
def failure_notes(spark, sf_dir):
    cases = C._cascade(spark, sf_dir).join(X.gold(spark, sf_dir).select(F.col("position").alias("claim_id"), "truth", "note"), "claim_id").where("routing <> truth")
    return cases.select("claim_id", answers.failure_note(F.col("note"), F.col("routing"), F.col("truth"), F.col("degraded"), F.col("resolved_by")).alias("note"))


@query(f"WITH {CLAIMS}, w AS (SELECT claim_id, list_filter([CASE WHEN claim_id % 2 = 0 THEN 'both parties own each other in a ring' END, CASE WHEN claim_id % 3 = 0 THEN 'both parties have one address' END, CASE WHEN claim_id % 5 = 0 THEN 'the parties are tied in several ways' END], lambda x: x IS NOT NULL) AS s FROM claims) SELECT claim_id, CASE WHEN len(s) = 0 THEN 'Nothing beyond the ordinary was found.' WHEN len(s) = 1 THEN 'Raised because ' || s[1] || '.' ELSE 'Raised because ' || array_to_string(s[1:len(s)-1], ', ') || ' and ' || s[len(s)] || '.' END AS sentence FROM w")
def reason_sentences(spark, sf_dir):
    k = F.col("claim_id")
    reasons = F.array_join(F.array_compact(F.array(F.when(k % 2 == 0, "ownership_cycle"), F.when(k % 3 == 0, "shared_address"), F.when(k % 5 == 0, "multi_relation"), F.when(k % 7 == 0, "unheard_of"))), ",")
    return X.claims(spark, sf_dir).select("claim_id", answers.reason_sentence(reasons).alias("sentence"))


@query(f"WITH {CLAIMS}, {TRIALS}, t AS (SELECT claim_id, k, subject_id, object_id, claim_id % 40 AS s, claim_id % 40 + 10 AS e FROM trials JOIN claims USING (claim_id)), d AS (SELECT claim_id, k, claim_id % 40 + k * 4 AS s2, claim_id % 40 + k * 4 + 6 AS e2, CASE WHEN (claim_id + k) % 3 = 0 THEN 'flag' ELSE 'escalate' END AS r, (claim_id + k) % 10 / 10.0 AS c FROM t WHERE (claim_id + k) % 4 > 0) SELECT t.claim_id, t.k AS variant, d.r IS NULL OR d.r <> 'flag' AS label_flipped, CAST(round(coalesce(d.c, 0) - 0.5, 6) AS DOUBLE) AS conf_delta, d.r IS NULL AS relation_lost FROM t LEFT JOIN d ON t.claim_id = d.claim_id AND t.k = d.k AND d.s2 < t.e AND d.e2 > t.s")
def scored_trials(spark, sf_dir):
    base = X.claims(spark, sf_dir).select("claim_id", "subject_id", "object_id").join(X.trials(spark, sf_dir).select("claim_id", F.col("k").alias("variant"), F.lit("synonym").alias("perturbation")), "claim_id")
    c, v = F.col("claim_id"), F.col("variant")
    targets = base.select("*", (c % 40).alias("start"), (c % 40 + 10).alias("end"), F.lit("flag").alias("routing"), F.lit(0.5).alias("confidence"))
    drafts = base.where((c + v) % 4 > 0).select("claim_id", "variant", "perturbation", "subject_id", "object_id", (c % 40 + v * 4).alias("start2"), (c % 40 + v * 4 + 6).alias("end2"), F.when((c + v) % 3 == 0, "flag").otherwise("escalate").alias("new_routing"), ((c + v) % 10 / 10.0).alias("new_confidence"))
    return fuzz.scored(targets, drafts).select("claim_id", "variant", "label_flipped", "conf_delta", "relation_lost")


@query(f"WITH {CLAIMS}, {GOLD} SELECT truth AS split, count(*) AS n FROM gold WHERE truth IN ('flag', 'escalate') GROUP BY 1")
def cases_of_splits(spark, sf_dir):
    return X.gold(spark, sf_dir).where(F.col("truth").isin("flag", "escalate")).groupBy(F.col("truth").alias("split")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLAIMS}, {TRIALS}, p AS (SELECT claim_id, vacuity, round(avg({C.INSTABILITY}), 6) AS fragility, count(*) AS trials, count(*) FILTER (flipped) AS flips FROM trials GROUP BY 1, 2),
r AS (SELECT vacuity, fragility, rank() OVER (ORDER BY vacuity) + (count(*) OVER (PARTITION BY vacuity) - 1) / 2 AS a, rank() OVER (ORDER BY fragility) + (count(*) OVER (PARTITION BY fragility) - 1) / 2 AS b FROM p),
c AS (SELECT count(*) AS n, round(corr(vacuity, fragility), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r),
g AS (SELECT *, n - 2 AS df, atan(abs(spearman) / sqrt(1 - spearman * spearman)) AS low, 12 / sqrt(n - 2) AS wide FROM c),
area AS (SELECT df, low, wide, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, i FROM g, range(20001) t(i)),
tail AS (SELECT round(sum(w * cos(low + wide * i / 20000) ** (df - 1)) / sum(w * cos(wide * i / 20000) ** (df - 1)), 9) AS p_value FROM area),
q AS (SELECT least(floor(4 * (rank() OVER (ORDER BY vacuity) - 1) / count(*) OVER ()) + 1, 4) AS quartile, trials, flips FROM p),
f AS (SELECT quartile, round(CAST(sum(flips) AS DOUBLE) / sum(trials), 6) AS rate FROM q GROUP BY 1),
h AS (SELECT max(rate) FILTER (quartile = 4) AS top, max(rate) FILTER (quartile = 1) AS bottom FROM f),
w AS (SELECT family, round(avg(CAST(flipped AS INTEGER)), 6) AS rate FROM trials GROUP BY 1 ORDER BY rate DESC, list_position(['synonym','rename','boilerplate','reorder','punctuation'], family) LIMIT 1)
SELECT n, pearson, spearman, p_value, CASE WHEN n < 10 THEN 'too few rows' WHEN p_value >= 0.05 THEN 'not significant' ELSE (CASE WHEN abs(spearman) >= 0.6 THEN 'strong' WHEN abs(spearman) >= 0.35 THEN 'moderate' WHEN abs(spearman) >= 0.15 THEN 'weak' ELSE 'negligible' END) || (CASE WHEN spearman >= 0 THEN ' positive' ELSE ' negative' END) END AS verdict,
  top, bottom, round(top / bottom, 6) AS times, family AS worst_family, rate AS worst_rate FROM c, tail, h, w""")
def fragility_headline(spark, sf_dir):
    """Correlation of vacuity with fragility, its p-value and verdict, the contrast of quartiles and the worst family, in one row."""
    return views.fragility_view(X.trials(spark, sf_dir), X.FAMILIES).headline.withColumn("p_value", F.round("p_value", 9))


@query(f"""WITH {CLAIMS}, {TRIALS}, p AS (SELECT claim_id, vacuity, avg({C.INSTABILITY}) AS f, count(*) AS trials, count(*) FILTER (flipped) AS flips FROM trials GROUP BY 1, 2),
q AS (SELECT *, least(floor(4 * (rank() OVER (ORDER BY vacuity) - 1) / count(*) OVER ()) + 1, 4) AS quartile FROM p), s AS (SELECT list_sort(list(vacuity)) AS v, count(*) AS n FROM p),
b AS (SELECT CAST(k AS INTEGER) AS quartile, v[CAST(floor(n * (k - 1) / 4.0) AS BIGINT) + 1] AS low, v[CASE WHEN k = 4 THEN n ELSE CAST(floor(n * k / 4.0) AS BIGINT) + 1 END] AS high FROM s, range(1, 5) r(k)),
t AS (SELECT CAST(quartile AS INTEGER) AS quartile, count(*) AS n, round(avg(f), 6) AS mean_fragility, round(CAST(sum(flips) AS DOUBLE) / sum(trials), 6) AS flip_rate FROM q GROUP BY 1) SELECT * FROM t JOIN b USING (quartile)""")
def fragility_quartiles(spark, sf_dir):
    return views.fragility_view(X.trials(spark, sf_dir), X.FAMILIES).quartiles


ARM = "round(avg(CASE WHEN truth = {0} THEN 1.0 ELSE 0.0 END), 4)"


@query(f"""WITH {CLAIMS}, {CASES}, c AS (SELECT claim_id, truth, predicted, claim_id % 7 = 0 AS second FROM cases WHERE claim_id % 3 > 0),
k AS (SELECT claim_id, CASE WHEN claim_id % 4 > 0 THEN CASE claim_id % 4 % 3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END END AS classical FROM claims WHERE claim_id % 11 > 0),
o AS (SELECT truth, CASE WHEN claim_id % 2 = 0 THEN truth ELSE predicted END AS predicted FROM cases WHERE claim_id % 9 = 0),
l AS (SELECT x.label, count(*) FILTER (truth = label AND predicted = label) AS hit, count(*) FILTER (truth = label) AS a, count(*) FILTER (predicted = label) AS b FROM c, (VALUES ('auto_file'), ('flag'), ('escalate')) x(label) GROUP BY 1)
SELECT count(*) AS n_cases, {ARM.format("predicted")} AS accuracy, (SELECT round(avg(round(2.0 * hit / (a + b), 6)), 4) FROM l) AS macro_f1,
  (SELECT {ARM.format("coalesce(classical, predicted)")} FROM c JOIN k USING (claim_id)) AS classical_accuracy, (SELECT {ARM.format("predicted")} FROM o) AS opinion_accuracy,
  count(*) FILTER (second) AS cascade_calls, (SELECT count(*) FROM o) AS opinion_calls FROM c""")
def routing_eval(spark, sf_dir):
    """The three arms over cases joined with the stored claims; some cases have no claim, some claims no classical outcome."""
    k, name = F.col("claim_id"), F.array(*[F.lit(b) for b in BUCKETS])
    every = X.eval_cases(spark, sf_dir)
    cases = every.where(k % 3 > 0).select("claim_id", "truth", "predicted", F.when(k % 7 == 0, "second_opinion").otherwise("classical").alias("resolved_by"), (F.col("truth") != F.col("predicted")).alias("is_failure"))
    claims = every.where(k % 11 > 0).select("claim_id", F.when(k % 4 > 0, name[(k % 4 % 3).cast("int")]).alias("classical"))
    opinions = every.where(k % 9 == 0).select("truth", F.when(k % 2 == 0, F.col("truth")).otherwise(F.col("predicted")).alias("predicted"))
    return views.routing_view(cases, claims, opinions, BUCKETS).summary


def _value(k: int) -> str:
    return f"CAST((m * {3 + k} + {k * 29}) % 61 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(3 AS DOUBLE)"


NAMES = ",".join(f"'{r}'" for r in X.RELATIONS)
ABLATED = f"""c AS (SELECT *, CAST(claim_id * 37 % 4000 AS INTEGER) AS a, CAST(claim_id * 37 % 4000 + 80 + claim_id % 9 AS INTEGER) AS b FROM claims),
party AS (SELECT DISTINCT document_id, a, b, 0 AS node, subject_id AS entity_id FROM c UNION SELECT DISTINCT document_id, a, b, 1, object_id FROM c WHERE claim_id % 13 > 0),
first AS (SELECT document_id, a, b, entity_id, min(node) AS node FROM party GROUP BY ALL),
req AS (SELECT claim_id * 2 + k AS run_id, claim_id, CASE WHEN k = 0 THEN 'uniform' ELSE 'zero' END AS mode, CASE WHEN claim_id % 19 = 0 THEN ['0->0', '9->1'] WHEN k = 0 THEN [(claim_id % 3 + 1) || '->0'] ELSE ['2->1', '3->0'] END AS masked FROM claims, range(2) r(k)),
met AS (SELECT r.*, c.document_id, c.a, c.b, c.subject_id, c.object_id, c.relation, s.node AS sn, o.node AS n_o FROM req r JOIN c USING (claim_id) LEFT JOIN first s ON s.document_id = c.document_id AND s.a = c.a AND s.b = c.b AND s.entity_id = c.subject_id
  LEFT JOIN first o ON o.document_id = c.document_id AND o.a = c.a AND o.b = c.b AND o.entity_id = c.object_id),
told AS (SELECT *, CASE WHEN sn IS NULL OR n_o IS NULL THEN 'a party is not in the sentence' WHEN claim_id % 19 = 0 THEN 'unknown edges: 0->0,9->1' END AS refused FROM met),
arc AS (SELECT run_id, mode, dst, list_contains(masked, src || '->' || dst) AS off, a * 5 + src * 7 + dst * 11 AS m FROM told, range(4) s(src), range(4) d(dst) WHERE refused IS NULL AND src <> dst AND (dst = sn OR dst = n_o)),
sco AS (SELECT *, exp(CAST(m % 17 AS DOUBLE) / CAST(4 AS DOUBLE)) AS e FROM arc),
wt AS (SELECT *, e / sum(e) OVER (PARTITION BY run_id, dst) AS w0, count(*) OVER (PARTITION BY run_id, dst) AS n FROM sco),
wb AS (SELECT *, CASE WHEN NOT off THEN w0 WHEN mode = 'zero' THEN 0 ELSE CAST(1 AS DOUBLE) / n END AS w1 FROM wt),
nd AS (SELECT run_id, dst, [{", ".join(f"sum(w0 * ({_value(k)})) / sum(w0)" for k in range(6))}] AS z0, [{", ".join(f"sum(w1 * ({_value(k)})) / sum(w1)" for k in range(6))}] AS z1 FROM wb GROUP BY 1, 2),
pr AS (SELECT run_id, [{", ".join(f"avg(z0[{k + 1}])" for k in range(6))}] AS z0, [{", ".join(f"avg(z1[{k + 1}])" for k in range(6))}] AS z1 FROM nd GROUP BY 1),
fig AS (SELECT run_id, [{NAMES}][list_position(z0, list_max(z0))] AS r0, [{NAMES}][list_position(z1, list_max(z1))] AS r1, list_transform(z0, lambda x: greatest(x, 0.0) + ln(1 + exp(-abs(x)))) AS e0, list_transform(z1, lambda x: greatest(x, 0.0) + ln(1 + exp(-abs(x)))) AS e1 FROM pr)
SELECT t.run_id, t.claim_id, t.refused, r0 AS relation_before, r1 AS relation_after, round((list_max(e0) + 1) / (list_sum(e0) + 6), 6) AS confidence_before, round((list_max(e1) + 1) / (list_sum(e1) + 6), 6) AS confidence_after,
  round(6 / (list_sum(e0) + 6), 6) AS vacuity_before, round(6 / (list_sum(e1) + 6), 6) AS vacuity_after FROM told t LEFT JOIN fig USING (run_id)"""


def _ablated(spark, sf_dir):
    given = [f(spark, sf_dir) for f in (X.ablation_requests, X.cited, X.sentence_nodes, X.sentence_edges)]
    return ablation.ablate(*given, X.RELATIONS, spark.createDataFrame([], "relation string, node long"))


@query(f"WITH {CLAIMS}, {ABLATED}")
def ablated_claims(spark, sf_dir):
    """Two ablations of every stored claim, all in one plan."""
    return _ablated(spark, sf_dir).select("run_id", "claim_id", "refused", "relation_before", "relation_after", "confidence_before", "confidence_after", "vacuity_before", "vacuity_after")


@query()
def fuzzed_claims(spark, sf_dir):
    """Every claim written as a sentence between two others, perturbed by all families, read again and scored: its stored fragility."""
    phrase = F.create_map(*[F.lit(x) for kv in {"OWNED_BY": "is owned by", "WIRED_FUNDS_TO": "wired funds to", "INVOICED": "sent an invoice to", "SIGNATORY_OF": "signs for", "SHARES_ADDRESS_WITH": "has one address with"}.items() for x in kv])
    name = lambda c: F.concat(F.lit("Entity "), F.col(c).cast("string"))
    head = F.concat(F.lit("We ask about the price of case "), F.col("claim_id").cast("string"), F.lit(". "))
    said = F.concat(name("subject_id"), F.lit(" "), phrase[F.col("relation")], F.lit(" "), name("object_id"))
    rows = X.claims(spark, sf_dir).withColumns({"head": head, "said": said}).withColumn("char_start", F.length("head")).withColumn("char_end", F.col("char_start") + F.length("said"))
    documents = rows.select(F.col("claim_id").alias("document_id"), F.concat("head", "said", F.lit(". Please keep this note.")).alias("text"))
    claims = rows.select("claim_id", F.col("claim_id").alias("document_id"), "char_start", "char_end", name("subject_id").alias("subject"), name("object_id").alias("object"), "relation", "confidence")
    return fuzz.run(claims, documents, extraction.lexical_drafts).claims.select("claim_id", "fragility")
