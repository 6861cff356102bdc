"""Registered queries on the derived claim tables, each with its SQL for the other engine."""

from __future__ import annotations

__all__ = ["QUERIES", "SQL"]

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import trust
from claimloom.operators import entities, evals, feed, graph, routing, spans
from claimloom.plans import fixtures as X
from claimloom.plans.fixtures import BUCKETS, CASES, CLAIMS, LOGITS, SNAPSHOTS, TRIALS, table
from claimloom.plans.registry import QUERIES, SQL, query
from claimloom.sources import documents as sources
from claimloom.sources.durable import cut
from claimloom.streaming import feeds

ROUTED = "routed AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'escalate' WHEN confidence >= 0.6 THEN 'flag' ELSE 'auto_file' END AS routing FROM claims)"
EDGES = """edges AS (SELECT subject_id AS src, object_id AS dst, relation, max(confidence) AS confidence, min(vacuity) AS vacuity,
  max_by(routing, CASE routing WHEN 'escalate' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END) AS routing, count(*) AS weight, list_sort(list(claim_id)) AS claim_ids FROM {src} GROUP BY 1, 2, 3)"""
CYCLES = """RECURSIVE step AS (SELECT DISTINCT relation, src AS here, dst AS nxt FROM edges),
paths AS (SELECT relation, [here, nxt] AS path FROM step WHERE nxt > here UNION ALL
  SELECT p.relation, list_append(p.path, s.nxt) FROM paths p JOIN step s ON s.relation = p.relation AND s.here = p.path[-1]
  WHERE s.nxt > p.path[1] AND NOT list_contains(p.path, s.nxt) AND len(p.path) < 5),
cycles AS (SELECT p.relation, p.path, len(p.path) AS length FROM paths p JOIN step s ON s.relation = p.relation AND s.here = p.path[-1] AND s.nxt = p.path[1] UNION ALL SELECT relation, [here], 1 FROM step WHERE here = nxt),
counted AS (SELECT * FROM cycles WHERE relation = 'OWNED_BY' OR (relation = 'WIRED_FUNDS_TO' AND length >= 3)),
reach AS (SELECT here AS a, nxt AS b FROM step WHERE relation = 'OWNED_BY' UNION SELECT r.a, s.nxt FROM reach r JOIN step s ON s.here = r.b AND s.relation = 'OWNED_BY'),
mem AS (SELECT 'OWNED_BY' AS relation, a AS node FROM reach WHERE a = b UNION SELECT relation, unnest(path) FROM counted WHERE relation <> 'OWNED_BY')"""
GRAPH = f"WITH RECURSIVE {CLAIMS}, {ROUTED}, {EDGES.format(src='routed')}, {CYCLES.removeprefix('RECURSIVE ')}"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.routing_by_confidence(X.claims(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Grouped edges of all claims; ``once``: written without the lists of their claims, for queries that read them several times."""
    edges = graph.grouped_edges(_routed(spark, sf_dir))
    return cut(edges.drop("claim_ids")) if once else edges


# Feed, filters, paging


@query(f"WITH {CLAIMS}, {ROUTED} SELECT b.routing, count(r.claim_id) AS n FROM (VALUES ('auto_file'),('flag'),('escalate')) b(routing) LEFT JOIN routed r ON r.routing = b.routing GROUP BY 1")
def claims_by_bucket(spark, sf_dir):
    return feed.zero_filled(_routed(spark, sf_dir).groupBy("routing").agg(F.count("*").alias("n")), "routing", BUCKETS)


@query(f"WITH {CLAIMS} SELECT count(*) AS n_claims, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (vacuity >= 0.625) AS n_vacuous FROM claims WHERE org_id = 0")
def claims_stats(spark, sf_dir):
    return feed.stats(feed.scoped(X.claims(spark, sf_dir), 0))


@query(f"WITH {CLAIMS} SELECT claim_id, relation, confidence, vacuity FROM claims WHERE org_id = 0 AND relation IN ('OWNED_BY','WIRED_FUNDS_TO') AND confidence >= 0.5 AND confidence <= 0.9 AND vacuity >= 0.3")
def feed_filtered(spark, sf_dir):
    found = feed.filtered(feed.scoped(X.claims(spark, sf_dir), 0), relations=["OWNED_BY", "WIRED_FUNDS_TO"], min_confidence=0.5, max_confidence=0.9, min_vacuity=0.3)
    return found.select("claim_id", "relation", "confidence", "vacuity")


@query(f"WITH {CLAIMS}, o AS (SELECT claim_id, confidence, row_number() OVER (ORDER BY confidence DESC, claim_id DESC) AS n FROM claims WHERE org_id = 0) SELECT claim_id, confidence FROM o WHERE n > 25 AND n <= 51")
def feed_keyset_page2(spark, sf_dir):
    claims = feed.scoped(X.claims(spark, sf_dir), 0)
    last = feed.page(claims, "confidence").select("confidence", "claim_id").collect()[feed.ROWS - 1]
    return feed.page(claims, "confidence", after=(last[0], last[1])).select("claim_id", "confidence")


@query(f"WITH {CLAIMS} SELECT claim_id, subject_id, object_id FROM claims WHERE org_id = 0 AND (subject_id = 3 OR object_id = 3)")
def claims_either_side(spark, sf_dir):
    return feed.filtered(feed.scoped(X.claims(spark, sf_dir), 0), entity=3).select("claim_id", "subject_id", "object_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('license, version'))")
def feed_text_search(spark, sf_dir):
    return feed.filtered(table(spark, sf_dir, "documents").withColumnRenamed("text", "sentence_text"), text="License, Version").select("doc_id")


@query(f"WITH {CLAIMS} SELECT d.doc_id, CAST(count(c.claim_id) AS BIGINT) AS n_claims FROM documents d LEFT JOIN claims c ON c.document_id = d.doc_id GROUP BY 1")
def doc_claim_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return feed.per_document(docs, X.claims(spark, sf_dir)).select(F.col("document_id").alias("doc_id"), "n_claims")


@query(f"WITH {CLAIMS}, e AS (SELECT subject_id AS entity_id FROM claims UNION ALL SELECT object_id FROM claims) SELECT entity_id, count(*) AS n_claims FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def entities_touched_most(spark, sf_dir):
    return feed.touched_most(X.claims(spark, sf_dir))


@query(f"WITH {CLAIMS} SELECT claim_id FROM claims QUALIFY row_number() OVER (PARTITION BY document_id, relation, least(subject_id, object_id), greatest(subject_id, object_id) ORDER BY confidence DESC, claim_id) = 1")
def keep_one_direction(spark, sf_dir):
    return feed.one_direction(X.claims(spark, sf_dir)).select("claim_id")


@query(f"WITH {CLAIMS} SELECT c.claim_id, d.source AS document_source, c.relation FROM claims c LEFT JOIN documents d ON d.doc_id = c.document_id WHERE c.org_id = 1")
def claims_with_document(spark, sf_dir):
    claims, docs = feed.scoped(X.claims(spark, sf_dir), 1), table(spark, sf_dir, "documents")
    return claims.join(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("document_source")), "document_id", "left").select("claim_id", "document_source", "relation")


# Graph


@query(f"WITH {CLAIMS}, {ROUTED}, {EDGES.format(src='routed')} SELECT src, dst, relation, confidence, vacuity, routing, weight, array_to_string(claim_ids, ',') AS claims FROM edges")
def grouped_edges(spark, sf_dir):
    e = graph.grouped_edges(_routed(spark, sf_dir))
    return e.select("src", "dst", "relation", "confidence", "vacuity", "routing", "weight", F.array_join(F.transform("claim_ids", lambda x: x.cast("string")), ",").alias("claims"))


@query(GRAPH + " SELECT node, count(*) AS degree, round(avg(s), 6) AS severity, max(vacuity) AS vacuity FROM (SELECT src AS node, vacuity, CASE routing WHEN 'escalate' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END AS s FROM edges UNION ALL SELECT dst, vacuity, CASE routing WHEN 'escalate' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END FROM edges WHERE src <> dst) GROUP BY 1")
def node_degree(spark, sf_dir):
    return graph.node_degree(_edges(spark, sf_dir)).withColumn("severity", F.round("severity", 6))


@query(GRAPH + ", b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT b AS node FROM b WHERE a = 3), h2 AS (SELECT b.b AS node FROM h1 JOIN b ON b.a = h1.node) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT 3 AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1")
def khop_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(_edges(spark, sf_dir), 3, 2)


@query(GRAPH + " SELECT relation, array_to_string(path, '-') AS path, CAST(length AS INTEGER) AS length FROM cycles")
def simple_cycles(spark, sf_dir):
    return graph.simple_cycles(_edges(spark, sf_dir)).select("relation", _joined("path"), "length")


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "-").alias(column)


@query(GRAPH + " SELECT c.relation, array_to_string(c.path, '-') AS path FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted d WHERE d.relation = c.relation AND d.length < c.length AND len(list_intersect(d.path, c.path)) = d.length)")
def minimal_cycles(spark, sf_dir):
    cycles = graph.counted_cycles(_edges(spark, sf_dir))
    return graph.minimal_cycles(cycles).select("relation", _joined("path"))


@query(GRAPH + " SELECT relation, node FROM mem")
def cycle_members(spark, sf_dir):
    return graph.cycle_members(_edges(spark, sf_dir))


@query(GRAPH + ", n AS (SELECT here AS node FROM step WHERE relation = 'OWNED_BY' UNION SELECT nxt FROM step WHERE relation = 'OWNED_BY') SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS component FROM n LEFT JOIN reach r ON r.a = n.node AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = r.a) GROUP BY n.node")
def strong_components(spark, sf_dir):
    return graph.strong_components(_edges(spark, sf_dir).where("relation = 'OWNED_BY'"))


NODES = """, ends AS (SELECT src AS node, relation, vacuity, CASE routing WHEN 'escalate' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END AS s FROM edges
  UNION ALL SELECT dst, relation, vacuity, CASE routing WHEN 'escalate' THEN 1.0 WHEN 'flag' THEN 0.5 ELSE 0.0 END FROM edges WHERE src <> dst),
deg AS (SELECT node, count(*) AS degree, CAST(avg(s) AS DOUBLE) AS sev, max(vacuity) AS vac, bool_or(relation = 'SHARES_ADDRESS_WITH') AS shares FROM ends GROUP BY 1),
risk AS (SELECT node, degree, CAST(round(CAST((CAST(0.25 AS DOUBLE) * degree / (SELECT max(degree) FROM deg) + CAST(0.40 AS DOUBLE) * CASE WHEN node IN (SELECT node FROM mem) THEN 1.0 ELSE 0.0 END + CAST(0.35 AS DOUBLE) * sev) / CAST(1.0 AS DOUBLE) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS risk FROM deg)"""


@query(GRAPH + NODES + " SELECT node, degree, risk FROM risk ORDER BY risk DESC, node LIMIT 20")
def node_risk_topn(spark, sf_dir):
    edges = _edges(spark, sf_dir, once=True)
    return graph.node_risk(edges, graph.cycle_members(edges)).orderBy(F.desc("risk"), "node").limit(20)


@query(GRAPH + NODES + """ SELECT node, array_to_string(list_filter([CASE WHEN node IN (SELECT node FROM mem WHERE relation = 'OWNED_BY') THEN 'ownership_cycle' END, CASE WHEN node IN (SELECT node FROM mem WHERE relation = 'WIRED_FUNDS_TO') THEN 'funds_cycle' END,
  CASE WHEN shares THEN 'shared_address' END, CASE WHEN vac >= 0.45 THEN 'high_vacuity' END], lambda x: x IS NOT NULL), ',') AS flags FROM deg""")
def node_flags(spark, sf_dir):
    edges = _edges(spark, sf_dir, once=True)
    return graph.node_flags(edges, graph.cycle_members(edges))


@query(GRAPH + NODES + ", m AS (SELECT relation, array_to_string(path, '-') AS id, length, unnest(path) AS node FROM counted) SELECT m.relation, m.id, CAST(m.length AS INTEGER) AS length, round(avg(r.risk), 6) AS risk FROM m JOIN risk r ON r.node = m.node GROUP BY ALL")
def cycle_risk(spark, sf_dir):
    edges = _edges(spark, sf_dir, once=True)
    cycles, members = graph.cycles_and_members(edges)
    return graph.cycle_risk(cycles, graph.node_risk(edges, members))


# Routing, gate, cascade


@query(f"WITH {CLAIMS} SELECT least(subject_id, object_id) AS low, greatest(subject_id, object_id) AS high, count(DISTINCT relation) AS kinds FROM claims GROUP BY 1, 2")
def relation_kinds(spark, sf_dir):
    return routing.relation_kinds(X.claims(spark, sf_dir))


@query(f"WITH {CLAIMS} SELECT DISTINCT least(subject_id, object_id) AS low, greatest(subject_id, object_id) AS high FROM claims WHERE relation = 'SHARES_ADDRESS_WITH'")
def shared_pair_context(spark, sf_dir):
    return routing.shared_pairs(X.claims(spark, sf_dir))


@query(f"WITH {CLAIMS} SELECT DISTINCT a.object_id AS low, b.object_id AS high FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.object_id < b.object_id WHERE a.relation = 'SIGNATORY_OF' AND b.relation = 'SIGNATORY_OF'")
def cosigned_pairs(spark, sf_dir):
    return routing.cosigned_pairs(X.claims(spark, sf_dir))


SCORED = GRAPH + """, p AS (SELECT *, least(subject_id, object_id) AS low, greatest(subject_id, object_id) AS high FROM claims),
sh AS (SELECT DISTINCT low, high FROM p WHERE relation = 'SHARES_ADDRESS_WITH'),
co AS (SELECT DISTINCT a.object_id AS low, b.object_id AS high FROM p a JOIN p b ON a.subject_id = b.subject_id AND a.object_id < b.object_id AND a.relation = 'SIGNATORY_OF' AND b.relation = 'SIGNATORY_OF'),
ki AS (SELECT low, high, count(DISTINCT relation) AS kinds FROM p GROUP BY 1, 2),
t AS (SELECT p.*, CASE WHEN subject_id IN (SELECT node FROM mem WHERE relation = 'OWNED_BY') AND object_id IN (SELECT node FROM mem WHERE relation = 'OWNED_BY') THEN 'ownership_cycle'
    WHEN subject_id IN (SELECT node FROM mem WHERE relation = 'WIRED_FUNDS_TO') AND object_id IN (SELECT node FROM mem WHERE relation = 'WIRED_FUNDS_TO') THEN 'funds_cycle' END AS cyc,
  sh.low IS NOT NULL AND relation <> 'SHARES_ADDRESS_WITH' AS sha, co.low IS NOT NULL AS cos, ki.kinds >= 3 AS many
  FROM p LEFT JOIN sh USING (low, high) LEFT JOIN co USING (low, high) JOIN ki USING (low, high)),
raw AS (SELECT *, least(CAST(1 AS DOUBLE), (CAST(CASE relation WHEN 'OWNED_BY' THEN 0.45 WHEN 'WIRED_FUNDS_TO' THEN 0.35 WHEN 'SHARES_ADDRESS_WITH' THEN 0.30 WHEN 'SIGNATORY_OF' THEN 0.25 ELSE 0.15 END AS DOUBLE)
  + CAST(CASE WHEN cyc IS NOT NULL THEN 0.3 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN sha THEN 0.15 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN cos THEN 0.15 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN many THEN 0.1 ELSE 0 END AS DOUBLE))
  * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * confidence)) AS r FROM t)"""


@query(SCORED + """ SELECT claim_id, round(r, 6) AS risk, CASE WHEN r >= 0.8 THEN 'escalate' WHEN r >= 0.6 THEN 'flag' ELSE 'auto_file' END AS routing,
  array_to_string(list_filter([cyc, CASE WHEN sha THEN 'shared_address' END, CASE WHEN cos THEN 'common_signatory' END, CASE WHEN many THEN 'multi_relation' END], lambda x: x IS NOT NULL), ',') AS reasons FROM raw""")
def routing_score(spark, sf_dir):
    return routing.scored(X.claims(spark, sf_dir), digits=6)


GATE = "gated AS (SELECT *, CASE WHEN vacuity >= 0.625 THEN 'vacuity' WHEN dissonance >= 0.35 THEN 'dissonance' WHEN routing = 'escalate' AND confidence < 0.75 THEN 'low_confidence' ELSE 'none' END AS gate FROM routed)"
DECISIONS = "decisions AS (SELECT claim_id, CASE claim_id % 11 % 3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END AS decision, claim_id % 13 = 0 AS degraded FROM gated WHERE gate <> 'none' AND claim_id % 17 <> 0)"
CASCADE = f"""WITH {CLAIMS}, {ROUTED}, {GATE}, {DECISIONS}, resolved AS (SELECT g.claim_id, g.routing AS classical, CASE WHEN d.decision IS NOT NULL AND NOT d.degraded THEN d.decision ELSE g.routing END AS routing,
  CASE WHEN d.decision IS NOT NULL AND NOT d.degraded THEN 'second_opinion' ELSE 'classical' END AS resolved_by, g.gate <> 'none' AND NOT (d.decision IS NOT NULL AND NOT d.degraded) AS degraded, g.confidence, g.gate
  FROM gated g LEFT JOIN decisions d USING (claim_id))"""


def _gated(spark, sf_dir):
    return _routed(spark, sf_dir).withColumn("gate", routing.gate_reason(F.col("routing")))


def _cascade(spark, sf_dir):
    gated = _gated(spark, sf_dir)
    name = F.array(*[F.lit(b) for b in BUCKETS])
    decisions = gated.where((F.col("gate") != "none") & (F.col("claim_id") % 17 != 0)).select("claim_id", name[(F.col("claim_id") % 11 % 3).cast("int")].alias("decision"), (F.col("claim_id") % 13 == 0).alias("degraded"))
    return routing.cascade(gated, decisions)


@query(f"WITH {CLAIMS}, {ROUTED}, {GATE} SELECT gate, count(*) AS n FROM gated GROUP BY 1")
def gate_reason(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("gate").agg(F.count("*").alias("n"))


@query(CASCADE + " SELECT claim_id, classical, routing, resolved_by, degraded FROM resolved")
def cascade_outcome(spark, sf_dir):
    return _cascade(spark, sf_dir)


@query(CASCADE + " SELECT count(*) AS n, count(*) FILTER (resolved_by = 'second_opinion') AS resolved, count(*) FILTER (degraded) AS degraded, round(CAST(count(*) FILTER (resolved_by = 'second_opinion') AS DOUBLE) / count(*), 6) AS rate, count(*) FILTER (resolved_by = 'second_opinion' AND routing = classical) AS upheld, count(*) FILTER (resolved_by = 'second_opinion' AND routing <> classical) AS overrode FROM resolved")
def routing_summary(spark, sf_dir):
    opinion = F.col("resolved_by") == "second_opinion"
    return _cascade(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(opinion).alias("resolved"), F.count_if("degraded").alias("degraded"), F.round(F.coalesce(F.try_divide(F.count_if(opinion), F.count("*")), F.lit(0.0)), 6).alias("rate"),
        F.count_if(opinion & (F.col("routing") == F.col("classical"))).alias("upheld"), F.count_if(opinion & (F.col("routing") != F.col("classical"))).alias("overrode"),
    )


@query(CASCADE + " SELECT claim_id FROM resolved WHERE resolved_by = 'second_opinion' AND routing <> classical AND confidence >= 0.7")
def hard_negatives(spark, sf_dir):
    outcome = _cascade(spark, sf_dir).join(X.claims(spark, sf_dir).select("claim_id", "confidence"), "claim_id")
    return evals.hard_negatives(outcome).select("claim_id")


@query(SCORED + """, g AS (SELECT CAST(f AS DOUBLE) AS flag, CAST(e AS DOUBLE) AS escalate FROM (VALUES (0.4),(0.5),(0.6)) a(f), (VALUES (0.5),(0.7),(0.8)) b(e) WHERE f < e),
s AS (SELECT flag, escalate, avg(CASE WHEN r >= escalate THEN 1.0 ELSE 0.0 END) AS es, avg(CASE WHEN r >= flag AND r < escalate THEN 1.0 ELSE 0.0 END) AS fs FROM (SELECT round(r, 4) AS r FROM raw), g GROUP BY 1, 2)
SELECT flag, escalate, round(fs, 6) AS flag_share, round(es, 6) AS escalate_share, round(abs(es - 0.13) + 0.25 * greatest(fs - 0.35, 0.0), 6) AS penalty FROM s""")
def threshold_sweep(spark, sf_dir):
    return evals.threshold_sweep(routing.scored(X.claims(spark, sf_dir)), [0.4, 0.5, 0.6], [0.5, 0.7, 0.8])


# Trust and calibration

EVIDENCE = f"WITH {CLAIMS}, {LOGITS}, ev AS (SELECT claim_id, list_transform(z, lambda x: greatest(x, 0.0) + ln(1 + exp(-abs(x)))) AS e FROM logits), st AS (SELECT claim_id, e, list_sum(e) + 6 AS s FROM ev)"


@query(EVIDENCE + " SELECT claim_id, round((list_max(e) + 1) / s, 6) AS confidence, round(6 / s, 6) AS vacuity FROM st")
def trust_triple(spark, sf_dir):
    e = X.logits(spark, sf_dir).select("claim_id", trust.evidence(F.col("z")).alias("e"))
    return e.select("claim_id", F.round(trust.confidence(F.col("e")), 6).alias("confidence"), F.round(trust.vacuity(F.col("e")), 6).alias("vacuity"))


@query(EVIDENCE + """, b AS (SELECT claim_id, unnest(range(1, 7)) AS i, list_transform(e, lambda x: x / s) AS b FROM st),
o AS (SELECT x.claim_id, x.i, any_value(x.b[x.i]) AS bi, sum(CASE WHEN j <> x.i THEN x.b[j] ELSE 0 END) AS t, sum(CASE WHEN j <> x.i THEN x.b[j] * (1 - abs(x.b[x.i] - x.b[j]) / (x.b[x.i] + x.b[j] + 1e-10)) ELSE 0 END) AS w FROM b x, range(1, 7) r(j) GROUP BY 1, 2)
SELECT claim_id, round(sum(bi * w / (t + 1e-10)), 6) AS dissonance FROM o GROUP BY 1""")
def dissonance(spark, sf_dir):
    e = X.logits(spark, sf_dir).select("claim_id", trust.evidence(F.col("z")).alias("e"))
    return e.select("claim_id", F.round(trust.dissonance(F.col("e")), 6).alias("dissonance"))


@query(EVIDENCE.replace("list_transform(z, lambda x: greatest", "list_transform(list_transform(z, lambda y: y / 2.0), lambda x: greatest") + " SELECT claim_id, round((list_max(e) + 1) / s, 6) AS confidence FROM st")
def rescored_confidence(spark, sf_dir):
    z = trust.at_temperature(F.col("z"), 2.0)
    e = X.logits(spark, sf_dir).select("claim_id", trust.evidence(z).alias("e"))
    return e.select("claim_id", F.round(trust.confidence(F.col("e")), 6).alias("confidence"))


BINNED = f"WITH {CLAIMS}, {CASES}, b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, confidence AS c, CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END AS y FROM cases)"


@query(BINNED + " SELECT CAST(r.i AS INTEGER) AS bin, count(c) AS n, round(coalesce(avg(c), 0), 6) AS conf, CAST(round(coalesce(avg(y), 0), 6) AS DOUBLE) AS acc FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return evals.reliability_bins(X.eval_cases(spark, sf_dir), F.col("confidence"), F.col("truth") == F.col("predicted"))


@query(BINNED + ", g AS (SELECT bin, count(*) AS n, abs(avg(c) - avg(y)) AS gap, sum((c - y) * (c - y)) AS sq FROM b GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM g")
def ece_mce_brier(spark, sf_dir):
    return evals.calibration_error(X.eval_cases(spark, sf_dir), F.col("confidence"), F.col("truth") == F.col("predicted"))


@query(f"WITH {CLAIMS}, {SNAPSHOTS} SELECT p.org_id, p.day, b.temperature FROM (SELECT * FROM snapshots WHERE label = 'post') p ASOF LEFT JOIN (SELECT * FROM snapshots WHERE label = 'baseline') b ON p.org_id = b.org_id AND p.day >= b.day")
def asof_baseline(spark, sf_dir):
    s = X.snapshots(spark, sf_dir)
    return evals.latest_as_of(s.where("label = 'post'").select("org_id", "day"), s.where("label = 'baseline'").select("org_id", "day", "temperature"), "org_id", "day", "temperature")


@query(f"WITH {CLAIMS}, {SNAPSHOTS} SELECT org_id, max_by(temperature, day) AS temperature FROM snapshots GROUP BY 1")
def latest_temperature(spark, sf_dir):
    return X.snapshots(spark, sf_dir).groupBy("org_id").agg(F.max_by("temperature", "day").alias("temperature"))


@query()
def fitted_temperature(spark, sf_dir):
    z = X.logits(spark, sf_dir).withColumn("target", (F.col("claim_id") % 6).cast("int"))
    return spark.createDataFrame([(evals.fitted_temperature(z, "target"),)], "temperature double")


# Evaluation


@query(f"WITH {CLAIMS}, {CASES} SELECT truth, count(*) FILTER (predicted = 'auto_file') AS auto_file, count(*) FILTER (predicted = 'flag') AS flag, count(*) FILTER (predicted = 'escalate') AS escalate FROM cases GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return evals.confusion(X.eval_cases(spark, sf_dir), BUCKETS)


@query(f"WITH {CLAIMS}, {CASES}, s AS (SELECT l.label, count(*) FILTER (truth = label AND predicted = label) AS h, count(*) FILTER (predicted = label) AS p, count(*) FILTER (truth = label) AS t FROM cases, (VALUES ('auto_file'),('flag'),('escalate')) l(label) GROUP BY 1) SELECT label, round(h / p, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (p + t), 6) AS f1, t AS support FROM s")
def per_class_prf(spark, sf_dir):
    return evals.per_class(X.eval_cases(spark, sf_dir), BUCKETS)


@query(f"WITH {CLAIMS}, {CASES}, a AS (SELECT *, CASE WHEN claim_id % 3 > 0 THEN CASE claim_id % 4 % 3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END END AS classical, CASE WHEN claim_id % 5 = 0 THEN truth END AS opinion FROM cases) SELECT count(*) AS n, round(avg(CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END), 6) AS cascade, round(avg(CASE WHEN coalesce(classical, predicted) = truth THEN 1.0 ELSE 0.0 END), 6) AS classical, round(avg(CASE WHEN coalesce(opinion, predicted) = truth THEN 1.0 ELSE 0.0 END), 6) AS opinion_on_all FROM a")
def cascade_arms(spark, sf_dir):
    name = F.array(*[F.lit(b) for b in BUCKETS])
    cases = X.eval_cases(spark, sf_dir).withColumns({"classical": F.when(F.col("claim_id") % 3 > 0, name[(F.col("claim_id") % 4 % 3).cast("int")]), "opinion": F.when(F.col("claim_id") % 5 == 0, F.col("truth"))})
    return evals.arms(cases)


@query(f"WITH {CLAIMS}, {CASES} SELECT claim_id, truth, predicted FROM cases WHERE truth <> predicted ORDER BY claim_id % 9 <> 0, claim_id LIMIT 6")
def documented_failures(spark, sf_dir):
    cases = X.eval_cases(spark, sf_dir).withColumn("note", F.when(F.col("claim_id") % 9 == 0, "noted"))
    return cases.where("truth <> predicted").orderBy(F.col("note").isNull(), "claim_id").limit(6).select("claim_id", "truth", "predicted")


INSTABILITY = "least(CAST(0.5 AS DOUBLE) * CAST(flipped AS INTEGER) + CAST(0.3 AS DOUBLE) * CAST(lost AS INTEGER) + CAST(0.2 AS DOUBLE) * least(abs(delta), 1), 1)"


@query(f"WITH {CLAIMS}, {TRIALS} SELECT claim_id, round(avg({INSTABILITY}), 6) AS fragility FROM trials GROUP BY 1")
def fragility_scores(spark, sf_dir):
    return evals.fragility(X.trials(spark, sf_dir))


@query(f"WITH {CLAIMS}, {TRIALS} SELECT family, count(*) AS n, round(avg(CAST(flipped AS INTEGER)), 6) AS flip_rate, round(avg(least(abs(delta), 1)), 6) AS mean_change, round(avg(CAST(lost AS INTEGER)), 6) AS loss_rate FROM trials GROUP BY 1")
def perturbation_stats(spark, sf_dir):
    return evals.by_family(X.trials(spark, sf_dir))


@query(f"WITH {CLAIMS}, {TRIALS}, c AS (SELECT claim_id, vacuity, avg({INSTABILITY}) AS f, count(*) AS n, count(*) FILTER (flipped) AS k FROM trials GROUP BY 1, 2), q AS (SELECT *, least(floor(4 * (rank() OVER (ORDER BY vacuity) - 1) / count(*) OVER ()) + 1, 4) AS quartile FROM c) SELECT CAST(quartile AS INTEGER) AS quartile, count(*) AS n, round(avg(f), 6) AS mean_fragility, round(CAST(sum(k) AS DOUBLE) / sum(n), 6) AS flip_rate FROM q GROUP BY 1")
def vacuity_quartiles(spark, sf_dir):
    return evals.quartile_table(X.trials(spark, sf_dir))


@query(f"WITH {CLAIMS}, r AS (SELECT vacuity, confidence, rank() OVER (ORDER BY vacuity) + (count(*) OVER (PARTITION BY vacuity) - 1) / 2 AS a, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS b FROM claims) SELECT count(*) AS n, round(corr(vacuity, confidence), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r")
def spearman_pearson(spark, sf_dir):
    return evals.correlations(X.claims(spark, sf_dir), "vacuity", "confidence")


@query(f"WITH {CLAIMS} SELECT round(regr_slope(confidence, vacuity), 6) AS slope, round(regr_intercept(confidence, vacuity), 6) AS intercept FROM claims")
def ols_trend(spark, sf_dir):
    return evals.trend(X.claims(spark, sf_dir), "vacuity", "confidence")


@query(f"WITH {CLAIMS}, o AS (SELECT relation, vacuity, row_number() OVER (PARTITION BY relation ORDER BY vacuity) - 1 AS i, count(*) OVER (PARTITION BY relation) AS n FROM claims) SELECT relation, vacuity AS p95 FROM o WHERE i = floor(0.95 * (n - 1))")
def latency_percentiles(spark, sf_dir):
    return evals.lower_percentile(X.claims(spark, sf_dir), ["relation"], "vacuity", 0.95)


# Spans and texts

WORDS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS surface, generate_subscripts(string_split(text, ' '), 1) - 1 AS tok_idx FROM documents),
words AS (SELECT doc_id, tok_idx, surface, coalesce(sum(length(surface) + 1) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)"""


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n, CAST(max(s + length(surface)) AS BIGINT) AS last_end, CAST(sum(s) AS BIGINT) AS starts FROM words GROUP BY 1")
def word_offsets(spark, sf_dir):
    w = spans.words(table(spark, sf_dir, "documents"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("char_end").alias("last_end"), F.sum("char_start").alias("starts"))


@query("SELECT doc_id FROM documents WHERE false")
def broken_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spans.broken_offsets(spans.words(docs), docs).select("doc_id").distinct()


@query(f"""WITH {WORDS}, t AS (SELECT doc_id, tok_idx, CASE length(surface) % 4 WHEN 0 THEN 'B-ORG' WHEN 1 THEN 'I-ORG' WHEN 2 THEN 'I-PERSON' ELSE 'O' END AS tag, CAST(length(surface) % 9 + 1 AS DOUBLE) / 10 AS conf FROM words),
o AS (SELECT *, CASE WHEN tag = 'O' THEN 0 WHEN tag LIKE 'I-%' AND coalesce(substr(lag(tag) OVER (PARTITION BY doc_id ORDER BY tok_idx), 3), '') = substr(tag, 3) THEN 0 ELSE 1 END AS op FROM t),
s AS (SELECT *, sum(op) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS span FROM o)
SELECT doc_id, min(tok_idx) AS tok_start, max(tok_idx) + 1 AS tok_end, any_value(substr(tag, 3)) AS kind, round(exp(avg(ln(conf))), 6) AS conf FROM s WHERE tag <> 'O' GROUP BY doc_id, span""")
def bio_islands(spark, sf_dir):
    length = F.length("surface")
    tag = F.element_at(F.array(F.lit("B-ORG"), F.lit("I-ORG"), F.lit("I-PERSON"), F.lit("O")), length % 4 + 1)
    tokens = spans.surfaces(table(spark, sf_dir, "documents")).select("doc_id", "tok_idx", tag.alias("tag"), ((length % 9 + 1).cast("double") / 10).alias("conf"))
    return spans.islands(tokens).withColumns({"tok_start": F.col("tok_start").cast("long"), "tok_end": F.col("tok_end").cast("long")})


SPANS = "a AS (SELECT l_orderkey AS key, l_linenumber * 100 + l_partkey % 150 AS s, l_linenumber * 100 + l_partkey % 150 + l_suppkey % 90 + 1 AS e FROM lineitem)"


def _spans(spark, sf_dir):
    start = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 150).alias("start")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), start, (start + F.col("l_suppkey") % 90 + 1).alias("end"))


@query(f"WITH {SPANS} SELECT x.key, x.s AS start, x.e AS \"end\", y.s AS start2, y.e AS end2 FROM a x JOIN a y ON x.key = y.key AND x.s < y.e AND x.e > y.s AND x.s < y.s")
def span_overlap_join(spark, sf_dir):
    a = _spans(spark, sf_dir)
    return spans.overlapping_pairs(a, "key")


@query(f"WITH {SPANS}, v AS (SELECT key, s AS pos, 1 AS d FROM a UNION ALL SELECT key, e, -1 FROM a), g AS (SELECT key, pos, sum(d) AS d FROM v GROUP BY 1, 2), w AS (SELECT key, pos AS start, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS \"end\", CAST(sum(d) OVER (PARTITION BY key ORDER BY pos) AS BIGINT) AS depth FROM g) SELECT * FROM w WHERE \"end\" IS NOT NULL AND depth > 0")
def boundary_segments(spark, sf_dir):
    return spans.boundary_segments(_spans(spark, sf_dir), "key")


@query(f"WITH {CLAIMS}, e AS (SELECT document_id AS doc_id, object_id AS dst, claim_id, confidence * 4 - vacuity AS score FROM claims) SELECT claim_id, round(exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w), 6) AS weight FROM e WINDOW w AS (PARTITION BY doc_id, dst)")
def segment_softmax(spark, sf_dir):
    e = X.claims(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.col("object_id").alias("dst"), "claim_id", (F.col("confidence") * 4 - F.col("vacuity")).alias("score"))
    return spans.segment_softmax(e).select("claim_id", F.round("weight", 6).alias("weight"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.stripped_html(F.col("html"))).cast("long").alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), o AS (SELECT doc_id, line, length(v) AS n, coalesce(sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(s AS BIGINT) AS char_start, CAST(s + n AS BIGINT) AS char_end FROM o")
def csv_row_offsets(spark, sf_dir):
    return sources.csv_offsets(table(spark, sf_dir, "documents"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def dedupe_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    first = docs.where("doc_id % 2 = 1").groupBy("content_sha").agg(F.min("doc_id").alias("doc_id"))
    return sources.new_documents(first, docs.where("doc_id % 2 = 0"))


# Entities


@query("SELECT c_custkey, regexp_replace(regexp_replace(trim(regexp_replace(lower(c_name), '[^0-9a-z& ]+', ' ', 'g')), '\\s+', ' ', 'g'), '(\\s+(inc|ltd|llc|corp|co|company|group|holdings|plc|gmbh|ag|sa))+$', '') AS name FROM customer")
def name_normalise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalized_name(F.col("c_name")).alias("name"))


NAMES = "n AS (SELECT p_partkey AS id, ' ' || trim(regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z& ]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS p FROM part), g AS (SELECT DISTINCT id, substr(p, CAST(i AS INTEGER), 3) AS gram FROM n, LATERAL (SELECT unnest(range(1, length(p) - 1)) AS i))"


@query(f"WITH {NAMES} SELECT gram, count(*) AS df, round(ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1, 6) AS idf FROM g GROUP BY 1")
def idf_table(spark, sf_dir):
    return entities.idf(table(spark, sf_dir, "part"), "p_name")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, arg_max(vec_id, (cosine, -vec_id)) AS vec_id, round(max(cosine), 6) AS cosine FROM c GROUP BY 1")
def nearest_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return entities.nearest(v, v.where("vec_id % 20 = 0"))


@query("""WITH c AS (SELECT p_brand AS key, p_type AS surface, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT key, arg_max(surface, (n, length(surface), surface)) AS canonical, sum(n) AS m FROM c GROUP BY 1)
SELECT b.key, b.canonical, coalesce((SELECT string_agg(surface, '|' ORDER BY n DESC, surface) FROM c WHERE c.key = b.key AND c.surface <> b.canonical), '') AS aliases, CAST(b.m AS BIGINT) AS mention_count FROM b""")
def canonical_alias(spark, sf_dir):
    return entities.canonical(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("surface")))


@query("SELECT s_suppkey FROM supplier WHERE list_contains(regexp_split_to_array(lower(s_name), '[^0-9a-z]+'), '000000007') OR list_contains(regexp_split_to_array(lower(s_name), '[^0-9a-z]+'), '7')")
def entity_match(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return entities.matched(names, ["000000007", "7", "Ltd"]).select("s_suppkey")


@query(f"WITH {CLAIMS}, {ROUTED}, t AS (SELECT *, row_number() OVER (ORDER BY CASE routing WHEN 'escalate' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END DESC, confidence DESC, claim_id) AS place FROM routed QUALIFY place <= 8), s AS (SELECT claim_id, place, 'Claim ' || claim_id || ': ' || relation || ' between ' || subject_id || ' and ' || object_id || '.' AS sentence FROM t), d AS (SELECT *, floor(length(sentence) / 13.5 * 1000) AS ms FROM s) SELECT claim_id, CAST(place AS INTEGER) AS place, sentence, CAST(coalesce(sum(ms) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, CAST(sum(ms) OVER (ORDER BY place) AS BIGINT) AS end_ms FROM d")
def briefing_ranked(spark, sf_dir):
    return entities.briefing(_routed(spark, sf_dir), 8)


# Streams, as tables


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    out = feeds.tumbling(table(spark, sf_dir, "events"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)})


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_activity(spark, sf_dir):
    return feeds.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_buckets(spark, sf_dir):
    return feeds.rates(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def change_feed(spark, sf_dir):
    return feeds.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE f AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id, i, t AS first, 1 AS n FROM f WHERE i = 1 UNION ALL
  SELECT f.user_id, f.event_id, f.i, CASE WHEN f.t - r.first > 900000000 THEN f.t ELSE r.first END, CASE WHEN f.t - r.first > 900000000 THEN 1 ELSE r.n + 1 END FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)
SELECT user_id, event_id, CAST(n AS INTEGER) AS failures, n >= 5 AS locked FROM r""")
def failure_lockout(spark, sf_dir):
    return feeds.lockouts(table(spark, sf_dir, "events").where("event_type = 'error'"))


# Training reports and vocabularies


@query(f"WITH {CLAIMS}, p AS (SELECT DISTINCT document_id, subject_id, relation FROM claims WHERE claim_id % 3 > 0), g AS (SELECT DISTINCT document_id, subject_id, relation FROM claims WHERE claim_id % 4 > 0), s AS (SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS hit) SELECT hit, round(hit / p, 6) AS precision, round(hit / g, 6) AS recall, round(2 * hit / (p + g), 6) AS f1 FROM s")
def triple_scores(spark, sf_dir):
    claims = X.claims(spark, sf_dir)
    return evals.span_scores(claims.where("claim_id % 3 > 0"), claims.where("claim_id % 4 > 0"), ["document_id", "subject_id", "relation"])


@query(f"WITH {CLAIMS}, c AS (SELECT relation, count(*) AS n FROM claims GROUP BY 1) SELECT relation, round(least(4.0, sqrt(sum(n) OVER () / (count(*) OVER () * n))), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return evals.class_weights(X.claims(spark, sf_dir), "relation")


@query(f"WITH {CLAIMS}, b AS (SELECT CASE claim_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS band, vacuity, confidence FROM claims), m AS (SELECT band, count(*) AS n, avg(vacuity) AS m, round(avg(confidence), 6) AS mean_confidence FROM b GROUP BY 1), o AS (SELECT band, vacuity, row_number() OVER (PARTITION BY band ORDER BY vacuity) - 1 AS i, count(*) OVER (PARTITION BY band) AS n FROM b) SELECT m.band, m.n, round(m.m, 6) AS mean, o.vacuity AS p90, m.mean_confidence, coalesce(m.m >= lag(m.m) OVER (ORDER BY m.band), true) AS rises FROM m JOIN o ON o.band = m.band AND o.i = floor(0.9 * (o.n - 1))")
def band_summary(spark, sf_dir):
    band = F.element_at(F.array(*[F.lit(b) for b in "ABCD"]), (F.col("claim_id") % 4 + 1).cast("int"))
    return evals.band_summary(X.claims(spark, sf_dir).withColumn("band", band), "band", "vacuity", "confidence")


@query("WITH w AS (SELECT regexp_replace(lower(unnest(string_split(p_type, ' '))), '[0-9]', '0', 'g') AS word FROM part) SELECT word, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, word) AS INTEGER) AS id FROM w GROUP BY 1 HAVING count(*) >= 2")
def word_vocabulary(spark, sf_dir):
    return entities.vocabulary(table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("surface")))


@query("WITH m AS (SELECT o_custkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PERSON' ELSE 'ACCOUNT' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2) SELECT key, kind FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, CASE kind WHEN 'ORG' THEN 2 WHEN 'PERSON' THEN 1 ELSE 0 END DESC, kind DESC) = 1")
def type_vote(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("ORG"), F.lit("PERSON"), F.lit("ACCOUNT")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return entities.type_votes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), kind.alias("kind")))


@query()
def perturbed_texts(spark, sf_dir):
    """Five variants of each document's first sentence, with the tracked span moved along."""
    from claimloom.operators import fuzz

    first = F.regexp_extract("text", r"(?s)^.*?[.!?](?=\s|$)", 0)
    first = F.when(F.length(first) > 0, first).otherwise(F.col("text"))
    names = F.array_distinct(F.regexp_extract_all(first, F.lit(r"\b\p{Lu}\p{Ll}{3,}\b"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text", F.lit(0).alias("char_start"), F.length(first).alias("char_end"), names.alias("names"))
    return fuzz.variants(docs).select("claim_id", "perturbation", "variant", "char_start", "char_end", F.sha2("text", 256).alias("text_sha"))


@query()
def resolved_names(spark, sf_dir):
    """Part names resolved in order within a tenant for each size."""
    from claimloom.operators import resolve

    names = table(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("int").alias("org_id"), F.col("p_partkey").cast("long").alias("position"), F.col("p_name").alias("surface"))
    return resolve.resolved(names).select("org_id", "position", "entity_id", "method")


# The queries of the other modules register themselves; they use this one's.
from claimloom.plans import evaluation, language, requests  # noqa: E402, F401
