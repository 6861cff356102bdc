"""Claim-shaped tables derived from the driver tables by integer arithmetic, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.functions import tokens as token_functions

#: Perturbation families in order, and the three outcomes of routing by severity.
FAMILIES = ("synonym", "rename", "boilerplate", "reorder", "punctuation")
BUCKETS = ("auto_file", "flag", "escalate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share(factor: int, parts: int = 100):
    return (F.col("event_id") * factor % 101).cast("double") / float(parts)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each event but those whose two ends are the same, which are no claims.

    A user stands for sixteen entities, and a claim points into the user's neighbourhood of eight,
    so that the graph stays sparse at any size and the whole of it can be walked.
    """
    relation = F.create_map(*[F.lit(x) for pair in (("error", "OWNED_BY"), ("purchase", "WIRED_FUNDS_TO"), ("click", "INVOICED"), ("signup", "SIGNATORY_OF")) for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("claim_id"),
        F.when(F.col("event_id") % 10 == 9, 1).otherwise(0).alias("org_id"),
        (F.col("event_id") % 200).alias("document_id"),
        (F.col("user_id") * 16 + F.col("event_id") % 16).alias("subject_id"),
        F.expr("(user_id - user_id % 8 + (event_id * 5 + user_id * 3 + 1) % 8) * 16 + (event_id div 16) % 16").alias("object_id"),
        F.coalesce(relation[F.col("event_type")], F.lit("SHARES_ADDRESS_WITH")).alias("relation"),
        _share(37).alias("confidence"),
        _share(53).alias("vacuity"),
        _share(71, 200).alias("dissonance"),
        F.col("ts").alias("created_at"),
    ).where("subject_id <> object_id")


CLAIMS = """claims AS (
  SELECT event_id AS claim_id, CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS org_id, event_id % 200 AS document_id,
         user_id * 16 + event_id % 16 AS subject_id, (user_id - user_id % 8 + (event_id * 5 + user_id * 3 + 1) % 8) * 16 + (event_id // 16) % 16 AS object_id,
         CASE event_type WHEN 'error' THEN 'OWNED_BY' WHEN 'purchase' THEN 'WIRED_FUNDS_TO' WHEN 'click' THEN 'INVOICED'
              WHEN 'signup' THEN 'SIGNATORY_OF' ELSE 'SHARES_ADDRESS_WITH' END AS relation,
         CAST((event_id*37)%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence,
         CAST((event_id*53)%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS vacuity,
         CAST((event_id*71)%101 AS DOUBLE)/CAST(200 AS DOUBLE) AS dissonance, ts AS created_at
  FROM events WHERE user_id * 16 + event_id % 16 <> (user_id - user_id % 8 + (event_id * 5 + user_id * 3 + 1) % 8) * 16 + (event_id // 16) % 16)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES)]))
    mark = F.col("claim_id") * 7 + F.col("f.k") * 31
    return (
        claims(spark, sf_dir)
        .select("claim_id", "vacuity", "confidence", families.alias("f"))
        .select(
            "claim_id", "vacuity", "confidence", F.col("f.k").alias("k"), F.col("f.family").alias("family"),
            (mark % 11 == 0).alias("flipped"), (mark % 22 == 0).alias("lost"),
            (((F.col("claim_id") * 29 + F.col("f.k") * 17) % 101 - 50).cast("double") / 100.0).alias("delta"),
        )
    )


TRIALS = """trials AS (
  SELECT claim_id, vacuity, confidence, k, family, (claim_id*7+k*31)%11 = 0 AS flipped, (claim_id*7+k*31)%22 = 0 AS lost,
         CAST((claim_id*29+k*17)%101-50 AS DOUBLE)/CAST(100 AS DOUBLE) AS delta
  FROM claims, (VALUES (0,'synonym'),(1,'rename'),(2,'boilerplate'),(3,'reorder'),(4,'punctuation')) f(k,family))"""


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array(*[F.lit(b) for b in BUCKETS])
    return claims(spark, sf_dir).select("*", name[(F.col("claim_id") % 7 % 3).cast("int")].alias("truth"), name[(F.col("claim_id") % 5 % 3).cast("int")].alias("predicted"))


CASES = """cases AS (
  SELECT *, CASE claim_id%7%3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END AS truth,
            CASE claim_id%5%3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END AS predicted
  FROM claims)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", F.array(*[((F.col("claim_id") * (11 + 2 * i)) % 97).cast("double") / 12.0 - 4.0 for i in range(6)]).alias("z"))


LOGITS = "logits AS (SELECT claim_id, [" + ",".join(f"CAST((claim_id*{11 + 2 * i})%97 AS DOUBLE)/CAST(12 AS DOUBLE)-CAST(4 AS DOUBLE)" for i in range(6)) + "] AS z FROM claims)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tenant and day, labelled post and baseline in turn."""
    day = F.to_date("created_at")
    daily = claims(spark, sf_dir).groupBy("org_id", day.alias("day")).agg(F.count("*").alias("n_cases"))
    number = F.row_number().over(W.partitionBy("org_id").orderBy("day"))
    return daily.withColumn("number", number).select("org_id", "day", "n_cases", F.when(F.col("number") % 2 == 0, "post").otherwise("baseline").alias("label"), (F.lit(0.5) + (F.col("n_cases") % 40).cast("double") / 20.0).alias("temperature"))


SNAPSHOTS = """daily AS (SELECT org_id, CAST(created_at AS DATE) AS day, count(*) AS n_cases FROM claims GROUP BY 1, 2),
snapshots AS (SELECT org_id, day, n_cases, CASE WHEN row_number() OVER (PARTITION BY org_id ORDER BY day) % 2 = 0 THEN 'post' ELSE 'baseline' END AS label,
              CAST(0.5 AS DOUBLE) + CAST(n_cases % 40 AS DOUBLE)/CAST(20 AS DOUBLE) AS temperature FROM daily)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mentions for each claim, of its subject and of its object."""
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subject_id").alias("entity_id")), F.struct(F.lit(1).alias("side"), F.col("object_id").alias("entity_id")))).alias("m")
    rows = claims(spark, sf_dir).select("claim_id", "document_id", side)
    start = F.col("claim_id") * 37 % 4000 + F.col("m.side") * 25
    return rows.select(
        (F.col("claim_id") * 2 + F.col("m.side")).alias("mention_id"), "claim_id", "document_id", F.col("m.entity_id").alias("entity_id"),
        F.concat(F.lit("Entity "), (F.col("m.entity_id") % 50).cast("string")).alias("surface"), start.alias("char_start"), (start + 4 + F.col("claim_id") % 9).alias("char_end"),
        F.element_at(F.array(F.lit("PERSON"), F.lit("ORG"), F.lit("ORG"), F.lit("ACCOUNT")), (F.col("m.entity_id") % 4 + 1).cast("int")).alias("entity_type"),
    )


KIND = "CASE {0} % 4 WHEN 0 THEN 'PERSON' WHEN 3 THEN 'ACCOUNT' ELSE 'ORG' END"
MENTIONS = f"""mentions AS (
  SELECT claim_id*2 + side AS mention_id, claim_id, document_id, entity_id, 'Entity ' || (entity_id % 50) AS surface,
         claim_id*37 % 4000 + side*25 AS char_start, claim_id*37 % 4000 + side*25 + 4 + claim_id % 9 AS char_end, {KIND.format("entity_id")} AS entity_type
  FROM (SELECT claim_id, document_id, 0 AS side, subject_id AS entity_id FROM claims UNION ALL SELECT claim_id, document_id, 1, object_id FROM claims))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = claims(spark, sf_dir).select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    kind = F.element_at(F.array(F.lit("PERSON"), F.lit("ORG"), F.lit("ORG"), F.lit("ACCOUNT")), (F.col("entity_id") % 4 + 1).cast("int"))
    return ids.select("entity_id", F.concat(F.lit("Entity "), F.col("entity_id").cast("string")).alias("canonical"), kind.alias("entity_type"))


ENTITIES = f"""entities AS (SELECT entity_id, 'Entity ' || entity_id AS canonical, {KIND.format("entity_id")} AS entity_type
  FROM (SELECT subject_id AS entity_id FROM claims UNION SELECT object_id FROM claims))"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), "source", "text", F.concat(F.lit("Document_"), F.col("doc_id").cast("string")).alias("title"))


TITLED = "titled AS (SELECT doc_id AS document_id, source, text, 'Document_' || doc_id AS title FROM documents)"


def _claimed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = claims(spark, sf_dir).select(F.col("document_id").alias("doc_id")).distinct()
    return table(spark, sf_dir, "documents").join(docs, "doc_id", "left_semi")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that claims come from, with their sentences."""
    found = token_functions.tokens(_claimed_texts(spark, sf_dir)).withColumnsRenamed({"doc_id": "document_id", "char_start": "tok_start", "char_end": "tok_end"})
    return found.select("document_id", "tok_idx", "sent", "surface", "tok_start", "tok_end")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_functions.sentences_in(_claimed_texts(spark, sf_dir)).withColumnRenamed("doc_id", "document_id")


GOES_ON = ",".join(f"'{w}'" for w in token_functions.GOES_ON)
SHORTENED = ",".join(f"'{w}'" for w in token_functions.SHORTENED)
#: All tokens of ``{docs}`` (document_id, text): pieces that make up the whole text, their lengths added up, white space left out.
ALL_TOKENS = rf"""parts AS (SELECT document_id, regexp_extract_all(text, '[0-9]+(?:[.,:/][0-9]+)*|[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*|[ \t\n\x0B\f\r]+|[^\p{{L}}\p{{N}} \t\n\x0B\f\r]') AS v FROM {{docs}}),
piece AS (SELECT document_id, unnest(v) AS part, generate_subscripts(v, 1) AS n FROM parts),
half AS (SELECT document_id, n, unnest(h) AS p, generate_subscripts(h, 1) AS k FROM (SELECT document_id, n, CASE WHEN regexp_full_match(part, '(?is)(.+?)(n[''’]t|[''’](?:s|re|ve|ll|d|m))')
  THEN [regexp_extract(part, '(?is)^(.+?)(n[''’]t|[''’](?:s|re|ve|ll|d|m))$', 1), regexp_extract(part, '(?is)^(.+?)(n[''’]t|[''’](?:s|re|ve|ll|d|m))$', 2)] ELSE [part] END AS h FROM piece)),
put AS (SELECT document_id, n, k, p, sum(length(p)) OVER w - length(p) AS tok_start, lag(p) OVER w AS gap FROM half WINDOW w AS (PARTITION BY document_id ORDER BY n, k)),
word AS (SELECT document_id, n, k, p AS surface, tok_start, coalesce(regexp_matches(gap, '^[ \t\n\x0B\f\r]'), false) AS spaced, coalesce(contains(gap, chr(10)), false) AND regexp_matches(gap, '^[ \t\n\x0B\f\r]') AS broke,
  coalesce(lag(p, 1) OVER w, '') AS l1, coalesce(lag(p, 2) OVER w, '') AS l2, coalesce(lag(p, 3) OVER w, '') AS l3 FROM put WHERE NOT regexp_matches(p, '^[ \t\n\x0B\f\r]') WINDOW w AS (PARTITION BY document_id ORDER BY n, k)),
closed AS (SELECT *, CASE WHEN regexp_matches(l1, '^[)\]}}"''”’]$') AND l2 IN ('.', '!', '?') THEN l2 ELSE l1 END AS e, CASE WHEN regexp_matches(l1, '^[)\]}}"''”’]$') AND l2 IN ('.', '!', '?') THEN l3 ELSE l2 END AS a FROM word),
begun AS (SELECT *, spaced AND l1 <> '' AND regexp_matches(surface, '^[\p{{Lu}}0-9(\[{{$“"'']') AND ((broke AND lower(l1) NOT IN ({GOES_ON}) AND l1 NOT IN (',', '-', '/'))
  OR (e IN ('.', '!', '?') AND (e <> '.' OR NOT (lower(a) IN ({SHORTENED}) OR regexp_matches(a, '^\p{{L}}$'))))) AS opens FROM closed),
tokens AS (SELECT document_id, CAST(row_number() OVER w - 1 AS INTEGER) AS tok_idx, CAST(sum(CAST(opens AS INTEGER)) OVER w AS INTEGER) AS sent, surface, CAST(tok_start AS INTEGER) AS tok_start, CAST(tok_start + length(surface) AS INTEGER) AS tok_end FROM begun WINDOW w AS (PARTITION BY document_id ORDER BY n, k))"""
TOKENS = ALL_TOKENS.replace("{docs}", "(SELECT doc_id AS document_id, text FROM documents WHERE doc_id IN (SELECT document_id FROM claims)) x")
SENTENCES = TOKENS + ", sentences AS (SELECT document_id, sent, min(tok_start) AS sent_start, max(tok_end) AS sent_end FROM tokens GROUP BY 1, 2)"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold relations for four claims in five; one in seven has another relation than the claim."""
    name = F.array(*[F.lit(b) for b in BUCKETS])
    rows = claims(spark, sf_dir).where("claim_id % 5 < 4")
    relation = F.when(F.col("claim_id") % 7 == 0, "INVOICED").otherwise(F.col("relation"))
    return rows.select(F.col("claim_id").alias("position"), "document_id", "subject_id", "object_id", relation.alias("relation"), name[(F.col("claim_id") % 7 % 3).cast("int")].alias("truth"), F.when(F.col("claim_id") % 9 == 0, "noted").alias("note"))


GOLD = """gold AS (SELECT claim_id AS position, document_id, subject_id, object_id, CASE WHEN claim_id % 7 = 0 THEN 'INVOICED' ELSE relation END AS relation,
  CASE claim_id%7%3 WHEN 0 THEN 'auto_file' WHEN 1 THEN 'flag' ELSE 'escalate' END AS truth, CASE WHEN claim_id % 9 = 0 THEN 'noted' END AS note FROM claims WHERE claim_id % 5 < 4)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of second opinions, one for two claims in three."""
    rows = claims(spark, sf_dir).where("claim_id % 3 > 0")
    return rows.select("claim_id", "org_id", (F.col("claim_id") * 13 % 900).cast("int").alias("latency_ms"), (F.col("claim_id") % 13 == 0).alias("degraded"), "created_at")


RUNS = "runs AS (SELECT claim_id, org_id, CAST(claim_id*13 % 900 AS INTEGER) AS latency_ms, claim_id % 13 = 0 AS degraded, created_at FROM claims WHERE claim_id % 3 > 0)"


def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three ablations of each claim, each with more masked edges than the one before."""
    rows = claims(spark, sf_dir).select("claim_id", F.explode(F.sequence(F.lit(0), (F.col("claim_id") % 3).cast("int"))).alias("k"))
    change = ((F.col("claim_id") * 19 + F.col("k") * 23) % 101 - 50).cast("double") / 200.0
    return rows.select(
        (F.col("claim_id") * 3 + F.col("k")).alias("run_id"), "claim_id", F.pow(F.lit(2), F.col("k")).cast("int").alias("edge_count"), F.when(F.col("k") % 2 == 0, "zero").otherwise("uniform").alias("mode"), change.alias("change"),
        ((F.col("claim_id") + F.col("k")) % 8 == 0).alias("routing_changed"), ((F.col("claim_id") + F.col("k")) % 20 == 0).alias("relation_changed"), (F.abs(change) > 0.10).alias("load_bearing"), F.col("k").alias("created_at"),
    )


ABLATIONS = """ablations AS (SELECT *, abs(change) > 0.10 AS load_bearing FROM (SELECT claim_id*3 + k AS run_id, claim_id, CAST(2**k AS INTEGER) AS edge_count, CASE WHEN k % 2 = 0 THEN 'zero' ELSE 'uniform' END AS mode,
  CAST((claim_id*19 + k*23) % 101 - 50 AS DOUBLE) / CAST(200 AS DOUBLE) AS change, (claim_id + k) % 8 = 0 AS routing_changed, (claim_id + k) % 20 = 0 AS relation_changed, k AS created_at
  FROM claims, range(3) r(k) WHERE k <= claim_id % 3))"""


def ingest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order, with the progress of some of its stages and the documents it is about."""
    from claimloom.operators.jobs import STATES

    share = (F.col("o_orderkey") % 101).cast("double") / 100.0
    progress = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("extracting"), share)).otherwise(F.create_map(F.lit("extracting"), F.lit(1.0), F.lit("tagging"), share))
    ids = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")), lambda k: (F.col("o_orderkey") * 3 + k * 7) % 200)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 2).cast("int").alias("org_id"), F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("state"), progress.alias("progress"), ids.alias("doc_ids"), F.col("o_orderdate").alias("created_at"))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CAST(o_custkey % 2 AS INTEGER) AS org_id, ['queued','extracting','tagging','resolving','relating','routing','done','failed'][o_orderkey % 8 + 1] AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 101 AS DOUBLE)/CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS extracting, CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 101 AS DOUBLE)/CAST(100 AS DOUBLE) END AS tagging, o_orderdate AS created_at FROM orders)"""


#: The relations that a sentence graph's values are logits of.
RELATIONS = ("NONE", "OWNED_BY", "WIRED_FUNDS_TO", "INVOICED", "SIGNATORY_OF", "SHARES_ADDRESS_WITH")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the span of the sentence that they cite."""
    return claims(spark, sf_dir).withColumns({"char_start": (F.col("claim_id") * 37 % 4000).cast("int"), "char_end": (F.col("claim_id") * 37 % 4000 + 80 + F.col("claim_id") % 9).cast("int")})


def sentence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two parties of each cited sentence as nodes; every 13th sentence has lost one."""
    own = cited(spark, sf_dir)
    pair = F.explode(F.array(F.struct(F.lit(0).alias("node"), F.col("subject_id").alias("entity_id")), F.struct(F.lit(1).alias("node"), F.col("object_id").alias("entity_id")))).alias("p")
    return own.select("claim_id", "document_id", "char_start", "char_end", pair).where("p.node = 0 OR claim_id % 13 > 0").select("document_id", "char_start", "char_end", "p.node", "p.entity_id").distinct()


def sentence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges among four nodes of each cited sentence."""
    spans = cited(spark, sf_dir).select("document_id", "char_start", "char_end").distinct()
    node = lambda c: F.explode(F.sequence(F.lit(0), F.lit(3))).alias(c)
    rows = spans.select("*", node("src")).select("*", node("dst"))
    mark = F.col("char_start") * 5 + F.col("src") * 7 + F.col("dst") * 11
    values = F.array(*[(((mark * (3 + k) + k * 29) % 61).cast("double") / 10.0 - 3.0) for k in range(len(RELATIONS))])
    return rows.select("*", ((mark % 17).cast("double") / 4.0).alias("score"), values.alias("values"))


def ablation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of every claim: one masks an edge into the subject evenly, one two edges into the parties; some ask for what is not there."""
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    rows = claims(spark, sf_dir).select("claim_id", k)
    masked = F.when(F.col("claim_id") % 19 == 0, F.array(F.lit("0->0"), F.lit("9->1"))).when(F.col("k") == 0, F.array(F.concat((F.col("claim_id") % 3 + 1).cast("string"), F.lit("->0")))).otherwise(F.array(F.lit("2->1"), F.lit("3->0")))
    return rows.select((F.col("claim_id") * 2 + F.col("k")).alias("run_id"), "claim_id", F.when(F.col("k") == 0, "uniform").otherwise("zero").alias("mode"), masked.alias("masked"))
