"""Registered queries on extraction: keys, weak labels, segments, tags, decoding and the synthetic corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from claimloom.functions import tokens as token_functions
from claimloom.functions.text import sanitized, uuid5
from claimloom.operators import entities, extraction, resolve, spans
from claimloom.plans import fixtures as X
from claimloom.plans.fixtures import CLAIMS, ENTITIES, GOES_ON, MENTIONS, table
from claimloom.plans.registry import query
from claimloom.sources import synthetic, variants
from claimloom.streaming import feeds

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
NORMAL = "regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[^0-9a-z& ]+', ' ', 'g'), '\\s+', ' ', 'g')), '(\\s+(ag|bv|co|company|corp|corporation|gmbh|group|holding|holdings|inc|incorporated|limited|llc|llp|lp|ltd|nv|partners|plc|pte|pty|sa|sarl|spa|srl))+$', '')"


@query(f"WITH {CLAIMS}, {MENTIONS} SELECT mention_id, CASE WHEN entity_type = 'ACCOUNT' THEN surface ELSE {NORMAL.format('surface')} END AS key, CASE WHEN entity_type = 'ACCOUNT' THEN 'ACCOUNT' ELSE 'NAMED' END AS space FROM mentions")
def entity_keys(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    kind = F.col("entity_type")
    return m.select("mention_id", extraction.entity_key(F.col("surface"), kind).alias("key"), extraction.id_namespace(kind).alias("space"))


@query(f"WITH {CLAIMS}, {MENTIONS} SELECT mention_id, CASE WHEN entity_id % 50 % 2 = 0 THEN entity_id % 50 END AS entity_id FROM mentions")
def looked_up_mentions(spark, sf_dir):
    kinds = spark.createDataFrame([("ORG",), ("ACCOUNT",)], "entity_type string")
    known = spark.range(0, 50, 2).join(F.broadcast(kinds)).select(F.concat(F.lit("Entity "), F.col("id").cast("string")).alias("surface"), "entity_type", F.col("id").alias("entity_id"))
    keyed = known.select(extraction.entity_key(F.col("surface"), F.col("entity_type")).alias("key"), extraction.id_namespace(F.col("entity_type")).alias("space"), "entity_id")
    return extraction.looked_up(X.mentions(spark, sf_dir).drop("entity_id"), keyed).select("mention_id", "entity_id")


@query(f"WITH {CLAIMS}, {MENTIONS} SELECT mention_id FROM mentions WHERE entity_type = 'ACCOUNT' OR mention_id % 3 > 0")
def plausible_mentions(spark, sf_dir):
    surface = F.when(F.col("mention_id") % 3 == 0, F.lower("surface")).otherwise(F.col("surface"))
    return X.mentions(spark, sf_dir).where(extraction.plausible(surface, F.col("entity_type"))).select("mention_id")


@query(f"WITH {CLAIMS} SELECT claim_id, nullif(['OWNED_BY','INVOICED','NONE'][list_position(s, list_max(s))], 'NONE') AS relation FROM (SELECT claim_id, [claim_id*7 % 13, claim_id*5 % 11, claim_id*3 % 12] AS s FROM claims)")
def decided_relations(spark, sf_dir):
    k = F.col("claim_id")
    scores = F.array(k * 7 % 13, k * 5 % 11, k * 3 % 12)
    return X.claims(spark, sf_dir).select("claim_id", extraction.decided(scores, ["OWNED_BY", "INVOICED", "NONE"]).alias("relation"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'MONEY' WHEN 1 THEN 'DATE' WHEN 2 THEN 'ORG' WHEN 3 THEN 'ORG' END AS label FROM orders")
def weak_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    surface = F.when(k == 0, F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))).when(k == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))).when(k == 2, "Acme Co").when(k == 3, "Acme Co.,").otherwise("nobody")
    gazetteer = F.create_map(F.lit("Acme Co"), F.lit("ORG"))
    return table(spark, sf_dir, "orders").select("o_orderkey", extraction.weak_match(surface, gazetteer).alias("label"))


PIECES = rf"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+\s*')) AS v, generate_subscripts(regexp_extract_all(text, '\S+\s*'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_extract(v, '^\S+') AS surface, contains(v, chr(10)) AS breaks FROM p),
o AS (SELECT *, lag(surface) OVER w AS b, lag(breaks) OVER w AS broke FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, CASE WHEN coalesce(broke, false) AND NOT (list_contains([{GOES_ON}], lower(b)) OR regexp_matches(b, '[,/-]$')) AND regexp_matches(surface, '^[\p{{Lu}}\p{{Nd}}(\[{{$“"'']') THEN 1 ELSE 0 END AS o FROM o)"""


@query(f"WITH {PIECES} SELECT doc_id, sum(o) + 1 AS segments FROM f GROUP BY 1")
def line_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))).alias("tok_idx", "v"))
    tokens = rows.select("doc_id", "tok_idx", F.regexp_extract("v", r"^\S+", 0).alias("surface"), F.contains("v", F.lit("\n")).alias("breaks"))
    return extraction.segments(tokens).groupBy("doc_id").agg((F.max("segment") + 1).alias("segments"))


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w = 'the')) AS n FROM documents")
def gazetteer_spans(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    found = extraction.greedy_spans(words, {"the": "WORD"})
    exact = F.filter("spans", lambda s: F.get(F.col("words"), s["start"]) == "the")
    return found.select("doc_id", F.size(exact).cast("long").alias("n"))


@query()
def tagged_tokens(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    start = (F.col("char_start") / 4).cast("long")
    return extraction.tags_of(m.select(F.col("document_id").alias("doc_id"), (F.col("char_start") / 100).cast("long").alias("sent"), start.alias("start"), (start + F.col("mention_id") % 3 + 1).alias("end"), F.col("entity_type").alias("kind")))


@query()
def decoded_tags(spark, sf_dir):
    z = X.logits(spark, sf_dir).join(X.claims(spark, sf_dir).select("claim_id", "document_id", "subject_id"), "claim_id")
    emissions = z.select(F.col("document_id").alias("doc_id"), (F.col("subject_id") % 40).alias("sent"), F.col("claim_id").alias("tok_idx"), F.col("z").alias("scores"))
    steps = np.arange(36).reshape(6, 6) % 7 / 3.0
    return extraction.viterbi(emissions, steps, np.zeros(6), np.zeros(6))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 2 WHEN 'ring' THEN 3 ELSE 1 END), ',') AS ids FROM part")
def encoded_words(spark, sf_dir):
    ids = F.create_map(F.lit("small"), F.lit(2), F.lit("ring"), F.lit(3))
    coded = extraction.encoded(F.split("p_name", " "), ids)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(coded, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT p_partkey, CASE WHEN length(p_type) >= 6 THEN substr(p_type, CAST(floor((length(p_type) - 6) / 2.0) AS BIGINT) + 1, 6) ELSE rpad(p_type, 6, '_') END AS cut FROM part")
def centred_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extraction.centred(F.split("p_type", ""), 6, "_"), "").alias("cut"))


@query("SELECT doc_id, CAST(length(t) + len(list_filter(string_split(t, ''), lambda c: strlen(c) = 4)) AS INTEGER) AS at FROM (SELECT doc_id, '😀' || text || '😀' AS t FROM documents)")
def utf16_offsets(spark, sf_dir):
    """The end of each text in UTF-16 units, with a character beyond the basic plane before and after it."""
    text = F.concat(F.lit("😀"), "text", F.lit("😀"))
    return table(spark, sf_dir, "documents").select("doc_id", extraction.utf16_offset(text, F.length(text)).cast("int").alias("at"))


@query("SELECT doc_id, replace(replace(trim(regexp_replace(regexp_replace(translate(text, chr(13) || chr(10) || chr(9), '   '), '[\\p{Cc}\\p{Cf}\\p{Co}]', '', 'g'), ' +', ' ', 'g')), '<<<', '< < <'), '>>>', '> > >') AS line FROM documents")
def sanitized_heads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sanitized(F.col("text"), 1_000_000_000).alias("line"))


@query("SELECT n_nationkey, substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)), 1, 8) AS head FROM nation")
def named_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(uuid5(NAMESPACE, F.col("n_name")), 1, 8).alias("head"))


@query("WITH n AS (SELECT p_partkey AS id, lower(p_name) || ' ' || lower(p_type) AS name FROM part), w AS (SELECT id, string_split(name, ' ') AS w FROM n), s AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS w FROM part) SELECT s.id AS short_id, w.id + 1000000 AS long_id FROM s JOIN w ON s.w[1] = w.w[1] AND length(s.w[1]) >= 4 AND len(s.w) < len(w.w) AND w.w[1:len(s.w)] = s.w")
def prefix_matches(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    long = part.select((F.col("p_partkey") + 1_000_000).alias("id"), F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_type")).alias("name"))
    short = part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    return entities.prefix_matches(short, long)


@query(f"WITH {CLAIMS}, {MENTIONS}, {ENTITIES} SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")
def entities_by_type(spark, sf_dir):
    return X.entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))


@query()
def merge_summary(spark, sf_dir):
    from claimloom.plans import catalog

    return resolve.summary(catalog.resolved_names(spark, sf_dir))


@query(synthetic.SQL)
def synthetic_corpus(spark, sf_dir):
    """One document for each supplier; the offsets of all mentions are those of their surfaces."""
    docs = synthetic.corpus(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")))
    return docs.select("doc_id", "band", "text", F.size("mentions").alias("n_mentions"), F.aggregate("mentions", F.lit(0), lambda a, m: a + m["char_start"]).alias("starts"))


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE false")
def corpus_violations(spark, sf_dir):
    """Documents that break the corpus's rules: there must be none."""
    return synthetic.violations(synthetic.corpus(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")))).select("doc_id")


@query("SELECT bucket, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 5 AS INTEGER) AS bucket FROM supplier) GROUP BY 1")
def assigned_documents(spark, sf_dir):
    return synthetic.assigned(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plan")), 5).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT w.start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts - INTERVAL 30 minute) + INTERVAL 30 minute]) AS start FROM events) w GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    out = feeds.sliding(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


ALL = X.ALL_TOKENS.replace("{docs}", "(SELECT doc_id AS document_id, text FROM documents) x")


@query(f"WITH {ALL} SELECT document_id AS doc_id, tok_idx, sent, surface, tok_start AS char_start, tok_end AS char_end FROM tokens")
def document_tokens(spark, sf_dir):
    """Every token of every document."""
    return token_functions.tokens(table(spark, sf_dir, "documents")).select("doc_id", "tok_idx", "sent", "surface", "char_start", "char_end")


@query(f"WITH {ALL} SELECT document_id AS doc_id, sent, min(tok_start) AS sent_start, max(tok_end) AS sent_end FROM tokens GROUP BY 1, 2")
def document_sentences(spark, sf_dir):
    return token_functions.sentences_in(table(spark, sf_dir, "documents"))


@query(f"WITH {ALL}, s AS (SELECT document_id, tok_idx, surface, CASE WHEN tok_idx % 97 = 5 THEN tok_start + 1 ELSE tok_start END AS a, CASE WHEN tok_idx % 97 = 5 THEN tok_end + 1 ELSE tok_end END AS b FROM tokens) SELECT doc_id, tok_idx FROM s JOIN documents ON doc_id = document_id WHERE substr(text, a + 1, b - a) <> surface")
def spoiled_offsets(spark, sf_dir):
    """Tokens whose text is not where they say; every 97th offset is one too large, which the check finds."""
    docs = table(spark, sf_dir, "documents")
    found = token_functions.tokens(docs)
    off = F.when(F.col("tok_idx") % 97 == 5, 1).otherwise(0)
    moved = found.withColumns({"char_start": F.col("char_start") + off, "char_end": F.col("char_end") + off})
    return spans.broken_offsets(moved, docs).select("doc_id", "tok_idx")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 2) WHEN event_id % 10 = 1 THEN replace(props, '}', ', "tags": ["a", "b' || (event_id % 7) || '"]}') ELSE props END AS j FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN j END AS j FROM e)
SELECT event_id, CAST(json_extract(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.tags[1]') AS tag FROM v WHERE CAST(json_extract(j, '$.k') AS BIGINT) % 2 = 0""")
def json_paths(spark, sf_dir):
    """Even values at a path of the events' JSON; a tenth of the texts is malformed, another has a list."""
    k = F.col("event_id") % 10
    tagged = F.concat(F.lit(', "tags": ["a", "b'), (F.col("event_id") % 7).cast("string"), F.lit('"]}'))
    text = F.when(k == 0, F.substr("props", F.lit(2))).when(k == 1, F.replace(F.col("props"), F.lit("}"), tagged)).otherwise(F.col("props"))
    rows = variants.parsed(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "j", "v")
    return rows.select("event_id", variants.at("v", "$.k", "bigint").alias("k"), variants.at("v", "$.tags[1]", "string").alias("tag")).where("k % 2 = 0")


@query()
def near_part_names(spark, sf_dir):
    """Names of parts that resemble each other, by the exact cosine join."""
    return resolve.near_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("surface")))
