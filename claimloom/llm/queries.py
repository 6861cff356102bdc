"""The registered queries of the training-data operators, and their SQL where there is one.

Each query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, hamming_search, html_extract, language_id, license_scan, mixing, piece_bpe, quality, runs, setjoin, substring_dedup, wavelet, whitening
from claimloom.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = quality.fold(F.col("doc_id"), 4)
    network = language_id.train(docs, fold != 2)
    found = language_id.identify(docs, network)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = quality.fold(F.col("doc_id"), 5)
    model = quality.train(docs, labels, fold != 0)
    found = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = hamming_search.codes(vectors).where("vec_id % 20 = 0")
    return hamming_search.search(vectors, asked.withColumnRenamed("vec_id", "query_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(table(spark, sf_dir, "documents"), planted=True)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", runs.greatest())
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS fill FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM f),
m AS (SELECT min_by(level, (fill, place)) AS water FROM l WHERE level <= fill),
t AS (SELECT source, place, source_size, CASE WHEN water IS NULL OR fill <= water THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM l, m),
p AS (SELECT row_number() OVER () AS line, d.doc_id, d.size, t.place, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
,
q AS (SELECT place, source_size, CAST(round(target) AS BIGINT) AS words, (source_size + 1023) // 1024 AS per_pass,
             (round(target)::BIGINT // source_size) * ((source_size + 1023) // 1024) + (round(target)::BIGINT % source_size + 1023) // 1024 AS need
      FROM t WHERE round(target) > 0),
a AS (SELECT CAST(sum(words) AS BIGINT) AS total, CAST((sum(words) + 1023) // 1024 AS BIGINT) AS slots FROM q),
pt AS (SELECT slot, CAST((CAST(slot AS HUGEINT) * 618033988749894848) % 1000000000000000000 AS DOUBLE) / CAST(1e18 AS DOUBLE) AS spot FROM (SELECT unnest(range(0, slots)) AS slot FROM a)),
sh AS (SELECT place, lag(high, 1, CAST(0 AS DOUBLE)) OVER (ORDER BY place) AS low, high
       FROM (SELECT place, CAST(sum(words) OVER (ORDER BY place) AS DOUBLE) / CAST(total AS DOUBLE) AS high FROM q, a)),
dr AS (SELECT sh.place, slot, row_number() OVER (PARTITION BY sh.place ORDER BY slot) - 1 AS rank FROM pt JOIN sh ON spot >= low AND spot < high),
ha AS (SELECT q.place, q.need, coalesce(h.had, 0) AS had FROM q LEFT JOIN (SELECT place, count(*) AS had FROM dr GROUP BY 1) h USING (place)),
cl AS (SELECT place, slots + before + k AS slot, had + k AS rank
       FROM (SELECT place, had, coalesce(sum(need - had) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, unnest(range(0, CAST(need - had AS BIGINT))) AS k FROM ha WHERE had < need), a),
al AS (SELECT place, slot, rank FROM dr UNION ALL SELECT place, slot, rank FROM cl),
sl AS (SELECT place, slot, rank % per_pass AS block, least(1024, source_size - rank % per_pass * 1024, words - (rank // per_pass * source_size + rank % per_pass * 1024)) AS n
       FROM al JOIN q USING (place) WHERE rank // per_pass * source_size + rank % per_pass * 1024 < words),
bl AS (SELECT line, place, size, start, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM p WHERE size > 0),
ls AS (SELECT line, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot FROM bl JOIN sl USING (place, block)
       WHERE least(start + size, block * 1024 + n) > greatest(start, block * 1024) GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, first_slot, last_slot,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
FROM p LEFT JOIN ls USING (line)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL}
