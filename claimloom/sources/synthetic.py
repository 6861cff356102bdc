"""A synthetic corpus with gold labels whose offsets are right by construction.

Everything follows from a document's number by integer arithmetic, so any number of
executors, and SQL, make the same texts. Names and sentences are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bands of difficulty and how often, in percent, a name is given by its alias in each.
BANDS, ALIASED = ("A", "B", "C", "D"), (0, 35, 50, 60)
FIRMS = ("Alder Freight", "Birch Metals", "Cedar Foods", "Dune Textiles", "Elm Optics", "Fern Shipping", "Grove Timber")
ALIASES = ("Alder", "Birch", "Cedar", "Dune", "Elm", "Fern", "Grove")
VERBS = ("is owned by", "sent money to", "shares an office with", "signed for", "billed")
LINES = 4


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def corpus(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id) with band, text and mentions (entity, surface, char_start, char_end), four sentences each."""
    doc = F.col("doc_id")
    band = (doc % 4).cast("int")
    rate = F.get(F.array(*[F.lit(x) for x in ALIASED]), band)

    def name(n: Column) -> Column:
        return F.when(n * 61 % 100 < rate, _pick(ALIASES, n)).otherwise(_pick(FIRMS, n))

    def line(k: Column) -> Column:
        a, b = doc * 5 + k * 3, doc * 5 + k * 3 + 1 + doc % 3
        return F.struct(_pick(FIRMS, a).alias("subject"), name(a).alias("s"), _pick(VERBS, doc + k).alias("verb"), _pick(FIRMS, b).alias("object"), name(b).alias("o"))

    lines = F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), line)
    told = lambda x: F.concat(x["s"], F.lit(" "), x["verb"], F.lit(" "), x["o"], F.lit(". "))
    mention = lambda entity, surface, start: F.struct(entity.alias("entity"), surface.alias("surface"), start.cast("int").alias("char_start"), (start + F.length(surface)).cast("int").alias("char_end"))
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<entity:string,surface:string,char_start:int,char_end:int>>").alias("mentions"))

    def joined(so_far: Column, x: Column) -> Column:
        at = F.length(so_far["text"])
        second = at + F.length(x["s"]) + F.length(x["verb"]) + 2
        two = F.array(mention(x["subject"], x["s"], at), mention(x["object"], x["o"], second))
        return F.struct(F.concat(so_far["text"], told(x)).alias("text"), F.concat(so_far["mentions"], two).alias("mentions"))

    made = ids.select("doc_id", F.get(F.array(*[F.lit(b) for b in BANDS]), band).alias("band"), F.aggregate(lines, empty, joined).alias("d"))
    return made.select("doc_id", "band", "d.text", "d.mentions")


def violations(docs: DataFrame) -> DataFrame:
    """Documents of which a mention's offsets do not hold its surface; none, if all is well."""
    wrong = F.exists("mentions", lambda m: F.substring(F.col("text"), m["char_start"] + 1, m["char_end"] - m["char_start"]) != m["surface"])
    return docs.where(wrong)


def assigned(plans: DataFrame, buckets: int) -> DataFrame:
    """Plans dealt to the least loaded bucket in order, which for plans of one size is in turn."""
    from claimloom.operators.evals import running

    placed = running(plans.withColumn("_one", F.lit(1)), ["plan"], "_one")
    return placed.select("plan", (F.col("before") % buckets).cast("int").alias("bucket"))


def labelled_split(docs: DataFrame, band: str = "band") -> DataFrame:
    """Documents with their split: the hardest band is kept from training."""
    turn = F.row_number().over(W.partitionBy(band).orderBy("doc_id"))
    return docs.withColumn("split", F.when((F.col(band) == BANDS[-1]) | (turn % 5 == 0), "eval").otherwise("train"))


def _sql_list(values: tuple) -> str:
    return "[" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_NAME = "CASE WHEN {0}*61 % 100 < {1}[doc % 4 + 1] THEN {2}[{0} % 7 + 1] ELSE {3}[{0} % 7 + 1] END"
_A, _B = "(doc*5 + k*3)", "(doc*5 + k*3 + 1 + doc % 3)"
SQL = f"""WITH l AS (SELECT s_suppkey AS doc, k, {_NAME.format(_A, _sql_list(ALIASED), _sql_list(ALIASES), _sql_list(FIRMS)).replace("doc", "s_suppkey")} AS s, {_sql_list(VERBS)}[(s_suppkey + k) % 5 + 1] AS verb,
  {_NAME.format(_B, _sql_list(ALIASED), _sql_list(ALIASES), _sql_list(FIRMS)).replace("doc", "s_suppkey")} AS o FROM supplier, range(4) r(k)),
t AS (SELECT *, s || ' ' || verb || ' ' || o || '. ' AS line FROM l), p AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t)
SELECT doc AS doc_id, {_sql_list(BANDS)}[doc % 4 + 1] AS band, string_agg(line, '' ORDER BY k) AS text, CAST(8 AS INTEGER) AS n_mentions, CAST(sum(pos + pos + length(s) + length(verb) + 2) AS INTEGER) AS starts FROM p GROUP BY doc"""
