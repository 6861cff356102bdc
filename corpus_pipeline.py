"""A corpus pipeline of five training-data operators, each stage on all that the last one kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing of
sources -> token files. The first four return the columns of ``documents``; the last
returns what is read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from claimloom.llm import decontaminate, mixing, quality, setjoin, wavelet
from claimloom.llm.common import batches_of_texts, free_name, shared_folder, table, written

#: Words in a shingle of the near-duplicate stage, and the similarity of a link in percent.
WIDTH, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    An empty table of labels rejects none; a null text is judged as an empty one; repeated
    rows are judged alike; a row without doc_id is judged too, but trains nothing; an empty
    table stays empty; a column named score is no score.
    """
    allowed = quality.fold(F.col("doc_id"), 5) != 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), allowed)
    return quality.accepted(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of 0.8 or more on five-word shingles connect.

    A text without words links with nothing and stays; of rows with one doc_id the first by text
    stays, so repeated rows leave one; rows without doc_id have no group and all stay.
    """
    batches_of_texts(spark)
    heads = setjoin.join(docs, WIDTH, PERCENT).where("doc_id = component_id").select("doc_id")
    turn = free_name(docs, "turn")
    kept = docs.join(heads, "doc_id", "left_semi").withColumn(turn, F.row_number().over(W.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])))
    return kept.where(F.col(turn) == 1).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows and rows without doc_id are judged each by
    its text; an empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: a part of a document counts by rounding.

    The mix takes no words from a document without any, so those are left out. Rows with the
    same doc_id, and those without one, are taken as often as the one of them that is taken most.
    """
    batches_of_texts(spark)
    mixed = mixing.mix(docs).where("size > 0")
    key, often, nth = (free_name(docs, c) for c in ("mixed_id", "times", "time"))
    times = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(often)).where(F.col(often) > 0)
    chosen = docs.join(times, docs["doc_id"].eqNullSafe(times[key]))
    return chosen.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and holds the end id alone; rows without doc_id come first, rows with
    the same one in the order of their texts; an empty table gives no files and no rows.
    """
    batches_of_texts(spark)
    return wavelet.encode_and_read(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: The classifier and the decontamination have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, f"stage-{k}")
    return docs
