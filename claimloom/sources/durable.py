"""Tables written to the folder that all executors share, so that long plans are cut and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests, a notebook) makes one; on a
    cluster executors do not share a driver's folders, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: A setting of Spark: shuffle files are removed when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to ``folder`` and read it again: cuts the lineage, survives lost executors.

    What the table was made from is not needed again, so its shuffle files go at once.
    """
    spark, path = df.sparkSession, f"{folder}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a written table of its own."""
    return written(df, shared_folder(df.sparkSession), "table")


def removed(spark: SparkSession, *patterns: str) -> None:
    """Delete written tables that nothing reads any more, by path or pattern, wherever they are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for pattern in patterns:
        path = hadoop.Path(pattern)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(path) or []:
            files.delete(found.getPath(), True)
