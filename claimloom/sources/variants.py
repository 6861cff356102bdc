"""JSON columns, parsed once where they are read and asked by path from then on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with ``into``, the variant of a JSON text; malformed and null texts are null."""
    return rows.withColumn(into, F.try_parse_json(F.col(column)))


def at(variant: str, path: str, kind: str) -> Column:
    """The value at a path as a type; null where there is none or it is of another type."""
    return F.try_variant_get(F.col(variant), path, kind)


def holding(rows: DataFrame, variant: str, path: str, value) -> DataFrame:
    """Rows whose value at a path equals ``value``; a list there holds it as an element."""
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]
    lone, some = at(variant, path, kind), at(variant, path, f"array<{kind}>")
    return rows.where(F.coalesce(lone == F.lit(value), F.lit(False)) | F.coalesce(F.array_contains(some, F.lit(value)), F.lit(False)))


def elements(rows: DataFrame, variant: str, path: str, key: str) -> DataFrame:
    """A row for each element of the list at a path: the key, its place and its variant."""
    inner = rows.select(key, F.try_variant_get(F.col(variant), path, "variant").alias("_list")).where("_list IS NOT NULL")
    return rows.sparkSession.sql(f"SELECT r.`{key}`, e.pos, e.value FROM {{inner}} r, LATERAL variant_explode(r._list) e WHERE e.key IS NULL", inner=inner)
