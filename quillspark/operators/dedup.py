"""Deduplication by content hash and by path, before any other work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash


def split_new(incoming: DataFrame, known: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """``(new, seen)``: rows whose hash is unknown, the first of equal ones only; and rows with the known ``doc_id``."""
    hashed = incoming.withColumn("hash", content_hash(content))
    ids = known.select("hash", F.col("doc_id").alias("known_id"))
    new = hashed.join(ids, "hash", "left_anti")
    return new, hashed.join(ids, "hash")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a hash aggregate would not keep the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def replace_by_path(table: DataFrame, incoming: DataFrame, path: str = "path") -> DataFrame:
    """Rows of incoming paths replace the table's."""
    return table.join(incoming.select(path).distinct(), path, "left_anti").unionByName(incoming)


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def synthetic_path(filename: str) -> str:
    """Path of content that was given without a file."""
    return f"__content__:{filename}"
