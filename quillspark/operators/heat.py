"""Section heat: accesses summed, with exponential decay since the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of an access by its kind.
WEIGHTS = {"search": 1.0, "inspect": 2.0, "read": 3.0}


def totals(events: DataFrame, ts: str = "ts", weight: str = "weight") -> DataFrame:
    """``raw_score, access_count, last_access, first_access`` per document and section; blank sections don't count."""
    real = events.where(F.trim(F.coalesce("section", F.lit(""))) != "")
    return real.groupBy("doc_id", "section").agg(F.sum(weight).alias("raw_score"), F.count("*").alias("access_count"), F.max(ts).alias("last_access"), F.min(ts).alias("first_access"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Totals of two disjoint sets of events."""
    return a.unionByName(b).groupBy("doc_id", "section").agg(F.sum("raw_score").alias("raw_score"), F.sum("access_count").alias("access_count"), F.max("last_access").alias("last_access"), F.min("first_access").alias("first_access"))


def decayed(raw: Column, last: Column, now: Column, half_life: float) -> Column:
    """Score halved for every half-life since the last access; times are epoch seconds."""
    return raw * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), now - last) / F.lit(max(1.0, half_life)))


def scores(table: DataFrame, now: Column, half_life: float = 86_400.0, last: Column | None = None) -> DataFrame:
    return table.withColumn("heat", decayed(F.col("raw_score"), F.col("last_access") if last is None else last, now, half_life))


def hot(scored: DataFrame, threshold: float = 5.0, limit: int = 20) -> DataFrame:
    return scored.where(F.col("heat") >= threshold).orderBy(F.desc("heat"), "doc_id", "section").limit(limit)


def top(scored: DataFrame, doc_id: str | None = None, limit: int = 20) -> DataFrame:
    """The hottest sections of one document, or of all, with any heat."""
    found = scored.where("heat > 0")
    found = found if doc_id is None else found.where(F.col("doc_id") == doc_id)
    return found.orderBy(F.desc("heat"), "doc_id", "section").limit(limit)


def evict(scored: DataFrame, most: int = 1000) -> DataFrame:
    """The ``most`` hottest entries."""
    return scored.orderBy(F.desc("heat"), "doc_id", "section").limit(max(1, most))


def report(scored: DataFrame, doc_id: str | None = None, threshold: float = 5.0, limit: int = 20) -> DataFrame:
    """A document's sections by heat, or all hot sections where none is given; rounded."""
    found = hot(scored, threshold, limit) if doc_id is None else top(scored, doc_id, limit)
    return found.withColumn("heat", F.round("heat", 4))
