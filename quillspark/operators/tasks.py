"""Background work as tables: queue order, states, recovery, failure ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRIES = 3
ACTIVE = ("pending", "processing")


def next_tasks(tasks: DataFrame, n: int = 1) -> DataFrame:
    """Pending tasks by falling priority, first come first."""
    return tasks.where(F.col("status") == "pending").orderBy(F.desc("priority"), "submitted_at", "doc_id").limit(n)


def submit(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks, but for documents that already wait or run; a finished task is replaced."""
    active = tasks.where(F.col("status").isin(*ACTIVE)).select("doc_id")
    fresh = new.join(active, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return tasks.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def bump(tasks: DataFrame, doc_ids: DataFrame, by: int = 10) -> DataFrame:
    """Raises the priority of pending tasks that a search touched."""
    touched = doc_ids.select("doc_id").distinct().withColumn("__hit", F.lit(True))
    raised = F.when(F.col("__hit") & (F.col("status") == "pending"), F.col("priority") + by).otherwise(F.col("priority"))
    return tasks.join(touched, "doc_id", "left").withColumn("priority", raised).drop("__hit")


def clean(tasks: DataFrame, now: Column, keep_seconds: float = 86_400.0) -> DataFrame:
    """Without tasks that ended more than a day ago."""
    return tasks.where(F.col("status").isin(*ACTIVE) | (now - F.col("submitted_at") <= keep_seconds))


def orphans(stubs: DataFrame, chunks: DataFrame, ledger: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Documents without chunks that have retries left, to be queued at priority -1."""
    spent = ledger.where(F.col("retry_count") >= max_retries).select("doc_id")
    left = stubs.join(chunks.select("doc_id"), "doc_id", "left_anti").join(spent, "doc_id", "left_anti")
    return left.withColumn("priority", F.lit(-1))


def failure_ledger(failures: DataFrame) -> DataFrame:
    """One row per document from ``(doc_id, ts, error)`` rows: count, last error, first and last time."""
    return failures.groupBy("doc_id").agg(F.count("*").alias("retry_count"), F.max_by("error", "ts").alias("last_error"), F.max("ts").alias("last_retry_at"), F.min("ts").alias("first_failed_at"))


def status(doc_ids: DataFrame, tasks: DataFrame, stubs: DataFrame, chunks: DataFrame) -> DataFrame:
    """State of each id: its task's, else completed for a known document, else not_found; and whether it has chunks."""
    t = tasks.select("doc_id", F.col("status").alias("__t"))
    s = stubs.select("doc_id").distinct().withColumn("__s", F.lit(True))
    c = chunks.select("doc_id").distinct().withColumn("has_chunks", F.lit(True))
    joined = doc_ids.join(t, "doc_id", "left").join(s, "doc_id", "left").join(c, "doc_id", "left")
    state = F.coalesce("__t", F.when(F.col("__s"), F.lit("completed")), F.lit("not_found"))
    return joined.select("doc_id", state.alias("status"), F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


def throttle(changes: DataFrame, path: str, ts: str, seconds: float = 5.0) -> DataFrame:
    """Changes at least ``seconds`` after the one before on the same path."""
    w = Window.partitionBy(path).orderBy(ts)
    gap = F.col(ts) - F.lag(ts).over(w)
    return changes.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= seconds)).drop("__gap")
