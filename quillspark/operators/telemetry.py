"""What ingesting a document cost: rows of ``schemas.TELEMETRY`` and their summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, format_seconds

PHASES = ("probe", "summarize", "librarian", "embedding")


class Clock:
    """Seconds between laps."""

    def __init__(self) -> None:
        self.at, self.laps = time.monotonic(), {}

    def lap(self, phase: str) -> None:
        now = time.monotonic()
        self.laps[phase] = self.laps.get(phase, 0.0) + now - self.at
        self.at = now


def saved_ratio(intro, size):
    """Share of a file that a reader of its introduction doesn't read."""
    return 1 - F.octet_length(intro) / F.greatest(F.lit(1), size)


def measures(probed: DataFrame, sizes: DataFrame, laps: dict[str, float]) -> DataFrame:
    """A row per document with its tokens, chunks and saving, and the time of its batch by phase."""
    tokens = F.aggregate(F.transform("chunks", lambda c: estimate_tokens(c["content"])), F.lit(0).cast("long"), lambda a, b: a + b)
    first = probed.join(sizes, "path").select("doc_id", tokens.alias("tokens"), saved_ratio("brief_intro", F.col("size")).alias("saved_ratio"), F.size("chunks").alias("num_chunks"))
    out = first.select("doc_id", F.lit("size").alias("phase"), F.lit(0.0).alias("seconds"), "tokens", "saved_ratio", "num_chunks")
    for phase, seconds in laps.items():
        none = F.lit(None)
        out = out.unionByName(first.select("doc_id", F.lit(phase).alias("phase"), F.lit(seconds).alias("seconds"), none.cast("long").alias("tokens"), none.cast("double").alias("saved_ratio"), none.cast("int").alias("num_chunks")))
    return out


def summary(t: DataFrame) -> DataFrame:
    """One row per document: seconds by phase, tokens, saving, chunks."""
    spent = [F.sum(F.when(F.col("phase") == p, F.col("seconds"))).alias(f"{p}_seconds") for p in PHASES]
    return t.groupBy("doc_id").agg(*spent, F.sum("tokens").alias("tokens"), F.max("saved_ratio").alias("saved_ratio"), F.max("num_chunks").alias("num_chunks"))


def text(s: DataFrame) -> DataFrame:
    """The summary as a line each."""
    part = lambda c, v: F.when(F.col(c).isNotNull(), v)
    phases = [part(f"{p}_seconds", F.concat(F.lit(p + " "), format_seconds(f"{p}_seconds"))) for p in PHASES]
    rest = [part("tokens", F.concat(F.col("tokens").cast("string"), F.lit(" tokens"))), part("num_chunks", F.concat(F.col("num_chunks").cast("string"), F.lit(" chunks"))), part("saved_ratio", F.format_string("%.0f%% saved", F.col("saved_ratio") * 100))]
    return s.select("doc_id", F.concat_ws(" | ", *phases, *rest).alias("line"))
