"""Chunk summaries: four branches need no model, the fifth takes a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

FALLBACK_CHARS, SHORT_TOKENS, BATCH = 200, 100, 10


def without_model(content: Column, whole: Column, enabled: bool) -> Column:
    """The summary where no model is needed, else null."""
    if not enabled:
        return F.left(content, F.lit(FALLBACK_CHARS))
    return F.when(whole | (estimate_tokens(content) < SHORT_TOKENS), content)


def summarise(chunks: DataFrame, model: Callable[[Sequence[str]], Sequence[str]] | None = None, content: str = "content", whole: str | None = None) -> DataFrame:
    """Adds ``summary``. A model gets batches of ten texts; where it fails, the text's first 200 characters serve."""
    is_whole = F.col(whole) if whole else F.lit(False)
    plain = without_model(F.col(content), is_whole, model is not None)
    if model is None:
        return chunks.withColumn("summary", plain)

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for i in range(0, len(texts), BATCH):
            part = [t or "" for t in texts.iloc[i : i + BATCH]]
            try:
                got = list(model(part))
                out += got if len(got) == len(part) else [t[:FALLBACK_CHARS] for t in part]
            except Exception:  # noqa: BLE001  a provider's failure must not lose the chunk
                out += [t[:FALLBACK_CHARS] for t in part]
        return pd.Series(out)

    ready = chunks.withColumn("__plain", plain)
    done = ready.where("__plain is not null").withColumn("summary", F.col("__plain"))
    asked = ready.where("__plain is null").withColumn("summary", ask(content))
    return done.unionByName(asked).drop("__plain")


def merge_summaries(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """New summaries ``(doc_id, chunk_index, summary)`` over the chunks' old ones."""
    new = fresh.select("doc_id", "chunk_index", F.col("summary").alias("__new"))
    return chunks.join(new, ["doc_id", "chunk_index"], "left").withColumn("summary", F.coalesce("__new", "summary")).drop("__new")
