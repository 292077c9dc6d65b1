"""A corpus pipeline of the operators in quillspark.llm.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents``. In a
cluster each stage's result is written as Parquet and read again as the next
one's input; ``run`` does the same in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunk_dedup, langid, mixing, ngram_jaccard, packing
from quillspark.llm.cluster import ensure_checkpoint_dir
from quillspark.llm.queries import MIX_WEIGHTS, mix_levels, vocabulary

#: No SQL: the first stage fits a classifier. The stages are tested against brute force instead.
ORACLE_SQL = None


def identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the others get the language found."""
    told = langid.identify(docs, keep_columns=True)
    name = told.columns[-1]
    kept = told.where(~F.col(name)["rejected"])
    return kept.select(*[F.col(name)["language"].alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_jaccard.drop_near_duplicates(docs, n=3, threshold=0.5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier ones are cut out."""
    return chunk_dedup.dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a document comes once for each epoch that holds it."""
    chosen = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, fraction=0.9, max_epochs=2, vocabulary=vocabulary(spark))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length."""
    return packing.pack(docs, buckets=16, token_budget=65_536, vocabulary=vocabulary(spark))


STAGES = [
    ("language_id", identified_languages),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixed_sources),
    ("length_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
