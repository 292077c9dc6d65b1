"""Full-text search: a postings table, BM25, and rank fusion with vector hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

K1, B, RRF_K = 1.2, 0.75, 60


def terms(text: Column | str) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``(id, term, tf, len)``: write it partitioned by term for repeated searches."""
    words = chunks.select(F.col(id_col).alias("id"), terms(text_col).alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


#: The term of a chunk's own row, whose length counts even where it has no terms.
WHOLE = ""


def stored(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """Rows of the table ``postings``: every term of a chunk, and one row of the chunk itself.

    They are sorted by term, so that a search reads the row groups of its terms alone.
    """
    words = chunks.select("doc_id", F.col(id_col).alias("id"), terms(text_col).alias("w")).withColumn("len", F.size("w"))
    tf = words.select("doc_id", "id", "len", F.explode("w").alias("term")).groupBy("doc_id", "id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    whole = words.select("doc_id", "id", F.lit(WHOLE).alias("term"), F.lit(0).cast("long").alias("tf"), "len")
    return tf.select("doc_id", "id", "term", "tf", "len").union(whole).repartitionByRange("term", "id").sortWithinPartitions("term")


def bm25(index: DataFrame, query_terms: list[str], n_docs: int, avg_len: float) -> DataFrame:
    """``(id, score)`` of the documents that have a query term. The term filter comes before any shuffle."""
    hits = index.where(F.col("term").isin(list(dict.fromkeys(query_terms))))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (1 - B + F.lit(B) * F.col("len") / F.lit(avg_len)))
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(idf * tf).alias("score"))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings ``(id, rank)``; a hit of one ranking alone keeps that part."""
    a, b = vector_hits.select(id_col, F.col("rank").alias("__a")), text_hits.select(id_col, F.col("rank").alias("__b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return a.join(b, id_col, "full").select(id_col, (part("__a") + part("__b")).alias("_relevance_score"))


def ranked(df: DataFrame, score: str, k: int, descending: bool = True, id_col: str = "id") -> DataFrame:
    """The best k rows with a rank from 1; only k rows ever reach the single ranking task."""
    order = [F.desc(score) if descending else F.asc(score), F.asc(id_col)]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
