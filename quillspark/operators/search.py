"""Scoped top-k search: scope, score, blend, bias, cut, shape.

Every step is a DataFrame. Lower scores are better. Ties go by chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_close, squared_l2
from .filters import apply_filters, source_scope

#: Lookup tables up to this many bytes of plan size are broadcast by Spark's own rule; no hint overrides it.


def scope_ids(collection_docs: DataFrame | None = None, collections: list[str] | None = None, docs: DataFrame | None = None, source: str | None = None, doc_ids: list[str] | None = None) -> DataFrame | None:
    """Ids that all given conditions allow: any of the collections, and the source, and the explicit ids.

    None means no restriction; unknown or empty collections allow nothing.
    """
    found = None

    def narrow(ids: DataFrame) -> DataFrame:
        return ids if found is None else found.join(ids, "doc_id", "left_semi")

    if doc_ids is not None:
        spark = (docs if docs is not None else collection_docs).sparkSession
        found = spark.createDataFrame([(x,) for x in dict.fromkeys(doc_ids)], "doc_id string")
    if collections is not None:
        found = narrow(collection_docs.where(F.col("name").isin(collections)).select("doc_id").distinct())
    if source:
        found = narrow(docs.where(source_scope("source", source)).select("doc_id").distinct())
    return found


def in_scope(chunks: DataFrame, ids: DataFrame | None) -> DataFrame:
    return chunks if ids is None else chunks.join(ids, "doc_id", "left_semi")


def candidate_limit(top_k: int, rerank: bool = False, top_n: int = 10, multiplier: float = 1.0, heat_weight: float = 0.0) -> int:
    """How many hits to fetch before reranking or biasing moves them."""
    if rerank:
        return max(top_k, top_n, top_k + 5, int(top_k * max(1, multiplier)))
    return top_k + 5 if heat_weight > 0 else top_k


def vector_top_k(chunks: DataFrame, query: list[float], k: int, filters=None, vector: str = "vector", tie: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to the query; filters run before scoring, and the cut is a distributed top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = apply_filters(chunks, filters).withColumn("_distance", squared_l2(vector, q))
    return scored.orderBy("_distance", tie).limit(k)


def top_k_per_query(chunks: DataFrame, queries: DataFrame, k: int, vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", tie: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of many queries at once; ranks are limited inside each task before the shuffle."""
    scored = chunks.crossJoin(queries).withColumn("_distance", squared_l2(vector, query_vector))
    order = Window.partitionBy(query_id).orderBy("_distance", tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unified_score(df: DataFrame) -> Column:
    """A final score, else one minus relevance, else a distance, else 0, whichever the rows have."""
    have = []
    if "_final_score" in df.columns:
        have.append(F.col("_final_score"))
    if "_relevance_score" in df.columns:
        have.append(1 - F.col("_relevance_score"))
    if "_distance" in df.columns:
        have.append(F.col("_distance"))
    return F.coalesce(*have, F.lit(0.0))


def minmax(value: Column, partition: list[str], invert: bool = False) -> Column:
    """Value scaled to 0..1 over its partition; all (nearly) equal gives 0, and 1 where inverted."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(is_close(lo, hi), F.lit(0.0)).otherwise((value - lo) / (hi - lo))
    return 1 - scaled if invert else scaled


def blend(df: DataFrame, base: Column, rerank: Column, weight: float, partition: list[str] | None = None) -> DataFrame:
    """``_final_score``: (1 - w) of the scaled base score and w of the inverted scaled rerank score."""
    w = min(1.0, max(0.0, weight))
    p = partition or []
    return df.withColumn("_final_score", (1 - F.lit(w)) * minmax(base, p) + F.lit(w) * minmax(rerank, p, invert=True))


def heat_bias(df: DataFrame, heat: DataFrame, score: Column, weight: float) -> DataFrame:
    """Lowers scores of hot sections by ``w * h / (1 + h)``; heat has ``doc_id, section, heat``."""
    if weight <= 0:
        return df.withColumn("_final_score", score)
    h = F.coalesce(F.col("__heat"), F.lit(0.0))
    hot = heat.select("doc_id", "section", F.col("heat").alias("__heat"))
    return df.join(hot, ["doc_id", "section"], "left").withColumn("_final_score", score - F.lit(weight) * h / (1 + h)).drop("__heat")


def with_stub(df: DataFrame, stubs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds document columns to hits; a missing document gives empty strings."""
    looked = stubs.select("doc_id", *[F.col(c).alias("__" + c) for c in columns])
    out = df.join(looked, "doc_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col("__" + c), F.lit(""))).drop("__" + c)
    return out


def group_by_document(hits: DataFrame, chunk_columns: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """One row per document: best score, its chunks in rank order, its distinct sections; best documents first."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(score, tie))
    ranked = hits.withColumn("__rank", rank)
    grouped = ranked.groupBy("doc_id").agg(
        F.min(score).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("__rank", *chunk_columns))), lambda x: F.struct(*[x[c].alias(c) for c in chunk_columns])).alias("chunks"),
        F.array_sort(F.collect_set(F.when(F.col("section") != "", F.col("section")))).alias("sections"),
    )
    return grouped.orderBy("score", "doc_id")


def toc_by_document(hits: DataFrame, score: str = "score") -> DataFrame:
    """One row per document: best score, and its sections as one string, null without any."""
    found = F.array_sort(F.collect_set(F.when(F.col("section") != "", F.col("section"))))
    return hits.groupBy("doc_id").agg(F.min(score).alias("score"), F.when(F.size(found) > 0, F.array_join(found, ", ")).alias("section")).orderBy("score", "doc_id")
