"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_knn, chunk_dedup, context_mixing, langid, license_scan, mixing, ngram_jaccard, packing, pfp_dedup, quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession) -> str:
    """Path of the token vocabulary, a setting of the session."""
    return spark.conf.get("quillspark.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")


#: A source's domain, by its number; others are of domain "other".
DOMAINS = ("web", "books", "news", "forum")
_LANGUAGES = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13, "*": 0.02}
MIX_WEIGHTS = {"web": (0.4, _LANGUAGES), "books": (0.2, _LANGUAGES), "news": (0.2, _LANGUAGES), "forum": (0.18, _LANGUAGES), "other": (0.02, None)}


def mix_levels() -> list[Column]:
    number = F.try_element_at(F.split("source", "src"), F.lit(2)).try_cast("int")
    domain = F.coalesce(F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod(number, F.lit(len(DOMAINS))) + 1), F.lit("other"))
    return [domain, F.col("lang"), F.col("source")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the class of its near copies and its number of links."""
    return ngram_jaccard.near_classes(_table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.bits_per_byte(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.report(_table(spark, sf_dir, "documents"))


def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), buckets=16, token_budget=65_536, vocabulary=vocabulary(spark))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, fraction=0.8, max_epochs=2, vocabulary=vocabulary(spark))
    return chosen.select("doc_id", *[F.col("leaf")[n].alias(c) for n, c in enumerate(("domain", "lang", "source"))], "epoch")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op9_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 asks all rows."""
    return block_knn.neighbours(_table(spark, sf_dir, "embeddings"), k=10, queries=F.col("vec_id") % 50 == 0)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_length_packing": op4_length_packing,
    "op5_license_scan": op5_license_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_block_neighbours": op9_block_neighbours,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^ \t\n\r\f\v]+') AS ws
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
g AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS gram FROM w),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE o / (x.n + y.n - o)::DOUBLE >= 0.5),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links FROM w JOIN c ON c.a = w.r LEFT JOIN l ON l.a = w.r""",
    "op8_quality_rules": quality_rules.oracle(),
    "op9_block_neighbours": """
WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour_id,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS rank FROM d)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(dist, 6) AS distance FROM r WHERE rank <= 10""",
}
