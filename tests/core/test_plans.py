"""What Catalyst makes of the operators: pushdown, pruning, distributed top-k, no needless shuffles."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import dedup, filters, search


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("plans") / "chunks")
    rows = [(f"d{i % 7}_{i}", f"d{i % 7}", "src" + str(i % 3), i, [float(i), 1.0], "text " * i) for i in range(60)]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, source string, n int, vector array<float>, content string").write.parquet(p)
    return spark.read.parquet(p)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(chunks):
    p = plan(filters.apply_filters(chunks, {"n": {"op": "between", "value": [3, 9]}}).where(filters.source_scope("source", "src*")).select("doc_id"))
    assert "StringStartsWith" in p and "GreaterThanOrEqual(n,3)" in p and "LessThanOrEqual(n,9)" in p
    assert "content" not in p.split("ReadSchema")[1] and "Exchange" not in p


def test_vector_top_k_is_a_distributed_top_k(chunks):
    p = plan(search.vector_top_k(chunks, [1.0, 2.0], 5, {"source": "src1"}))
    assert "TakeOrderedAndProject" in p and "EqualTo(source,src1)" in p and "Window" not in p and "Python" not in p


def test_many_queries_limit_before_the_shuffle(chunks):
    q = chunks.select(F.col("n").alias("query_id"), F.col("vector").alias("query_vector"))
    p = plan(search.top_k_per_query(chunks, q, 3))
    assert p.count("WindowGroupLimit") == 2  # one inside each task, one after the shuffle


def test_unknown_collection_scans_nothing(spark, chunks):
    empty = spark.createDataFrame([], "doc_id string")
    assert search.in_scope(chunks, empty).count() == 0


def test_text_functions_stay_in_the_jvm(chunks):
    p = plan(chunks.select(text.preview("content"), text.estimate_tokens("content"), text.format_size("n"), text.first_paragraph("content")))
    assert "Python" not in p and "Exchange" not in p and "*(1)" in p


def test_path_replacement_is_one_anti_join(chunks):
    p = plan(dedup.replace_by_path(chunks.select("doc_id", F.col("chunk_id").alias("path")), chunks.limit(3).select("doc_id", F.col("chunk_id").alias("path"))))
    assert "LeftAnti" in p and "Python" not in p
