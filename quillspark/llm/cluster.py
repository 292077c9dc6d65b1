"""Session helpers that must hold on a cluster: where to cut lineage, and how many buckets to use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's own checkpoint folder; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if told:
        sc.setCheckpointDir(told)
        return told
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    sc.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no more than a reread."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame, text_col: str, bucket_bytes: int = 8 << 20) -> int:
    """How many buckets spread what a text column gives: by its bytes, so that no task's share grows with the table."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(2 * partitions(docs.sparkSession), -(-size // bucket_bytes))


def row_key(*cols: str):
    """64-bit key of a row from its named columns; a null has a key of its own."""
    return F.xxhash64(*[c for n in cols for c in (F.col(n), F.col(n).isNull())])


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge list; root is the least node of the component.

    Alternates large-star and small-star steps, each one shuffle, until the
    edge set no longer changes. The lineage is cut after every round. The
    number of rounds grows with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        # large star: every neighbour larger than u is linked to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root")).distinct()
