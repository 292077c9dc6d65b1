"""Column profiles of a table, each in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "Bool"
    if isinstance(t, T.IntegralType):
        return "Int"
    if isinstance(t, T.NumericType):
        return "Float"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return "Date" if isinstance(t, T.DateType) else "String"


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``(column, n_distinct)`` without nulls; ``approximate`` uses sketches, which merge without a shuffle per column."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    wide = df.agg(*[count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_distinct")


def nulls(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_rate)``."""
    wide = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = wide.unpivot(["__n"], df.columns, "column", "null_count")
    return long.select("column", "null_count", F.round(F.col("null_count") / F.col("__n"), 6).alias("null_rate"))


def outliers(df: DataFrame, limit: float = 3.0) -> DataFrame:
    """``(column, n_outliers)``: values more than ``limit`` sample deviations from the mean."""
    cols = _numeric(df)
    stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols])
    far = [F.count_if((F.col(f"{c}__s") > 0) & (F.abs((F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")) > limit)).alias(c) for c in cols]
    return df.select(*cols).crossJoin(F.broadcast(stats)).agg(*far).unpivot([], cols, "column", "n_outliers")


def string_lengths(df: DataFrame) -> DataFrame:
    """``(column, min_len, max_len, mean_len)`` of text columns."""
    cols = _text(df)
    aggs = [f(F.length(c)).alias(f"{c}__{n}") for c in cols for n, f in (("a", F.min), ("b", F.max), ("c", F.avg))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__a").cast("long").alias("min_len"), F.col(f"{c}__b").cast("long").alias("max_len"), F.round(f"{c}__c", 1).alias("mean_len")) for c in cols])
    return df.agg(*aggs).select(F.inline(rows))


def describe(df: DataFrame) -> DataFrame:
    """``(column, n, mean, std, min, q1, median, q3, max)`` of numeric columns; quartiles interpolate."""
    cols = _numeric(df)
    q = lambda c, p: F.percentile(c, F.lit(p))
    parts = (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("q1", lambda c: q(c, 0.25)), ("median", lambda c: q(c, 0.5)), ("q3", lambda c: q(c, 0.75)), ("max", F.max))
    aggs = [f(c).alias(f"{c}__{n}") for c in cols for n, f in parts]
    value = lambda c, n: F.col(f"{c}__{n}").cast("long" if n == "n" else "double")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[(value(c, n) if n == "n" else F.round(value(c, n), 4)).alias(n) for n, _ in parts]) for c in cols])
    return df.agg(*aggs).select(F.inline(rows))


def top_value(df: DataFrame, column: str) -> DataFrame:
    """``(value, freq)`` of the most frequent value, the least of equally frequent ones."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "value").limit(1)


def looks_like_dates(df: DataFrame, column: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")) -> bool:
    """Whether the first five values all parse as a date or time."""
    some = df.where(F.col(column).isNotNull()).select(column).limit(5)
    ok = F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats]).isNotNull()
    n, good = some.agg(F.count("*"), F.count_if(ok)).first()
    return n > 0 and n == good
