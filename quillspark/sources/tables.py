"""CSV: a profile from one file in memory, and from a table of any size through Spark."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from .base import chunk, decode, entry, probe, safe_name

FULL_CELLS = 50
_DATES = ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S")


def _kind(s: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(s):
        return "Bool"
    if pd.api.types.is_integer_dtype(s):
        return "Int"
    if pd.api.types.is_float_dtype(s):
        return "Float"
    some = s.dropna().astype(str).head(5)
    for f in _DATES:
        if len(some) and pd.to_datetime(some, format=f, errors="coerce").notna().all():
            return "DateTime" if "%H" in f else "Date"
    return "String"


def csv_file(path: str, raw: bytes) -> dict:
    df = pd.read_csv(io.StringIO(decode(raw)))
    n = len(df)
    kinds, columns = {c: _kind(df[c]) for c in df.columns}, {}
    for c in df.columns:
        s = df[c]
        info = {"type": kinds[c], "n_distinct": int(s.nunique()), "null_count": int(s.isna().sum()), "null_rate": round(float(s.isna().mean()), 6) if n else 0.0}
        if kinds[c] in ("Int", "Float"):
            sd = s.std()
            info["n_outliers"] = int((((s - s.mean()) / sd).abs() > 3).sum()) if n > 1 and sd > 0 else 0
        elif kinds[c] == "String" and s.notna().any():
            length = s.dropna().astype(str).str.len()
            info |= {"min_len": int(length.min()), "max_len": int(length.max()), "mean_len": round(float(length.mean()), 1)}
        columns[str(c)] = info
    full = n * len(df.columns) < FULL_CELLS
    at = list(range(n)) if full else sorted({0, *([n // 2] if n > 2 else []), *([n - 1] if n > 1 else [])})
    sample = df.iloc[at].to_csv(index=False) if n else ",".join(map(str, df.columns))
    stats = {"row_count": n, "column_count": len(df.columns), "columns": columns, "describe": df.describe(include="all").to_dict() if n else {}, "is_full_content": full}
    toc = [entry(str(c), 1, annotation=f"{kinds[c]}, {columns[str(c)]['n_distinct']} values") for c in df.columns]
    return probe("csv", title=safe_name(path), toc=toc, columns=list(map(str, df.columns)), stats=stats, chunks=[chunk(sample, 0, "Rows" if full else "Sample rows")], snippet=sample, intro=f"Table {safe_name(path)}, {n} rows by {len(df.columns)} columns")


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Headers and inferred types, as the profile expects; give a schema for large inputs."""
    reader = spark.read.option("header", "true")
    for k, v in options.items():
        if k != "schema":
            reader = reader.option(k, v)
    return (reader.schema(options["schema"]) if "schema" in options else reader.option("inferSchema", "true")).csv(path)


def table_profile(df: DataFrame, approximate: bool = True) -> DataFrame:
    """A row per column of a table of any size: type, distinct values, nulls."""
    kinds = df.sparkSession.createDataFrame([(f.name, profile.type_name(f.dataType)) for f in df.schema.fields], "column string, type string")
    return F.broadcast(kinds).join(profile.cardinality(df, approximate), "column").join(profile.nulls(df), "column")
