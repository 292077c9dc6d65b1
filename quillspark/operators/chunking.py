"""Cutting texts into pieces: windows, record groups, greedy packing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import chunk_id
from ..functions.text import EMBED_CHARS, EMBED_TOKENS, col, embed_tokens

OVERLAP = 500


def fixed_windows(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row per window ``(piece_index, piece)`` of each text, the last ones being shorter."""
    step = size - overlap
    last = F.floor((F.length(text) - 1) / step).cast("int")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("piece_index", F.explode(starts))
    return out.withColumn("piece", F.substring(F.col(text), F.col("piece_index") * step + 1, F.lit(size)))


def embed_pieces(df: DataFrame, text: str = "content", section: str = "section") -> DataFrame:
    """A row per text that goes to the embedding model.

    Chunks whose section and text pass the token limit become windows of 18,000
    characters that overlap by 500; ``embed_text`` names section and part. A
    chunk that only its section's name puts over the limit is one marked part.
    """
    prefix = F.when(F.coalesce(F.col(section), F.lit("")) != "", F.concat(F.lit("["), F.col(section), F.lit("] "))).otherwise(F.lit(""))
    n = F.length(text)
    long = embed_tokens(F.concat(prefix, F.col(text))) > EMBED_TOKENS
    step = EMBED_CHARS - OVERLAP
    total = F.when(long, F.greatest(F.lit(1), F.ceil((n - OVERLAP) / F.lit(float(step))).cast("int"))).otherwise(F.lit(1))
    out = df.withColumn("total_pieces", total).withColumn("is_split", long).withColumn("piece_index", F.explode(F.sequence(F.lit(0), F.col("total_pieces") - 1)))
    piece = F.when(F.col("is_split"), F.substring(F.col(text), F.col("piece_index") * step + 1, F.lit(EMBED_CHARS))).otherwise(F.col(text))
    part = F.concat(prefix, F.lit(" [part "), (F.col("piece_index") + 1).cast("string"), F.lit("/"), F.col("total_pieces").cast("string"), F.lit("]\n"), piece)
    return out.withColumn("piece", piece).withColumn("embed_text", F.when(F.col("is_split"), part).otherwise(F.concat(prefix, piece)))


def piece_id(doc: Column | str, index: Column | str) -> Column:
    """Chunk ids of ``embed_pieces``: the piece is named where there are several."""
    return chunk_id(doc, index, F.when(F.col("total_pieces") > 1, F.col("piece_index")))


def group_records(df: DataFrame, size: int, partition: list[str], order: str, text: str) -> DataFrame:
    """Every ``size`` records of a partition joined into one chunk; groups with no text are left out and the chunk
    numbers stay dense."""
    w = Window.partitionBy(*partition).orderBy(order)
    numbered = df.withColumn("__rn", F.row_number().over(w) - 1).withColumn("__g", F.floor(F.col("__rn") / size))
    parts = F.array_sort(F.collect_list(F.when(F.trim(F.col(text)) != "", F.struct("__rn", text))))
    joined = numbered.groupBy(*partition, "__g").agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("content"), F.min("__rn").alias("record_start"), F.max("__rn").alias("record_end"))
    dense = F.row_number().over(Window.partitionBy(*partition).orderBy("__g")) - 1
    return joined.where("content <> ''").withColumn("chunk_index", dense).drop("__g")


def representatives(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """First, middle and last row of each partition, as far as they differ."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    out = df.withColumn("__n", n).withColumn("position", at)
    keep = (F.col("position") == 0) | ((F.col("__n") > 2) & (F.col("position") == F.floor(F.col("__n") / 2))) | ((F.col("__n") > 1) & (F.col("position") == F.col("__n") - 1))
    return out.where(keep).drop("__n")


def head_and_tail(df: DataFrame, partition: list[str], order: str, n: int) -> DataFrame:
    """The first and last n rows of each partition, marked ``head`` or ``tail``."""
    w = Window.partitionBy(*partition)
    first = df.withColumn("position", F.row_number().over(w.orderBy(F.asc(order)))).where(F.col("position") <= n).withColumn("part", F.lit("head"))
    last = df.withColumn("position", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("position") <= n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def _size(text: str) -> int:
    return max(1, len(text) // 3)


def merge_small(chunks: list[tuple[str, str, int]], least: int = 300, most: int = 1200, hard_levels: frozenset[int] = frozenset({1, 2})) -> list[tuple[str, str]]:
    """Greedy packing of neighbouring ``(section, text, level)`` chunks: those under ``least`` tokens join the one
    before while both stay within ``most``; headings of a hard level begin anew."""
    out: list[list] = []
    for section, text, level in chunks:
        if out and level not in hard_levels and (_size(out[-1][1]) < least or _size(text) < least) and _size(out[-1][1] + "\n\n" + text) <= most:
            out[-1][1] += "\n\n" + text
        else:
            out.append([section, text])
    return [(s, t) for s, t in out]


def split_long(text: str, target: int = 1000, overlap_words: int = 50) -> list[str]:
    """Paragraphs, then sentences, then words, packed to about ``target`` tokens with some words repeated."""
    units: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        if _size(p) <= target:
            units.append(p)
            continue
        for s in re.split(r"(?<=[.!?。!?])\s+", p):
            if _size(s) <= target:
                units.append(s)
            else:
                words, step = s.split(), max(1, target // 2)
                units += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    out, now = [], ""
    for u in units:
        if now and _size(now + "\n" + u) > target:
            out.append(now)
            tail = now.split()[-overlap_words:] if overlap_words else []
            now = " ".join([*tail, u]) if _size(" ".join([*tail, u])) <= target else u
        else:
            now = f"{now}\n{u}" if now else u
    return [*out, now] if now.strip() else out


def pack_paragraphs(df: DataFrame, id_col: str, text_col: str, target: int = 1000, overlap_words: int = 50) -> DataFrame:
    """``split_long`` over a table, in Arrow batches: an order-dependent fold that no built-in expresses."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_long(t or "", target, overlap_words))

    return df.select(F.col(id_col), F.posexplode(cut(col(text_col))).alias("piece_index", "piece"))
