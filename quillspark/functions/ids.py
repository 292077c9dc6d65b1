"""Content hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def content_hash(content: Column | str) -> Column:
    """SHA-256 of bytes, or of a string's UTF-8."""
    return F.sha2(col(content).cast("binary"), 256)


def doc_id(*parts: Column | str) -> Column:
    """Deterministic 32-digit id of its parts, so that a retried batch writes the same rows."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[col(p).cast("string") for p in parts]), 256), F.lit(32))


def chunk_id(doc: Column | str, index: Column | str, piece: Column | str | None = None) -> Column:
    """``doc_index``, with ``_ppiece`` for a piece of a split chunk."""
    base = F.concat_ws("_", col(doc).cast("string"), col(index).cast("string"))
    return base if piece is None else F.when(col(piece).isNull(), base).otherwise(F.concat(base, F.lit("_p"), col(piece).cast("string")))
