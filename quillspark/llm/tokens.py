"""Exact token counts with a public byte-pair vocabulary, or words where none is given."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Pre-tokenisation of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """Encoder of a vocabulary file's bytes; one per Python worker."""
    import tiktoken

    key = (hash(vocabulary), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def with_counts(df: DataFrame, text_col: str, vocabulary: str | None, name: str = "n_tokens") -> DataFrame:
    """``df`` with ``text_col`` replaced by its token count; null texts have 0 tokens.

    ``vocabulary`` is the path of a tiktoken file, read once on the driver and
    broadcast (under 1 MB), so executors need no copy. Without one, tokens are
    runs of characters other than ASCII white space.
    """
    rest = [c for c in df.columns if c != text_col]
    if vocabulary is None:
        count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")
        return df.select(*rest, count.alias(name))
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @tc.tidy
    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            counts = [0 if t is None else len(enc.encode_ordinary(t)) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts, pa.int64())], names=[*rest, name])

    schema = df.select(*rest, F.lit(0).cast("long").alias(name)).schema
    return df.mapInArrow(run, schema)
