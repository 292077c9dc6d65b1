"""Substring deduplication by content-defined chunking.

A gear hash of the last 16 bytes marks chunk ends, so that a passage is cut in
the same places wherever it stands and an insertion shifts no cut beyond its
own neighbourhood. Chunks are compared by a 64-bit digest; of equal chunks the
first (least document id, then key, then position) stays. Neighbouring repeats
form runs, and only runs of ``min_run`` bytes or more count as repeated
passages: chance repeats of a few words stay in the text.

A position is a cut when its gear hash has ``mask_bits`` leading zero bits and
no such position lies within the ``min_chunk`` bytes before it; both tests see
local bytes only. Gaps over ``max_chunk`` bytes are cut at multiples of it. No
cut falls inside a UTF-8 character.

Defined results: null and empty texts have no chunks and stay as they are;
repeated rows, with equal id and text, are one document; documents of equal
text and different ids repeat each other wholly; rows without id sort before
all others; an id that is no whole number fails the cast; an empty table gives
no rows; a very long text is cut into chunks like any other. Other columns pass
through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import row_key

GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(buf: np.ndarray, width: int = 16) -> np.ndarray:
    """Rolling hash of each position's last ``width`` bytes, in log2(width) doubling steps.

    Equals ``h = (h << 1) + GEAR[b]`` with bytes older than ``width`` forgotten.
    """
    h, step = GEAR[buf], 1
    while step < width:
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def cuts(buf: np.ndarray, off: np.ndarray, mask_bits: int, min_chunk: int, max_chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk of each text in the buffer."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the hash covers 16 bytes, 5 to 12 of which reach the bits that are tested
    marks = np.flatnonzero(((gear_hash(buf) >> np.uint32(12 - mask_bits)) & np.uint32((1 << mask_bits) - 1)) == 0) + 1
    marks = marks[np.diff(marks, prepend=-min_chunk) >= min_chunk]
    row = np.searchsorted(off, marks, "right") - 1
    inside = (marks < n) & (row < len(off) - 1)
    marks = marks[inside & (marks - off[np.minimum(row, len(off) - 2)] >= min(12, min_chunk))]
    edges = np.unique(np.concatenate([off, marks]))
    gap = np.diff(edges)
    long = np.flatnonzero(gap > max_chunk)
    if len(long):
        more = (gap[long] - 1) // max_chunk
        head = np.cumsum(more) - more
        nth = np.arange(more.sum()) - np.repeat(head, more) + 1
        edges = np.sort(np.concatenate([edges, np.repeat(edges[long], more) + nth * max_chunk]))
    for _ in range(3):  # a character has at most three bytes after its first
        inner = edges < n
        edges[inner] += (buf[edges[inner]] & 0xC0) == 0x80
    edges = np.unique(edges)
    return edges[:-1], edges[1:]


_CHUNKS = "k long, id long, s int, e int, digest long"


def _chunker(mask_bits: int, min_chunk: int, max_chunk: int):
    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "t"):
                buf, off = tc.buffers(part.column("t"))
                s, e = cuts(buf, off, mask_bits, min_chunk, max_chunk)
                if not len(s):
                    continue
                row = np.searchsorted(off, s, "right") - 1
                digest = tc.SpanHash(buf)(s, e)
                yield pa.record_batch(
                    {
                        "k": pa.array(part.column("k").to_numpy()[row]),
                        "id": part.column("i").take(pa.array(row)),
                        "s": pa.array((s - off[row]).astype(np.int32)),
                        "e": pa.array((e - off[row]).astype(np.int32)),
                        "digest": pa.array(digest.view(np.int64)),
                    }
                )

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return base.where("t is not null and t <> ''").select(row_key("i", "t").alias("k"), "i", "t")


def runs(marked: DataFrame, min_run: int) -> DataFrame:
    """Joins touching pieces ``(k, id, s, e, src, at)`` of a document into spans of ``min_run`` bytes or more.

    A span's source is that of its first piece.
    """
    order = Window.partitionBy("k").orderBy("s", "e")
    until = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = marked.withColumn("fresh", F.when(F.col("s") <= until, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    spans = pieces.groupBy("k", "run").agg(F.first("id").alias("id"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by(F.struct("src", "at"), "s").alias("f"))
    return spans.where(F.col("e") - F.col("s") >= min_run).select("k", "id", "s", "e", "f.src", "f.at")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = 4, min_chunk: int = 16, max_chunk: int = 512, min_run: int = 112) -> DataFrame:
    """Byte spans ``(k, id, s, e, src, at)`` of passages that repeat an earlier one; src and at name the first."""
    chunks = _base(docs, id_col, text_col).mapInArrow(_chunker(mask_bits, min_chunk, max_chunk), _CHUNKS)
    first = chunks.groupBy("digest").agg(F.min(F.struct(F.col("id"), F.col("k"), F.col("s"))).alias("f"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", "f")
    again = chunks.join(first, "digest").where("not (k = f.k and s = f.s)")
    # rows that repeat id and text give the same pieces twice; they are one document
    marked = again.select("k", "id", "s", "e", F.col("f.id").alias("src"), F.col("f.s").alias("at"))
    return runs(marked, min_run)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per repeated passage: document, bytes from and to, and the document and byte of the first occurrence."""
    spans = repeated_spans(docs, id_col, text_col, **how)
    return spans.select(F.col("id").alias("doc_id"), F.col("s").alias("start_byte"), F.col("e").alias("end_byte"), F.col("src").alias("first_doc_id"), F.col("at").alias("first_byte"))


def _cut_out(batches):
    for batch in batches:
        spans, texts = batch.column("spans"), batch.column("t")
        out = texts.to_pylist()
        for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
            raw, at, kept = out[i].encode(), 0, []
            for x in sorted(spans[int(i)].as_py(), key=lambda x: x["s"]):
                lo, hi = x["s"], x["e"]
                while lo < hi and raw[lo] & 0xC0 == 0x80:
                    lo += 1
                while lo < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                kept.append(raw[at:lo])
                at = max(at, hi)
            out[i] = b"".join([*kept, raw[at:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(out, texts.type), batch.column("spans")], schema=batch.schema)


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    """The documents without the spans; one of whose text nothing but white space is left goes."""
    lists = spans.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    # the row's other columns travel in a struct, so that no name of theirs meets one used here
    base = docs.select(F.struct(*rest).alias("own"), F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    joined = base.withColumn("k", row_key("i", "t")).join(lists, "k", "left").select("own", "t", "spans")
    cut = joined.mapInArrow(tc.tidy(_cut_out), joined.schema).where(F.col("spans").isNull() | F.col("t").rlike(r"\S"))
    out = {c: F.col("t") if c == text_col else F.col("own")[c] for c in docs.columns}
    if chars_col and chars_col in out:
        length = F.length("t").cast(docs.schema[chars_col].dataType)
        out[chars_col] = F.when(F.col("spans").isNull(), out[chars_col]).otherwise(length)
    return cut.select(*[v.alias(c) for c, v in out.items()])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The documents with every repeated passage cut out but at its first occurrence."""
    return without_spans(docs, repeated_spans(docs, id_col, text_col, **how), id_col, text_col, chars_col)
