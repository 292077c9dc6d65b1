"""Packing by optimal length buckets.

A dynamic programme over the histogram of all token lengths chooses the bucket
lengths that pad the fewest tokens; every sequence is padded to the least
bucket length that holds it, and batches of at most ``token_budget`` padded
tokens form inside each bucket.

The programme is exact. Its cost for a bucket is a line in the lower boundary,
so a monotone convex hull finds each step's optimum in constant amortised time:
O(buckets x distinct lengths) on the driver, which only ever sees the
histogram. Batches are numbered inside shards of a bucket, whose number follows
the bucket's size, so no task sorts a whole bucket; only the last batch of a
shard may be short.

Defined results: documents without tokens (null or empty text) take no place
and have no row; repeated rows are packed each; a sequence longer than the
budget is a batch of its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import materialise, row_key
from .tokens import with_counts

#: Batches that a shard holds when full.
SHARD_BATCHES = 512


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket lengths, ascending, at most ``buckets`` of them, that minimise padding; the last is the longest length."""
    lengths = sorted(n for n, c in histogram.items() if c > 0)
    h = len(lengths)
    if h <= buckets:
        return lengths
    count, tokens = [0], [0]
    for n in lengths:
        count.append(count[-1] + histogram[n])
        tokens.append(tokens[-1] + n * histogram[n])
    # best[j]: least padding of the first j lengths; padding of (i, j] is L_j * (C_j - C_i) - (S_j - S_i)
    best = [0] + [lengths[j - 1] * count[j] - tokens[j] for j in range(1, h + 1)]
    back = []
    for _ in range(1, buckets):
        hull: list[int] = []  # lower boundaries as lines -C_i * L + (best_i + S_i), slopes falling
        new, choice, at = [0] * (h + 1), [0] * (h + 1), 0
        for j in range(1, h + 1):
            i = j - 1
            b = best[i] + tokens[i]
            while len(hull) >= 2:
                p, q = hull[-2], hull[-1]
                bp, bq = best[p] + tokens[p], best[q] + tokens[q]
                # q is never least if i overtakes p before q does
                if (b - bp) * (count[q] - count[p]) <= (bq - bp) * (count[i] - count[p]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            at = min(at, len(hull) - 1)
            value = lambda i: best[i] + tokens[i] - count[i] * lengths[j - 1]  # noqa: B023, E731
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            new[j] = lengths[j - 1] * count[j] - tokens[j] + value(hull[at])
            choice[j] = hull[at]
        back.append(choice)
        best = new
    out, j = [], h
    for choice in reversed(back):
        out.append(lengths[j - 1])
        j = choice[j]
        if j == 0:
            break
    if j:
        out.append(lengths[j - 1])
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, token_budget: int = 65_536, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, bucket_len, padding, batch)``: the batch's name is unique over the table."""
    if buckets < 1 or token_budget < 1:
        raise ValueError("buckets and token_budget are at least 1")
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).select(row_key("i", "t").alias("k"), "i", "t")
    lens = materialise(with_counts(base, "t", vocabulary).where("n_tokens > 0"))
    histogram = {r[0]: r[1] for r in lens.groupBy("n_tokens").count().toLocalIterator()}
    edges = optimal_buckets(histogram, buckets) or [0]
    held = [0] * len(edges)
    for n, c in histogram.items():
        held[next(b for b, e in enumerate(edges) if n <= e)] += c
    cap = [max(1, token_budget // max(1, e)) for e in edges]
    shards = [max(1, -(-c // (m * SHARD_BATCHES))) for c, m in zip(held, cap)]

    def by_bucket(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e < F.col("n_tokens")))
    placed = lens.withColumn("bucket", bucket).withColumn("shard", F.pmod("k", by_bucket(shards)))
    order = Window.partitionBy("bucket", "shard").orderBy("k", "i")
    seq = F.floor((F.row_number().over(order) - 1) / by_bucket(cap)).cast("long")
    out = placed.withColumn("seq", seq).withColumn("bucket_len", by_bucket(edges).cast("long"))
    return out.select(F.col("i").alias("doc_id"), "n_tokens", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), F.concat_ws("-", "bucket", "shard", "seq").alias("batch"))
