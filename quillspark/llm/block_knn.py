"""Nearest neighbours of every vector by a block matrix join on int8 codes.

Each vector is stored as int8 codes with a scale, ``v = scale * code + error``,
and the norm of its error. For every pair of blocks the product tile of the
codes, exact in whole numbers, gives each inner product up to a bound: the
codes' part differs from the true value by at most
``|a| * err_b + |b| * err_a + err_a * err_b``. From squared distances with
that bound follow a lower and an upper limit for each pair. A pair whose lower
limit is above the row's k-th least upper limit can't be among its k nearest
and goes; the survivors are recomputed in float, and per-row heaps merge the
tiles' results. The answer is therefore exact, ties aside, for which the least
id comes first.

A stated query set, all rows unless told, asks all rows. Blocks of rows travel
once per tile row and column as packed matrices, so tasks multiply matrices
instead of joining rows; a query block's tiles are worked on in turn within a
group, so the limit tightens from tile to tile. Work is queries times rows, as
an exact search must be; the shuffled volume is rows times the number of query
blocks, which ``query_rows`` sets.

Defined results: a row with a null id or vector, an empty vector, or one that
holds null, NaN or an infinity is left out; vectors must agree in length, else
``ValueError`` in the task; repeated ids count once (the first in vector order,
a query if one of them is); vectors of doubles count as floats; an id that is no
whole number fails the cast; a row is never its own neighbour; with k or fewer other rows all are listed.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import materialise


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the rows."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - code * scale[:, None].astype(np.float64), axis=1)
    return code, scale, error * (1 + 1e-9) + 1e-12


def _pack(ids: np.ndarray, x: np.ndarray) -> bytes:
    return np.array([len(ids), x.shape[1] if len(ids) else 0], np.int64).tobytes() + ids.tobytes() + x.tobytes()


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dim = np.frombuffer(b, np.int64, 2)
    return np.frombuffer(b, np.int64, n, 16), np.frombuffer(b, np.float32, n * dim, 16 + 8 * n).reshape(n, dim)


def _block(table: pa.Table) -> pa.Table:
    """Rows of one block as a packed matrix."""
    table = table.sort_by([("i", "ascending")])
    lists = table.column("v").combine_chunks()
    lengths = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(table.num_rows, -1)
    return pa.table({"b": table.column("b").slice(0, 1), "blob": pa.array([_pack(table.column("i").to_numpy(), x)], pa.binary())})


def tile_survivors(a: tuple, b: tuple, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the pairs that may be among a row's k nearest, and each row's new limit.

    ``a`` and ``b`` are ``(vectors, codes, scales, error norms)``. float32 holds
    the integer products exactly up to 1040 dimensions; longer vectors use float64.
    """
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = a[1].astype(exact) @ b[1].astype(exact).T
    dot = product.astype(np.float64) * a[2][:, None] * b[2][None, :]
    na, nb = np.linalg.norm(a[0].astype(np.float64), axis=1), np.linalg.norm(b[0].astype(np.float64), axis=1)
    slack = na[:, None] * b[3][None, :] + nb[None, :] * a[3][:, None] + a[3][:, None] * b[3][None, :]
    centre = (na * na)[:, None] + (nb * nb)[None, :] - 2 * dot
    upper = centre + 2 * slack
    if upper.shape[1] > k:
        limit = np.minimum(limit, np.partition(upper, k, axis=1)[:, k])  # k others beside the row itself
    r, c = np.nonzero(centre - 2 * slack <= limit[:, None])
    return r, c, limit


def _tiles(k: int):
    schema = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        blobs, side = table.column("blob"), table.column("side").to_numpy()
        mine = np.flatnonzero(side == 0)
        if not len(mine):
            return schema.empty_table()
        ids, x = _unpack(blobs[int(mine[0])].as_py())
        a = (x, *quantise(x))
        heaps: list[list] = [[] for _ in ids]
        limit = np.full(len(ids), np.inf)
        for at in np.flatnonzero(side == 1):
            other, y = _unpack(blobs[int(at)].as_py())
            b = (y, *quantise(y))
            for lo in range(0, len(ids), 512):
                hi = min(lo + 512, len(ids))
                part = tuple(v[lo:hi] for v in a)
                r, c, limit[lo:hi] = tile_survivors(part, b, limit[lo:hi], k)
                d = ((x[lo + r].astype(np.float64) - y[c]) ** 2).sum(1)
                order = np.lexsort((other[c], d, r))
                r, c, d = r[order], c[order], d[order]
                for row, col, dist in zip((lo + r).tolist(), other[c].tolist(), d.tolist()):
                    if col == ids[row]:
                        continue
                    item = (-dist, -col)
                    if len(heaps[row]) < k:
                        heapq.heappush(heaps[row], item)
                    elif item > heaps[row][0]:
                        heapq.heapreplace(heaps[row], item)
                for row in range(lo, hi):
                    if len(heaps[row]) == k:
                        limit[row] = min(limit[row], -heaps[row][0][0] * (1 + 1e-9) + 1e-12)
        rows = [(int(i), -n, -d) for i, h in zip(ids, heaps) for d, n in h]
        return pa.table({n: [r[j] for r in rows] for j, n in enumerate(schema.names)}, schema=schema)

    return run


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, queries: Column | None = None, query_rows: int = 1024, block_rows: int = 4096, span_blocks: int = 4) -> DataFrame:
    """``(vec_id, rank, neighbour_id, distance)``: squared Euclidean distance, rank from 1.

    ``queries`` says which rows ask, all unless told; every row can answer. A
    block of ``query_rows`` of them meets ``span_blocks`` blocks of
    ``block_rows`` rows in one task; the spans' heaps are merged by rank
    afterwards.
    """
    asks = F.lit(True) if queries is None else F.coalesce(queries.cast("boolean"), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<float>").alias("v"), asks.alias("q"))
    whole = "i is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf'))"
    base = materialise(base.where(whole).groupBy("i").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    held, asked = base.agg(F.count("*"), F.count_if("q")).first()
    blocks, fronts = max(1, -(-held // block_rows)), max(1, -(-asked // query_rows))
    spans = -(-blocks // span_blocks)
    spread = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    packed = base.withColumn("b", spread(blocks)).groupBy("b").applyInArrow(tc.tidy(_block), "b int, blob binary")
    front = base.where("q").withColumn("b", spread(fronts)).groupBy("b").applyInArrow(tc.tidy(_block), "b int, blob binary")
    rows = front.select(F.col("b").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(0).alias("side"), "blob")
    cols = packed.select(F.explode(F.sequence(F.lit(0), F.lit(fronts - 1))).alias("row"), F.floor(F.col("b") / span_blocks).cast("int").alias("span"), F.lit(1).alias("side"), "blob")
    found = rows.union(cols).repartition(fronts * spans, "row", "span").groupBy("row", "span").applyInArrow(_tiles(k), "vec_id long, neighbour_id long, distance double")
    best = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("best"))
    out = best.select("vec_id", F.posexplode("best").alias("at", "n"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.round("n.distance", 6).alias("distance"))
