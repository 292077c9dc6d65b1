"""Stateful streams: heat with a one-time hot trigger, and promotion queues."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import heat
from ..operators.access import AccessQueues


def heat_stream(events: DataFrame) -> DataFrame:
    """Running totals by document and section, from a stream of ``(doc_id, section, weight, ts)``; equal to the batch
    totals over the same events. Write it in update or complete mode. Late events count like any others."""
    return heat.totals(events)


def hot_sections(events: DataFrame, threshold: float, half_life: float, buckets: int = 1024) -> DataFrame:
    """``(doc_id, section, ts, heat)`` once for each section, when its decayed score first reaches the threshold.

    Sections are kept by buckets of their hash, as a call of Python for each section costs far more than its few
    events. A batch rewrites the buckets that it meets. A checkpoint goes with its number of buckets.
    """
    hl = max(1.0, half_life)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {(d, s): (raw, last, fired) for d, s, raw, last, fired in zip(*state.get)} if state.exists else {}
        parts = [(b["ts"].to_numpy(dtype=float), b["weight"].to_numpy(dtype=float), b["doc_id"].to_numpy(dtype=object), b["section"].to_numpy(dtype=object)) for b in batches]
        times, *rest = map(np.concatenate, zip(*parts))
        order = np.argsort(times, kind="stable")
        out = []
        for ts, w, *section in zip(times[order].tolist(), *(x[order].tolist() for x in rest)):
            raw, last, fired = kept.get(name := tuple(section), (0.0, 0.0, False))
            raw, last = raw + w, max(last, ts)
            score = raw * 0.5 ** (max(0.0, ts - last) / hl)
            if score >= threshold and not fired:
                fired = True
                out.append((*name, ts, score))
            kept[name] = raw, last, fired
        state.update(tuple(map(list, zip(*(name + of for name, of in kept.items())))))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "section", "ts", "heat"])

    real = events.where(F.trim(F.coalesce("section", F.lit(""))) != "").select(F.pmod(F.xxhash64("doc_id", "section"), F.lit(buckets)).alias("bucket"), "doc_id", "section", F.col("weight").cast("double"), F.col("ts").cast("double"))
    kept = "doc array<string>, section array<string>, raw array<double>, last array<double>, fired array<boolean>"
    return real.groupBy("bucket").applyInPandasWithState(step, "doc_id string, section string, ts double, heat double", kept, "append", GroupStateTimeout.NoTimeout)


def in_order(batches: Iterator[pd.DataFrame], run: int = 100_000, block: int = 1_000) -> Iterator[tuple[float, str]]:
    """``(ts, key)`` of all rows by time and key, missing values last. Rows beyond a run wait in a file, sorted by runs
    that are merged block by block, so memory is that of one run and of a block from each."""
    rows: list[tuple] = []
    runs: list[list[tuple[int, int]]] = []
    with tempfile.TemporaryFile() as file:

        def put() -> None:
            rows.sort()
            runs.append([])
            for i in range(0, len(rows), block):
                data = pickle.dumps(rows[i : i + block], pickle.HIGHEST_PROTOCOL)
                runs[-1].append((file.tell(), len(data)))
                file.write(data)
            rows.clear()

        def read(places: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in places:
                file.seek(at)
                yield from pickle.loads(file.read(size))

        for batch in batches:
            times, keys = batch["ts"].to_numpy(dtype=float).tolist(), batch["key"].tolist()
            for i in range(0, len(keys), run):
                rows += [(t != t, 0.0 if t != t else t, k is None, k or "") for t, k in zip(times[i : i + run], keys[i : i + run])]
                if len(rows) >= run:
                    put()
        rows.sort()
        for late, t, none, k in heapq.merge(rows, *map(read, runs)) if runs else rows:
            yield (float("nan") if late else t), (None if none else k)


def promotion_stream(events: DataFrame, recent_size: int = 200, hot_size: int = 50) -> DataFrame:
    """``(scope, key, ts)`` of promotions from a stream of ``(scope, key, ts)``; each scope has its own two queues."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = AccessQueues(recent_size, hot_size)
        if state.exists:
            recent, hot = state.get
            q.recent.update({r.split("\x1f")[0]: float(r.split("\x1f")[1]) for r in recent})
            q.hot.update({r.split("\x1f")[0]: float(r.split("\x1f")[1]) for r in hot})
        out: list[tuple] = []
        for ts, k in in_order(batches):
            if q.touch(k, ts):
                out.append((key[0], k, ts))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["scope", "key", "ts"])
                out = []
        pack = lambda d: [f"{k}\x1f{t}" for k, t in d.items()]
        state.update((pack(q.recent), pack(q.hot)))
        if out:
            yield pd.DataFrame(out, columns=["scope", "key", "ts"])

    return events.groupBy("scope").applyInPandasWithState(step, "scope string, key string, ts double", "recent array<string>, hot array<string>", "append", GroupStateTimeout.NoTimeout)
