"""Stateful streams: bounded memory, several batches, and order."""

import inspect
import random

import pandas as pd

from quillspark.operators.access import AccessQueues
from quillspark.streaming import state


def replay(spark, root, parts, ddl, build):
    """Rows that a stream writes when each part is a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{root}/in/{i}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{root}/in/*")
    out = []
    q = build(source).writeStream.foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for rows in out for r in rows]


def test_order_is_kept_beyond_a_run():
    rnd = random.Random(1)
    rows = [(rnd.choice([float(rnd.randrange(50)), float("nan")]), rnd.choice(["a", "b", "é", "￿", "\U0001f600", None])) for _ in range(700)]
    batches = [pd.DataFrame(rows[i : i + 90], columns=["ts", "key"]) for i in range(0, 700, 90)]
    want = pd.concat(batches).sort_values(["ts", "key"], kind="stable")
    assert inspect.isgeneratorfunction(state.in_order)
    for run, block in ((100_000, 1000), (40, 7), (700, 3), (1, 1)):
        assert [repr((t, k)) for t, k in state.in_order(iter(batches), run, block)] == [repr((t, None if pd.isna(k) else k)) for t, k in zip(want["ts"].tolist(), want["key"].tolist())]
    assert list(state.in_order(iter([]))) == []


def test_promotions_hold_no_more_than_a_run():
    """Batches are taken one after another and let go: at most a run of rows is in memory before the merge."""
    import gc
    import weakref

    alive = []

    def batches():
        for i in range(40):
            b = pd.DataFrame({"ts": [float((i * 37 + j) % 100) for j in range(50)], "key": ["k"] * 50})
            alive.append(weakref.ref(b))
            yield b
            del b
            gc.collect()
            assert sum(r() is not None for r in alive) <= 2

    assert len(list(state.in_order(batches(), 100, 10))) == 2000


def test_promotion_stream_keeps_its_queues_between_batches(spark, tmp_path):
    rnd = random.Random(2)
    parts = [[(rnd.choice("xy"), f"k{rnd.randrange(9)}", b * 100.0 + rnd.randrange(90)) for _ in range(60)] for b in range(2)]
    got = replay(spark, tmp_path, parts, "scope string, key string, ts double", lambda e: state.promotion_stream(e, 4, 2))
    want = []
    for scope in "xy":
        q = AccessQueues(4, 2)
        want += [(scope, k, t) for part in parts for t, k in sorted((t, k) for s, k, t in part if s == scope) if q.touch(k, t)]
    assert sorted(got) == sorted(want) and want


def test_hot_sections_fire_once_over_batches(spark, tmp_path):
    parts = [[("d", "s", 1.0, 5.0), ("d", "s", 1.0, 1.0), ("d", "t", 3.0, 2.0)], [("d", "s", 1.5, 4.0), ("d", "s", 9.0, 9.0), ("d", "t", 9.0, 8.0), ("e", "s", 1.0, 1.0)]]
    got = replay(spark, tmp_path, parts, "doc_id string, section string, weight double, ts double", lambda e: state.hot_sections(e, 3.0, 100.0))
    assert sorted(got) == [("d", "s", 4.0, 3.5), ("d", "t", 2.0, 3.0)]


def test_sections_share_calls_of_python(spark, tmp_path):
    """Sections outnumber the groups that Python is called for; a call for each is what made the stream slow."""
    parts = [[(f"d{i}", "s", 1.0, float(b)) for i in range(300)] for b in range(2)]
    got = replay(spark, tmp_path, parts, "doc_id string, section string, weight double, ts double", lambda e: state.hot_sections(e, 2.0, 1e12, buckets=4))
    assert sorted(got) == sorted((f"d{i}", "s", 1.0, 2.0) for i in range(300))
