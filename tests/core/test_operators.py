import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import glob, text, vectors
from quillspark.operators import access, chunking, dedup, filters, fts, heat, profile, records, search, summaries, tasks, toc
from quillspark.plans.catalog import expired, route, ttl_seconds
from quillspark.sources.json_files import record_matches


def one(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("x")).first()["x"] if cols else spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.estimate_tokens(lit("x" * 18))) == 6 and one(spark, text.estimate_tokens(lit(""))) == 1
    assert one(spark, text.preview(lit("\n# title\n  first line here \nmore"))) == "first line here"
    assert one(spark, text.preview(lit("word " * 60))).endswith("word...") and one(spark, text.preview(lit("#a\n\n"))) == ""
    assert [one(spark, text.format_size(lit(n))) for n in (0, 1023, 2048, 3 * 1024**2, 5 * 1024**3, 2 * 1024**4)] == ["0 B", "1023 B", "2.0 KB", "3.0 MB", "5.0 GB", "2.0 TB"]
    assert one(spark, text.shorten(lit("a" * 30), 5, 5)) == "aaaaa...aaaaa (Len: 30)" and one(spark, text.shorten(lit("a" * 15), 5, 5)) == "a" * 15
    assert one(spark, text.has_cjk(lit("abc 漢字"))) and not one(spark, text.has_cjk(lit("abc é")))
    assert one(spark, text.labelled(lit("t"), lit("user"))) == "user: t" and one(spark, text.labelled(lit("t"), lit(""))) == "t"
    assert one(spark, text.first_paragraph(lit("# h\n\n one \n two\n\nthree"))) == "one two"
    assert one(spark, text.suffix(lit("A/b.TAR.gz"))) == "tar.gz" and one(spark, text.stem(lit("a/b.c.txt"))) == "b.c"
    assert one(spark, text.format_seconds(lit(0.25))) == "250ms" and one(spark, text.format_seconds(lit(2.5))) == "2.50s"


def test_glob():
    import fnmatch
    import re

    for p in ("*.md", "a?c", "src[0-4]", "src[!0-4]", "web:*", "a.b+c", "[x", "*"):
        for s in ("x.md", "abc", "src3", "src7", "web:a", "a.b+c", "[x", "", "axbxc"):
            assert bool(re.search(glob.glob_to_regex(p), s)) == fnmatch.fnmatchcase(s, p), (p, s)


def test_ignore(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("a/b.lock",), ("a/b.py",)], ["p"])
    assert [r[0] for r in df.where(~glob.ignored(F.col("p"), ["node_modules", "*.lock"])).collect()] == ["a/b.py"]


@pytest.mark.parametrize("args", [("a b", "eq", 1), ("a", "is", 1), ("a", "in", 1), ("a", "between", [1]), ("1a", "eq", 1)])
def test_bad_filters(args):
    with pytest.raises(ValueError):
        filters.MetadataFilter(*args)


def test_or_filters_stay_in_scope(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], ["doc_id", "v"])
    scope = search.scope_ids(docs=df, doc_ids=["a"])
    fs = filters.MetadataFilterSet((filters.MetadataFilter("v", "eq", 1), filters.MetadataFilter("v", "eq", 2)), "OR")
    assert [r["doc_id"] for r in filters.apply_filters(search.in_scope(df, scope), fs).collect()] == ["a"]


def test_sizes_beyond_the_largest_unit(spark):
    """The query's SQL ends at GB: keys above 2**20 have squares of a TB and more."""
    assert [one(spark, text.format_size(F.lit(n), "GB")) for n in (1023, 2048, 1024**4 - 1, 1024**4, 9_000_000**2)] == ["1023 B", "2.0 KB", "1024.0 GB", "1024.0 GB", "75437.1 GB"]
    assert one(spark, text.format_size(F.lit(1024**4))) == "1.0 TB" and one(spark, text.format_size(F.lit(5000), "B")) == "5000 B"


def test_resolve_prefix(spark):
    df = spark.createDataFrame([("abc1",), ("abd2",)], ["doc_id"])
    assert filters.resolve_prefix(df, "abc") == "abc1" and filters.resolve_prefix(df, "zz") is None
    with pytest.raises(ValueError):
        filters.resolve_prefix(df, "ab")


RECORDS = [
    '{"a": {"b": 1}, "tags": ["x", "y"], "s": "hello"}',
    '{"a": [{"b": 2}, {"b": 3}], "s": null}',
    '{"a": {"c": true}, "n": 1.5}',
    '{"items": [{"tags": ["p", "q"]}, {"tags": ["r"]}], "flag": false}',
    "[1, 2]",
    "broken",
    '{"a": {"b": "text 42"}}',
]
SPECS = [("a.b", "eq", 1), ("a.b", "eq", 3), ("a.b", "neq", 2), ("a.b", "gt", 1), ("a.b", "gte", 3), ("a.b", "lt", 2), ("a.b", "lte", 1), ("a.b", "in", [1, 2]), ("a.b", "nin", [1]), ("tags", "eq", "x"), ("tags", "contains", "y"), ("s", "contains", "ell"), ("s", "exists", True), ("s", "exists", False), ("s", "eq", None), ("a.c", "eq", True), ("n", "eq", 1.5), ("flag", "eq", False), ("items.tags", "eq", "r"), ("items.tags", "contains", "q"), ("a.b", "regex", r"\d+"), ("a.b", "gt", "s"), ("missing.x", "neq", 1), ("a.b", "exists", None)]


@pytest.mark.parametrize("field,op,value", SPECS)
def test_record_filters_equal_single_records(spark, field, op, value):
    import json

    df = spark.createDataFrame([(i, x) for i, x in enumerate(RECORDS)], ["i", "x"]).withColumn("r", records.parse("x"))
    got = {r["i"] for r in df.where(records.RecordFilter(field, op, value).column(F.col("r"))).collect()}
    want = set()
    for i, x in enumerate(RECORDS):
        try:
            rec = json.loads(x)
        except ValueError:
            continue
        if isinstance(rec, dict) and record_matches(rec, {"field": field, "op": op, "value": value}):
            want.add(i)
    if op == "exists" and value is False:
        got = {i for i in got if i not in (4, 5)}  # no records
    assert got == want


@pytest.mark.parametrize("op,value", [("in", [1, 2]), ("nin", [1, 2, 3]), ("eq", 1), ("gt", 1), ("contains", "x")])
def test_a_record_is_parsed_once(spark, op, value):
    """Catalyst puts the parser into the filter for each mention of the record; values are bound, not repeated."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(RECORDS)], ["i", "x"]).select("i", records.parse("x").alias("r"))
    both = records.RecordFilterSet.from_dicts([{"field": "a.b", "op": op, "value": value}, {"field": "s", "op": "exists"}])
    plan = df.where(both.column(F.col("r"))).select("i")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("parseJson") == 1


def test_bad_record_paths():
    for p in ("", "a..b", "__class__", "a.__dict__.b"):
        with pytest.raises(ValueError):
            records.RecordFilter(p)


def test_candidate_budget():
    assert search.candidate_limit(5) == 5
    assert search.candidate_limit(5, rerank=True, top_n=20) == 20
    assert search.candidate_limit(5, rerank=True, top_n=3, multiplier=4) == 20
    assert search.candidate_limit(5, heat_weight=0.1) == 10


def test_minmax_and_blend(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1), (2, 4.0, 0.9), (3, 3.0, 0.5)], ["chunk_id", "d", "r"])
    got = {r["chunk_id"]: r["_final_score"] for r in search.blend(df, F.col("d"), F.col("r"), 5.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}  # a weight above 1 counts as 1, so rerank decides alone
    same = df.withColumn("m", search.minmax(F.lit(7.0), [])).withColumn("i", search.minmax(F.lit(7.0), [], invert=True))
    assert {(r["m"], r["i"]) for r in same.collect()} == {(0.0, 1.0)}


def test_heat_bias_moves_a_chunk_up(spark):
    hits = spark.createDataFrame([("d", "a", 0.10), ("d", "b", 0.11)], ["doc_id", "section", "s"])
    hot = spark.createDataFrame([("d", "b", 50.0)], ["doc_id", "section", "heat"])
    best = search.heat_bias(hits, hot, F.col("s"), 0.5).orderBy("_final_score").first()
    assert best["section"] == "b" and math.isclose(best["_final_score"], 0.11 - 0.5 * 50 / 51)
    assert search.heat_bias(hits, hot, F.col("s"), 0.0).orderBy("_final_score").first()["section"] == "a"


def test_decay(spark):
    t = spark.createDataFrame([("d", "s", 1.0, 0.0), ("d", "s", 3.0, 100.0), ("d", " ", 9.0, 0.0), ("d", None, 9.0, 0.0), ("d", "z", 8.0, -300.0)], ["doc_id", "section", "weight", "ts"])
    got = {r["section"]: r["heat"] for r in heat.scores(heat.totals(t), F.lit(100.0), 100.0).collect()}
    assert got == {"s": 4.0, "z": 0.5}
    later = {r["section"]: r["heat"] for r in heat.scores(heat.totals(t), F.lit(300.0), 100.0).collect()}
    assert later["s"] == 1.0
    assert heat.scores(heat.totals(t), F.lit(-999.0), 100.0).where("section = 's'").first()["heat"] == 4.0


def test_heat_in_parts_equals_whole(spark):
    r = random.Random(0)
    rows = [(str(r.randrange(3)), str(r.randrange(4)), float(r.randrange(1, 4)), float(i)) for i in range(200)]
    make = lambda x: spark.createDataFrame(x, ["doc_id", "section", "weight", "ts"])
    whole = sorted(map(tuple, heat.totals(make(rows)).collect()))
    parts = heat.merge(heat.totals(make(rows[:90])), heat.totals(make(rows[90:])))
    assert sorted(map(tuple, parts.collect())) == whole


def test_access_queues():
    q = access.AccessQueues(2, 1)
    assert q.replay([("a", 1), ("b", 2), ("c", 3), ("b", 4), ("c", 5), ("a", 6), ("c", 7)]) == [False, False, False, True, True, False, False]
    assert list(q.hot) == ["c"] and list(q.recent) == ["a"] and q.stats()["hot_count"] == 1


def test_windows_cover_the_text(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abc ") for _ in range(n)), "sec") for i, n in enumerate([0, 1, 17_999, 18_000, 18_001, 35_500, 35_501, 53_000])]
    df = spark.createDataFrame(rows, ["id", "content", "section"])
    got = {}
    for p in chunking.embed_pieces(df).collect():
        got.setdefault(p["id"], []).append(p)
    for i, t, _ in rows:
        parts = sorted(got[i], key=lambda p: p["piece_index"])
        whole = parts[0]["piece"] + "".join(p["piece"][500:] for p in parts[1:])
        assert whole == t and all(len(p["piece"]) <= 18_000 for p in parts)
    assert len(got[2]) == 1 and got[2][0]["is_split"] is False or "[part 1/1]" in got[2][0]["embed_text"]
    assert [len(got[i]) for i in (4, 5, 6, 7)] == [2, 2, 3, 3]


def test_greedy_packing():
    parts = [("a", "x" * 300, 1), ("b", "y" * 300, 3), ("c", "z" * 300, 2), ("d", "w" * 6000, 3)]
    got = chunking.merge_small(parts)
    assert [s for s, _ in got] == ["a", "c", "d"] and got[0][1].endswith("y" * 300)
    t = "\n\n".join(f"Sentence {i}. " * 40 for i in range(30))
    pieces = chunking.split_long(t, 500, 10)
    assert len(pieces) > 5 and all(len(p) // 3 <= 520 for p in pieces)
    assert chunking.split_long("") == []


def test_toc_expansion(spark):
    rows = [("d", 0, 1, "Intro"), ("d", 1, 2, "Setup, part one"), ("d", 2, 3, "Linux"), ("d", 3, 2, "Use"), ("d", 4, 1, "End"), ("d", 5, 2, "")]
    t = spark.createDataFrame(rows, ["doc_id", "pos", "level", "title"])
    want = lambda s: spark.createDataFrame([("d", s)], "doc_id string, section string")
    got = lambda s: [r["title"] for r in toc.expand(t, want(s)).orderBy("pos").collect()]
    assert got("intro") == ["Intro", "Setup, part one", "Linux", "Use"] and got("SETUP") == ["Setup, part one", "Linux"] and got("") == []
    assert {r["title"]: r["path"] for r in toc.section_path(t).collect()}["Linux"] == "Intro > Setup, part one > Linux"


def _random_toc(spark, seed=5):
    rnd = random.Random(seed)
    titles = ["", "Alpha", "alpha beta", "Beta ", "gamma", "Gamma ray", None, "\u00c9t\u00e9", "ph"]
    rows = [(f"d{d}", rnd.randrange(25), rnd.choice([1, 2, 2, 3, 3, 4, None]), rnd.choice(titles)) for d in range(6) for _ in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id string, pos int, level int, title string")


def _end(rows, r):
    return min((x[1] for x in rows if x[0] == r[0] and x[1] > r[1] and None not in (x[2], r[2]) and x[2] <= r[2]), default=None)


def _alike(a, b):
    a, b = (a or "").strip(" ").lower(), (b or "").strip(" ").lower()
    return bool(a and b) and (a in b or b in a)


def test_toc_ends_by_brute_force(spark):
    """Ties of position, missing levels and several documents; no array of a document's entries in the plan."""
    rows, t = _random_toc(spark)
    df = toc.with_ends(t)
    assert sorted(map(repr, (tuple(r) for r in df.select("doc_id", "pos", "level", "title", "end_pos").collect()))) == sorted(repr((*r, _end(rows, r))) for r in rows)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_toc_ends_of_a_long_document(spark):
    """A scan of all entries for each entry makes 1,600,000,000 steps here."""
    t = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 100 == 0, 1).otherwise(2).alias("level"))
    got = toc.with_ends(t).agg(F.sum(F.col("end_pos") - F.col("pos")), F.count("end_pos")).first()
    assert tuple(got) == (399 * 100 + 400 * 99 - 1, 39_998)


def test_toc_expansion_by_brute_force(spark):
    """Nested and repeated finds, several names for a document, ties of position; no join by range or by all pairs."""
    rows, t = _random_toc(spark, 6)
    want = [(f"d{d}", s) for d in range(7) for s in ("alpha", "GAMMA RAY burst", "\u00e9", "beta", "", "none")] + [(None, "alpha"), ("d1", None)]
    df = toc.expand(t, spark.createDataFrame(want, "doc_id string, section string"))
    expected = set()
    for d, w in want:
        for r in rows:
            if r[0] == d and _alike(r[3], w):
                end = _end(rows, r)
                expected |= {(*x, w) for x in rows if x[0] == d and x[1] >= r[1] and (end is None or x[1] < end)}
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, expected))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Contains(" not in plan and "contains(" not in plan.lower()


def test_chunks_of_by_brute_force(spark):
    names = ["", "Alpha", "alpha beta", "Beta ", "gamma", None, "\u00c9t\u00e9 2", "x"]
    chunks = [(f"d{d}", i, n) for d in range(3) for i, n in enumerate(names * 2)]
    want = [("d0", "ALPHA"), ("d0", "alpha"), ("d1", "the gamma ray, beta"), ("d1", ""), ("d2", "\u00c9T"), ("d2", None), (None, "x")]
    df = toc.chunks_of(spark.createDataFrame(chunks, "doc_id string, chunk_index int, section string"), spark.createDataFrame(want, "doc_id string, title string"))
    expected = [c for c in chunks if any(d == c[0] and _alike(c[2], w) for d, w in want)]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, expected))
    assert "contains(" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_embedding_reads_a_text_once(spark):
    """The sum over the text stands outside the function of the components, where a Python function may stand too."""
    texts = ["", "abc", "\u00e9\u4e2d\U0001f600 x", None, "z" * 5000]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        calls.add(1)
        return t

    t = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    got = [r["v"] for r in t.select(vectors.deterministic_embedding(counted("t")).alias("v")).collect()]
    assert got == [[None] * 8 if x is None else [(sum(map(ord, x)) % 97 + i) % 17 / 17 for i in range(8)] for x in texts]
    assert calls.value == len(texts)


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], ["id", "rank"])
    b = spark.createDataFrame([("y", 1), ("z", 2)], ["id", "rank"])
    got = {r["id"]: r["_relevance_score"] for r in fts.fuse(a, b).collect()}
    assert max(got, key=got.get) == "y" and math.isclose(got["x"], 1 / 61) and math.isclose(got["z"], 1 / 62)


def test_tasks(spark):
    ddl = "doc_id string, priority int, submitted_at double, status string"
    t = spark.createDataFrame([("a", 0, 1.0, "pending"), ("b", 5, 2.0, "pending"), ("c", 5, 1.5, "pending"), ("d", 9, 0.0, "completed")], ddl)
    assert [r["doc_id"] for r in tasks.next_tasks(t, 3).collect()] == ["c", "b", "a"]
    new = spark.createDataFrame([("a", 7, 9.0, "pending"), ("d", 1, 9.0, "pending")], ddl)
    got = {r["doc_id"]: r["priority"] for r in tasks.submit(t, new).collect()}
    assert got == {"a": 0, "b": 5, "c": 5, "d": 1}
    assert {r["doc_id"] for r in tasks.clean(t, F.lit(90_000.0)).collect()} == {"a", "b", "c"}


def test_summaries(spark):
    df = spark.createDataFrame([("x" * 1000,), ("short",)], ["content"])
    assert {len(r["summary"]) for r in summaries.summarise(df).collect()} == {200, 5}
    got = {r["summary"] for r in summaries.summarise(df, lambda ts: [f"{len(t)} chars" for t in ts]).collect()}
    assert got == {"1000 chars", "short"}

    def fails(ts):
        raise RuntimeError("down")

    assert {len(r["summary"]) for r in summaries.summarise(df, fails).collect()} == {200, 5}


def test_routing_and_expiry(spark):
    docs = spark.createDataFrame([("1", "web:a"), ("2", "mail:b"), ("3", ""), ("4", None)], "doc_id string, source string")
    patterns = spark.createDataFrame([("w", "web:*"), ("all", "*")], ["name", "pattern"])
    assert sorted(map(tuple, route(docs, patterns).collect())) == [("all", "1"), ("all", "2"), ("w", "1")]
    c = spark.createDataFrame([("a", 0.0, "10"), ("b", 0.0, "2h"), ("c", 0.0, None), ("d", 0.0, "odd")], "name string, created_at double, ttl string")
    c = c.withColumn("ttl", ttl_seconds(F.col("ttl")))
    assert [r["name"] for r in expired(c, F.lit(20.0)).collect()] == ["a"]
    assert {r["name"] for r in expired(c, F.lit(7201.0)).collect()} == {"a", "b"}


def test_dedup(spark):
    rows = spark.createDataFrame([("p", "x"), ("q", "y")], ["path", "content"])
    known = spark.createDataFrame([("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", "doc")], ["hash", "doc_id"])
    new, seen = dedup.split_new(rows, known)
    assert [r["path"] for r in new.collect()] == ["q"] and [(r["path"], r["known_id"]) for r in seen.collect()] == [("p", "doc")]


def test_profile_dates(spark):
    df = spark.createDataFrame([("2024-01-02", "x"), ("2024-02-03", "2024-01-01")], ["a", "b"])
    assert profile.looks_like_dates(df, "a") and not profile.looks_like_dates(df, "b")


def test_telemetry(spark):
    from quillspark.operators import telemetry

    rows = [("a", "probe", 0.5, 10, 0.9, 2), ("a", "embedding", 1.5, None, None, None), ("a", "probe", 0.25, None, None, None)]
    t = spark.createDataFrame(rows, "doc_id string, phase string, seconds double, tokens long, saved_ratio double, num_chunks int")
    got = telemetry.summary(t).first()
    assert (got["probe_seconds"], got["embedding_seconds"], got["tokens"], got["num_chunks"]) == (0.75, 1.5, 10, 2)
    assert telemetry.text(telemetry.summary(t)).first()["line"] == "probe 750ms | embedding 1.50s | 10 tokens | 2 chunks | 90% saved"


def test_sound_offsets(spark):
    from quillspark.streaming.watch import sound_offsets

    o = spark.createDataFrame([("/x/s1.jsonl", 40), ("/x/s2.jsonl", 50)], "path string, offset long")
    c = spark.createDataFrame([("s1",), (None,)], "session_id string")
    assert {tuple(r) for r in sound_offsets(o, c).collect()} == {("/x/s1.jsonl", 40), ("/x/s2.jsonl", 0)}
