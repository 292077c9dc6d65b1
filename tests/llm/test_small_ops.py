"""Packing, mixing, licenses, languages, quality rules and neighbours."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import block_knn, langid, license_scan, mixing, packing, quality_rules, tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# --- packing ---


def padding(hist, edges):
    return sum(c * (min(e for e in edges if e >= n) - n) for n, c in hist.items())


def test_buckets_are_optimal():
    r = random.Random(0)
    for _ in range(150):
        hist = {r.randint(1, 60): r.randint(1, 30) for _ in range(r.randint(1, 9))}
        k = r.randint(1, 5)
        got = packing.optimal_buckets(hist, k)
        ls = sorted(hist)
        best = min(padding(hist, (*c, ls[-1])) for m in range(min(k, len(ls))) for c in itertools.combinations(ls[:-1], m))
        assert len(got) <= k and got[-1] == ls[-1] and padding(hist, got) == best


def test_batches(frame, prose):
    r = random.Random(1)
    rows = [(i, prose(i, r.randint(1, 90))) for i in range(200)] + [(500, prose(9, 3000)), (501, ""), (502, None), (1, prose(1, 5)), (1, prose(1, 5)), (None, "two words")]
    got = packing.pack(frame(rows, "batch"), buckets=4, token_budget=256).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(t.split()) for _, t in rows if t)
    by = {}
    for x in got:
        assert x["padding"] == x["bucket_len"] - x["n_tokens"] >= 0
        by.setdefault(x["batch"], []).append(x)
    hist = {}
    for x in got:
        hist[x["n_tokens"]] = hist.get(x["n_tokens"], 0) + 1
    assert sum(x["padding"] for x in got) == padding(hist, packing.optimal_buckets(hist, 4))
    for b in by.values():
        assert len({x["bucket_len"] for x in b}) == 1
        assert len(b) == 1 or sum(x["bucket_len"] for x in b) <= 256
    per = {}
    for b in by.values():
        per.setdefault(b[0]["bucket_len"], []).append(len(b))
    for length, sizes in per.items():  # all full but one
        assert sum(n < max(1, 256 // length) for n in sizes) <= 1
    assert packing.pack(frame([])).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_token_counts_round_trip(frame):
    texts = ["Hello world, this is it.", "größe  \n\n x", None, ""]
    got = {r[0]: r[1] for r in tokens.with_counts(frame(list(enumerate(texts))).select("doc_id", "text"), "text", VOCABULARY).collect()}
    enc = tokens.encoder(open(VOCABULARY, "rb").read())
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == len(ids) and enc.decode(ids) == (t or "")


# --- mixing ---


def test_budgets_follow_weights_and_redistribute():
    have = {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "z"): 1000}
    w = {"a": (0.5, {"x": 0.5, "y": 0.5}), "b": (0.5, {"x": 0.5, "z": 0.5})}
    assert mixing.budgets(have, w, 400, 1) == {("a", "x"): 100, ("a", "y"): 100, ("b", "x"): 100, ("b", "z"): 100}
    # x of a is short: its sibling takes the rest, b is untouched
    assert mixing.budgets(have, w, 1000, 1) == {("a", "x"): 100, ("a", "y"): 400, ("b", "x"): 250, ("b", "z"): 250}
    # all of a is short: what it lacks goes to b
    assert mixing.budgets(have, w, 2600, 1) == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 750, ("b", "z"): 750}
    assert mixing.budgets(have, w, 2600, 2)[("a", "x")] == 200
    assert sum(mixing.budgets(have, w, 10**6, 1).values()) == 3100
    assert mixing.budgets(have, {"a": 1.0}, 100, 1)[("b", "x")] == 0
    assert mixing.budgets({}, w, 100, 1) == {}


def brute_mix(rows, weights, fraction, epochs, hashes):
    """Each leaf's documents in order of their places, taken while the sum allows."""
    n = {k: len((t or "").split()) for k, t in rows}
    leaf = {k: ("even" if k % 2 == 0 else "odd", f"src{k % 5}") for k, _ in rows}
    have = {}
    for k, _ in rows:
        have[leaf[k]] = have.get(leaf[k], 0) + n[k]
    plan, out = mixing.budgets(have, weights, int(fraction * sum(have.values())), epochs), []
    for x, total in have.items():
        whole, rest = divmod(plan[x], total) if total else (0, 0)  # documents without tokens come with what reaches them
        mine = [k for k, _ in rows if leaf[k] == x]
        out += [(k, e) for k in mine for e in range(whole)]
        if rest:
            at = 0
            for k in sorted(mine, key=lambda k: hashes[whole, k]):
                at += n[k]
                if at > rest:
                    break
                out.append((k, whole))
    return sorted(out)


def test_mix_equals_brute_force(spark, frame, prose):
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(0, 60))) for i in range(300)]
    docs = frame(rows, "clash")
    levels = [F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"), F.col("source")]
    keyed = docs.select("doc_id", mixing.row_key("doc_id", "text").alias("k"))
    hashes = {(e, x[0]): x[1] for e in range(4) for x in keyed.select("doc_id", F.xxhash64(F.lit(17), F.lit(e), "k")).collect()}
    for weights, fraction, epochs in (({"even": 0.8, "odd": 0.2}, 0.7, 2), ({"even": (0.3, {"src0": 0.9, "*": 0.05}), "odd": 0.7}, 1.3, 3), ({"odd": 1.0}, 0.2, 1)):
        got = sorted((x["doc_id"], x["epoch"]) for x in mixing.mix(docs, levels, weights, fraction, epochs).collect())
        assert got == brute_mix(rows, weights, fraction, epochs, hashes)


def test_budgets_of_many_leaves():
    have = {("d", "en", f"s{i}"): i % 90 for i in range(20_000)}
    got = mixing.budgets(have, None, sum(have.values()) // 2, 1)
    level = max(got.values())
    assert all(v in (have[k], level) for k, v in got.items()) and abs(sum(got.values()) - sum(have.values()) // 2) < len(have)


def test_mix_odd_rows(frame, prose):
    docs = frame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y")], "epoch").withColumn("lang", F.when(F.col("doc_id") == 1, F.col("lang")))
    got = mixing.mix(docs, [F.col("lang"), F.col("source")], None, fraction=1.0, max_epochs=1)
    assert got.columns == [*docs.columns, "leaf", "epoch_"]
    # leaves of empty documents alone give nothing; a leaf with a budget takes its empty ones along
    assert sorted((r["doc_id"] or 0, r["leaf"]) for r in got.collect()) == [(0, ["(none)", "src0"]), (1, ["en", "src1"]), (1, ["en", "src1"])]
    assert mixing.mix(frame([]), [F.col("lang")], None).count() == 0
    clash = frame([(5, prose(1, 30_000)), (10, ""), (15, "a b")]).selectExpr("*", "1 AS k", "2 AS own", "3 AS whole", "4 AS last", "5 AS `odd.name`", "6 AS r", "'z' AS l0")
    got = mixing.mix(clash, [F.col("source")], None, fraction=1.0, max_epochs=1)
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 10, 15] and set(map(tuple, got.select("k", "own", "whole", "last", "`odd.name`", "r", "l0").collect())) == {(1, 2, 3, 4, 5, 6, "z")}


def test_weightless_leaves_give_nothing(frame):
    docs = frame([(1, "a b c"), (2, ""), (3, None), (6, "x y z")])
    assert {r["doc_id"] for r in mixing.mix(docs, [F.col("source")], {"src1": 1.0}, fraction=1.0, max_epochs=2).collect()} == {1, 6}
    assert mixing.mix(docs, [F.col("source")], {"src2": 1.0}, fraction=1.0).count() == 0


# --- licenses ---


def test_licenses_found_with_spans(frame, prose):
    t = license_scan.TEMPLATES
    mit = t["MIT"].split()
    changed = " ".join("XX" if i % 25 == 7 else w for i, w in enumerate(mit[:40] + ["an", "added", "word"] + mit[40:]))
    rows = [(1, prose(1, 50) + "\n" + t["MIT"] + "\n" + prose(2, 20)), (2, "# " + changed), (3, prose(3, 80)), (4, "x " + t["Apache-2.0-notice"] + ". " + prose(4, 30) + " LICENSED under the apache license; version 2.0!"), (5, " ".join(mit[:20])), (6, None), (7, ""), (8, t["BSD-2-Clause"]), (None, t["ISC"]), (9, t["MIT-notice"]), (9, t["MIT-notice"]), (10, prose(5, 30_000) + " " + t["GPL-3.0-notice"])]
    got = license_scan.scan(frame(rows, "license")).collect()
    found = sorted((r["doc_id"] or 0, r["license"]) for r in got)
    assert found == [(0, "ISC"), (1, "MIT"), (2, "MIT"), (4, "Apache-2.0-notice"), (4, "Apache-2.0-notice"), (8, "BSD-2-Clause"), (9, "MIT-notice"), (9, "MIT-notice"), (10, "GPL-3.0-notice")]
    text = {i: x for i, x in rows}
    for r in got:
        piece = text[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower()
        first, last = t[r["license"]].lower().split()[0], t[r["license"]].lower().split()[-1].strip('.)"')
        assert piece.startswith(first) and piece.endswith(last)
        assert r["coverage"] == 1.0 if r["doc_id"] != 2 else 0.9 < r["coverage"] < 1
    assert license_scan.scan(frame([])).count() == 0


def test_apache_header_is_found_whole_and_without_its_first_line(frame, prose):
    head = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"
    )
    rest = head[head.index("(the") :]
    rows = [(1, prose(1, 20) + "\n" + head + ".\n" + prose(2, 20)), (2, rest), (3, license_scan.TEMPLATES["Apache-2.0-notice"])]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(rows)).collect()}
    assert [(i, r["license"]) for i, r in sorted(got.items())] == [(1, "Apache-2.0-header"), (2, "Apache-2.0-header"), (3, "Apache-2.0-notice")]
    assert got[1]["coverage"] == 1.0 and rows[0][1][got[1]["start_byte"] : got[1]["end_byte"]] == head
    assert 0.8 < got[2]["coverage"] < 1 and got[2]["end_byte"] == len(rest)


def test_adjacent_copies_of_a_license_are_each_found(frame, prose):
    t = license_scan.TEMPLATES
    line, mit = t["MIT-notice"] + ".\n", t["MIT"]
    gapped = " ".join(w + (" extra" if i % 6 == 5 else "") for i, w in enumerate(mit.split()))
    rows = [(1, line * 2), (2, line * 1000), (3, (line + "and more. ") * 30), (4, mit + "\n" + gapped + "\n" + mit), (5, prose(1, 9) + " " + line + t["MIT-notice-2"] + " " + line)]
    got = license_scan.scan(frame(rows)).collect()
    spans = {}
    for r in got:
        spans.setdefault((r["doc_id"], r["license"]), []).append((r["start_byte"], r["end_byte"]))
    assert {k: len(v) for k, v in spans.items()} == {(1, "MIT-notice"): 2, (2, "MIT-notice"): 1000, (3, "MIT-notice"): 30, (4, "MIT"): 3, (5, "MIT-notice"): 2, (5, "MIT-notice-2"): 1}
    n = len(line)
    assert sorted(spans[2, "MIT-notice"]) == [(i * n, i * n + n - 2) for i in range(1000)]
    for v in spans.values():
        assert all(a[1] <= b[0] for a, b in zip(sorted(v), sorted(v)[1:]))


def test_alignment_equals_full_table():
    r = random.Random(5)
    for _ in range(60):
        a = np.array([r.randrange(6) for _ in range(r.randint(1, 25))])
        b = np.array([r.randrange(6) for _ in range(r.randint(1, 12))])
        best = np.zeros((len(b) + 1, len(a) + 1))
        for i in range(len(b)):
            for j in range(len(a)):
                best[i + 1, j + 1] = max(0, best[i, j] + 1 if a[j] == b[i] else 0, best[i, j + 1] - license_scan.GAP, best[i + 1, j] - license_scan.GAP)
        m, first, last = license_scan.align(a, b, -len(b), len(a))
        assert (m > 0) == (best.max() > 0)
        if m:
            gaps = (m - best.max()) / license_scan.GAP
            assert gaps >= 0 and gaps == int(gaps) and a[first] in b and a[last] in b


def test_winnowing_guarantee():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 60, 300).astype(np.uint64)
    at, _ = license_scan.winnow(words, np.zeros(300, np.int64), 3, 4)
    assert np.diff(at).max() <= 4


# --- languages ---


@pytest.fixture(scope="module")
def tongues():
    parts = {"en": "the ing tion er of and wh sh ea th".split(), "de": "sch ung keit der ein ch ver zu ge tz".split(), "fr": "eau tion le que eux oi é è ment aux".split(), "es": "ción ado ez que llo rr ñ os as mente".split()}

    def make(lang, seed, n=40):
        r = random.Random(f"{lang}{seed}")
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make


def test_language_id_on_held_out_texts(spark, tongues):
    rows = [(i, tongues(x, i), x) for i, x in enumerate(["en", "de", "fr", "es"] * 60)]
    held = [(1000 + i, tongues(x, 1000 + i), None, x) for i, x in enumerate(["en", "de", "fr", "es"] * 50)]
    docs = spark.createDataFrame(rows + [h[:3] for h in held], "doc_id long, text string, lang string").withColumn("family", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(docs, train_per_language=40).collect()}
    right = [got[i]["language"] == x for i, _, _, x in held]
    assert sum(right) / len(right) > 0.98
    assert all(got[i]["family"] == langid.FAMILIES[x] for i, _, _, x in held if got[i]["language"] == x)
    assert not any(got[i]["rejected"] for i, *_ in held)


def test_language_id_rejects_and_keeps_columns(spark, tongues):
    r = random.Random(0)
    rows = [(i, tongues(x, i), x) for i, x in enumerate(["en", "de", "fr", "es"] * 40)]
    noise = "".join(chr(r.choice([*range(33, 65), *range(91, 97), *range(123, 127)])) for _ in range(400))
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 ...", None), (903, noise, None), (904, tongues("fr", 7, 800), None), (904, tongues("fr", 7, 800), None), (None, tongues("de", 8), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("found", F.lit(1)).withColumn("__family", F.lit(2))
    out = langid.identify(docs, keep_columns=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "found_"] and out.count() == len(rows) + len(odd)
    assert all(got[i]["found_"]["rejected"] and got[i]["found_"]["language"] is None for i in (900, 901, 902, 903))
    assert got[904]["found_"]["language"] == "fr" and got[None]["found_"]["language"] == "de" and got[0]["found"] == 1


def test_language_id_scores_equal_brute_force(spark, tongues):
    """Family, duels and rejection of each text, recomputed gram by gram from the machines."""
    rows = [(i, tongues(x, i, 12 + i % 30), x) for i, x in enumerate(["en", "de", "fr", "es"] * 30)] + [(500, tongues("es", 9, 30_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, "doc_id", "text", "lang", langid.FAMILIES, 20)

    def score(text, column):
        raw, total, n = text.lower().encode(), 0.0, 0
        for i in range(len(raw)):
            h = 0
            for k in range(min(4, len(raw) - i)):
                h = ((h * 0x01000193) & 0xFFFFFFFF) ^ (raw[i + k] + 1)
                x = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                total, n = total + float(m.weights[x >> (32 - langid.DIM_BITS), column]), n + 1
        return total / n + m.bias[column]

    for r in langid.identify(docs, train_per_language=20).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        if len(text) > 9_000 and r["doc_id"] != 500:
            continue
        families = [score(text, j) for j in range(len(m.families))]
        best = int(np.argmax(families))
        assert abs(families[best] - r["margin"]) < 1e-4 and r["rejected"] == (families[best] < -0.8)
        if not r["rejected"]:
            wins = dict.fromkeys(m.members[best], 0)
            for d, (f, a, b) in enumerate(m.duels):
                if f == best:
                    wins[a if score(text, len(m.families) + d) > 0 else b] += 1
            assert r["family"] == m.families[best] and wins[r["language"]] == max(wins.values())


def test_language_id_without_labels(frame):
    docs = frame([(1, "some words")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["rejected"] for r in langid.identify(docs).collect()] == [True]
    assert langid.identify(frame([])).count() == 0


# --- quality rules ---


def test_quality_rules_equal_sql(spark, frame, prose):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "WORD!! " * 50), (5, "the " * 200), (6, prose(1, 60) + " of the"), (7, "\n".join(["- same"] * 9)), (8, "a... \nb...\nc"), (9, "12345 678"), (10, "#$% " * 40), (11, "été où l'as\tx y"), (None, "the cat"), (6, prose(1, 60) + " of the"), (12, "the " + prose(2, 50_000))]
    docs = frame(rows, "keep")
    got = quality_rules.apply_rules(docs)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    want = con.sql(quality_rules.oracle())
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
    by = {r["doc_id"]: r for r in got.collect()}
    assert {i for i, r in by.items() if r["keep"]} >= {6, 11} and not any(by[i]["keep"] for i in (1, 2, 3, 4, 5, 7, 9, 10))
    assert by[1]["broken_rules"] == "n_words"
    assert quality_rules.apply_rules(frame([])).count() == 0


def test_rules_hold_at_every_size(frame):
    """The same kind of text is judged alike, short or long."""
    kinds = [f"word{i}" for i in range(60)]
    poor = lambda n: "the " + " ".join(kinds[i % 60] for i in range(n))
    rows = [(1, poor(3_000)), (2, poor(1_000_000)), (3, " ".join("xyzzy" for _ in range(29))), (4, " ".join("xyzzy" for _ in range(30))), (5, "same\nsame\nsame"), (6, "same\nsame\nsame\nsame"), (7, "one two")]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(rows)).collect()}
    assert all("word_variety" in got[i]["broken_rules"] for i in (1, 2, 3, 4)) and got[7]["keep"]
    assert all("repeated_line_ratio" in got[i]["broken_rules"] for i in (5, 6))
    assert all(0 <= r["word_variety"] <= 1 for r in got.values())


def test_rules_are_one_projection(frame):
    plan = quality_rules.apply_rules(frame([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- neighbours ---


def exact(x, ids, k):
    d = ((x[:, None, :].astype(np.float64) - x[None]) ** 2).sum(2)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[a] = [b for _, b in order]
    return out


def test_neighbours_are_exact(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(150, 8)), r.normal(size=(50, 8)) * 0.01 + 3]).astype(np.float32)
    x[20] = x[21] = x[22]  # ties
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    for block, span in ((64, 2), (1000, 16)):
        got = {}
        for q in block_knn.neighbours(df, k=5, query_rows=block, block_rows=block, span_blocks=span).orderBy("vec_id", "rank").collect():
            got.setdefault(q["vec_id"], []).append(q["neighbour_id"])
        assert got == exact(x, list(range(200)), 5)


def test_a_query_set_asks_all_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 7 == 0 or None) for i in range(150)], "vec_id long, embedding array<float>, q boolean")
    want = {i: v for i, v in exact(x, list(range(150)), 4).items() if i % 7 == 0}
    for rows, block, span in ((5, 32, 2), (1000, 1000, 1)):
        got = {}
        for q in block_knn.neighbours(df, k=4, queries=F.col("q"), query_rows=rows, block_rows=block, span_blocks=span).orderBy("vec_id", "rank").collect():
            got.setdefault(q["vec_id"], []).append(q["neighbour_id"])
        assert got == want
    assert block_knn.neighbours(df, queries=F.lit(False)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = (r.normal(size=(40, 16)).astype(np.float32) for _ in range(2))
    qa, qb = block_knn.quantise(a), block_knn.quantise(b)
    dot = (qa[0].astype(float) * qa[1][:, None]) @ (qb[0].astype(float) * qb[1][:, None]).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    slack = na[:, None] * qb[2] + nb * qa[2][:, None] + qa[2][:, None] * qb[2]
    assert (np.abs(a.astype(float) @ b.astype(float).T - dot) <= slack).all()


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, None), (None, [0.0, 1.0]), (6, []), (7, [0.0, 2.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r[0], r[1], r[2]) for r in block_knn.neighbours(df, k=3).collect())
    assert got == [(1, 1, 2), (1, 2, 7), (2, 1, 1), (2, 2, 7), (7, 1, 1), (7, 2, 2)]
    assert block_knn.neighbours(df.limit(0)).count() == 0
