import random

import pytest

import corpus_pipeline
from quillspark.llm import chunk_dedup

PARTS = {"en": "the ing tion er of and wh sh ea th".split(), "de": "sch ung keit der ein ch ver zu ge tz".split(), "fr": "eau tion le que eux oi é è ment aux".split(), "es": "ción ado ez que llo rr ñ os as mente".split()}


def words(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, passage = [], words("en", "passage", 70)
    for i in range(160):
        lang = ("en", "en", "de", "fr", "es")[i % 5]
        rows.append((i, words(lang, i, 60) + (" " + passage if i % 20 == 0 else ""), lang, f"src{i % 8}"))
    rows += [(200 + i, rows[i][1] + " added", "en", "src0") for i in (1, 2, 3)] + [(300, rows[5][1], "en", "src1")]
    rows += [(400, None, "en", "src0"), (401, "", "en", "src0"), (402, "!!! 123 ???", "en", "src0")]
    d = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_every_stage_on_its_own_input(spark, corpus, tmp_path):
    d, rows = corpus
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append((name, docs))
    language, near, passages, mixed, packed = (x for _, x in seen)
    ids = lambda x: sorted(r[0] for r in x.select("doc_id").collect())
    assert ids(language) == sorted(i for i, t, *_ in rows if i < 400)  # rejected ones go, clean ones stay
    assert ids(near) == list(range(160))  # copies go, least ids stay
    assert ids(passages) == list(range(160))
    clean = dict((r[0], r[1]) for r in rows)
    for r in passages.collect():
        if r["doc_id"] % 20 or r["doc_id"] == 0:
            assert r["text"] == clean[r["doc_id"]]
        else:
            assert len(r["text"]) < len(clean[r["doc_id"]]) - 128 and r["n_chars"] == len(r["text"])
    assert chunk_dedup.report(passages).count() == 0
    assert set(ids(mixed)) <= set(range(160)) and len(set(ids(mixed))) > 100
    assert ids(packed) == ids(mixed)


def test_run_equals_the_stages(spark, corpus):
    d, _ = corpus
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) for _ in range(2))
    assert a == b and len(a) > 100
