import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import api, server
from quillspark.plans import models
from quillspark.plans.engine import Engine
from quillspark.plans.skill import export_skill
from quillspark.session import Settings
from quillspark.sources import base
from quillspark.streaming import watch

BIG = "opening words\n# Top\n" + "alpha " * 1500 + "\n## Sub One\n" + "beta " * 1500 + "\n```\n# no heading\n```\n## Sub Two\nshort\n# Next\nend\n"


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"), Settings(section_heat_threshold=2.0))


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_ingest_search_read(engine, tmp_path):
    a, b = put(tmp_path, "a.md", BIG), put(tmp_path, "b.csv", "x,y\n1,2\n")
    da, db = engine.add_batch([a, b], source="web:x", metadata={"session_id": "s1"}, collection="col")
    assert engine.add(a) == da  # known content
    hits = engine.search("anything", top_k=3).collect()
    assert len(hits) == 3 and [h["score"] for h in hits] == sorted(h["score"] for h in hits)
    assert {h["doc_id"] for h in engine.search("x", source="web:*", collections=["col"], doc_ids=[db]).collect()} == {db}
    assert engine.search("x", collections=["none"]).count() == 0
    assert {h["doc_id"] for h in engine.search("beta", hybrid=True, toc_only=True).collect()} == {da, db}
    assert {h["doc_id"] for h in engine.search_grouped("x", filters={"file_type": "csv"}).collect()} == {db}
    seg = engine.read_segment(da, "top")
    assert [c["section"] for c in seg["chunks"]] == ["Top", "Sub One", "Sub Two"] and seg["expanded"]
    assert "note" in engine.read_segment(da, "no such section") and "error" in engine.read_segment("nope", "x")
    assert [s["section"] for s in engine.inspect(da, sections=["Sub Two"])["sections"]] == ["Sub Two"]
    assert engine.inspect(da, full=True)["probe"]["file_type"] == "markdown" and engine.inspect("nope") is None
    assert [c["section"] for c in engine.read_structured(a, sections=["NEXT"])["chunks"]] == ["Next"]
    heat = {r["section"]: r["heat"] for r in engine.get_section_heat(da).collect()}
    assert heat["Sub Two"] > 4
    s = engine.stats()
    assert s["docs_indexed"] == 2 and s["chunks_stored"] == 6 and s["storage_bytes"] > 10_000


def test_path_replace_and_delete(engine, tmp_path):
    p = put(tmp_path, "a.md", "# One\ntext")
    old = engine.add(p, metadata={"session_id": "s"})
    put(tmp_path, "a.md", "# Two\nother")
    new = engine.add(p)
    assert new != old and engine.get_doc_meta(old) is None and engine.list_docs().count() == 1
    assert engine.delete(new) and not engine.delete(new) and engine.catalog.read("chunks").count() == 0
    x = engine.add_content("words", "note.txt", metadata={"session_id": "s9"})
    assert engine.catalog.delete_session("s9") == [x] and engine.list_docs().count() == 0


def test_queue_and_recovery(engine, tmp_path):
    p = put(tmp_path, "a.md", "# One\ntext")
    d = engine.add(p, wait=False)
    assert engine.get_status(d) == {"doc_id": d, "status": "pending", "has_chunks": False}
    assert engine.wait_for(d, poll=0.01) and engine.get_status(d)["has_chunks"]
    assert engine.get_status("nope")["status"] == "not_found" and engine.wait_for("nope", poll=0.01)
    engine.catalog.delete_matching("chunks", engine.catalog.read("stubs"))
    assert engine.recover_orphans() == 1 and engine.process_pending() == 1 and engine.get_status(d)["has_chunks"]


def test_collections(engine):
    c = engine.catalog
    c.put_collection("w", {"ttl": 10, "x": 1}, auto_add_sources=["web:*"], now=0.0)
    c.put_collection("w", watch_paths=["/tmp"])
    got = c.get_collection("w")
    assert got["metadata"] == {"ttl": 10, "x": 1} and got["watch_paths"] == ["/tmp"] and got["auto_add_sources"] == ["web:*"]
    c.merge_metadata("w", {"y": 2})
    assert c.get_collection("w")["metadata"] == {"ttl": 10, "x": 1, "y": 2}
    d = engine.add_content("hello", "h.md", source="web:1")
    assert c.collections_of(d) == ["w"] and engine.collection("w").doc_ids == [d]
    c.add_to_collection("w", [d, d])
    assert engine.collection("w").list_docs().count() == 1
    engine.collection("w").remove(d)
    assert engine.collection("w").doc_ids == []
    assert c.collect_garbage(now=5.0) == [] and c.collect_garbage(now=20.0) == ["w"] and c.list_collections() == []


def test_rerank_and_hooks(spark, tmp_path):
    seen = []

    class Hooks(models.Adaptor):
        def transform_query(self, query):
            return query + "!"

        def on_document_indexed(self, doc_id, metadata):
            seen.append((doc_id, metadata["source"]))

        def on_search_results(self, query, results):
            return results.withColumn("extra", F.lit(1))

    e = Engine(spark, str(tmp_path / "db"), Settings(rerank_enabled=True, rerank_weight=1.0), embedder=models.BatchEmbedder(lambda ts: [[float(len(t)), 1.0] for t in ts], pause=0))
    e.reranker = models.PairReranker(lambda q, ts: [1.0 if "wanted" in t else 0.0 for t in ts])
    e.register_adaptor(Hooks())
    ids = [e.add_content(f"text {i} " + ("wanted" if i == 3 else "other"), f"{i}.md", source="s") for i in range(5)]
    hit = e.search("q", top_k=1).first()
    assert hit["doc_id"] == ids[3] and hit["extra"] == 1 and seen == [(i, "s") for i in ids]
    with pytest.raises(ValueError):
        models.make(models.EMBEDDERS, "no such")


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert models.with_retries(flaky, models._transient, sleep=waits.append) == "ok" and len(waits) == 2 and waits[0] <= 1.5
    with pytest.raises(ValueError):
        models.with_retries(lambda: (_ for _ in ()).throw(ValueError()), models._transient, sleep=waits.append)


def test_promotion_on_second_access(engine, tmp_path):
    p = put(tmp_path, "a.md", "# One\ntext")
    assert not engine.track_access(p)["promoted"]
    assert engine.track_access(p)["promoted"] and engine.list_docs().count() == 1


def test_http_and_skill(spark, tmp_path):
    api.configure(Settings(db_path=str(tmp_path / "db")), spark=spark)
    h = server.handle
    assert h("GET", "/health") == (200, {"status": "ok"})
    status, out = h("POST", "/index-content", {"content": "# A\nhello", "filename": "a.md", "source": "x"})
    d = out["doc_id"]
    assert h("GET", f"/status/{d}")[1]["status"] == "pending" and api.start_processor() == 1
    assert status == 200 and h("GET", f"/status/{d}")[1]["status"] == "completed"
    assert h("POST", "/search", {"query": "hello"})[1]["results"][0]["doc_id"] == d
    assert h("POST", "/search-grouped", {"query": "hello"})[1]["results"][0]["doc_id"] == d
    assert h("GET", f"/doc-meta/{d}")[1]["filename"] == "a.md" and h("GET", "/doc-meta/none")[0] == 404
    assert h("POST", "/search", {})[0] == 422 and h("GET", "/nowhere")[0] == 404 and h("POST", "/index", {"path": "/x.unknown"})[0] == 400
    assert h("POST", "/collections/c", {"metadata": {"k": 1}})[1]["name"] == "c"
    assert h("POST", "/collections/c/docs", {"doc_id": d})[1]["doc_ids"] == [d]
    assert h("POST", "/collections/c/search", {"query": "q", "toc_only": True})[1]["results"][0]["doc_id"] == d
    assert h("GET", "/stats")[1]["docs_indexed"] == 1 and len(h("GET", "/docs?source=x")[1]["docs"]) == 1
    assert h("POST", "/probe", {"content": "a,b\n1,2\n", "filename": "t.csv"})[1]["file_type"] == "csv"
    assert h("DELETE", f"/docs/{d}")[0] == 200 and h("DELETE", f"/docs/{d}")[0] == 404 and h("DELETE", "/collections/c")[0] == 200
    names = {t["function"]["name"] for t in export_skill()["tools"]}
    assert sorted(names) == sorted("memory_status index_memory read_segment get_doc_meta search_memory".split())
    api.shutdown()


def test_watch_folder(engine, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "sub" / "a.md").write_text("# A\nx")
    (d / "b.lock").write_text("x")
    (d / "skip.md").write_text("# S\ny")
    for _ in range(2):
        watch.watch(engine, str(d), str(tmp_path / "ck"), ["*.lock", "skip.md"]).awaitTermination()
    assert [r["filename"] for r in engine.list_docs().collect()] == ["a.md"]
    (d / "c.md").write_text("# C\nz")
    watch.watch(engine, str(d), str(tmp_path / "ck"), ["skip.md"]).awaitTermination()
    assert engine.list_docs().count() == 2


def test_watch_appends(engine, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    f = d / "s1.jsonl"
    f.write_text('{"m": "one"}\n{"m": "two"}\n{"part')
    run = lambda: watch.watch_appends(engine, str(d), str(tmp_path / "ck"), probe_config={"text_field": "m"}).awaitTermination()
    run()
    run()
    assert engine.list_docs().count() == 1
    with f.open("a") as h:
        h.write('ial": 1, "m": "three"}\n')
    run()
    rows = sorted((json.loads(r["metadata_json"])["offset"], r["filename"]) for r in engine.list_docs().collect())
    assert rows == [(0, "s1.jsonl@0.jsonl"), (26, "s1.jsonl@26.jsonl")]
    assert sorted(r["content"] for r in engine.catalog.read("chunks").select("content").collect()) == ["one", "three", "two"]
    assert len(watch.file_removed(engine, str(f))) == 2 and engine.list_docs().count() == 0


# --- readers ---


def test_dispatch():
    assert [base.format_of(p) for p in ("a.PDF", "b.tar.gz", "c.ndjson", "d.tsx", "e.markdown", "f.txt")] == ["pdf", "archive", "jsonl", "code", "markdown", None]
    with pytest.raises(ValueError):
        base.parse("x.txt", b"")
    base.register_reader("rows", ["rows"], lambda p, raw: base.probe("rows", chunks=[base.chunk(raw.decode(), 0)]))
    assert base.parse("x.rows", b"hi")["chunks"][0]["content"] == "hi"
    base.CUSTOM.clear()


def test_bad_files_do_not_fail_the_job(spark):
    df = spark.createDataFrame([("a.json", bytearray(b"{bad")), ("b.md", bytearray("# é".encode("latin-1"))), ("c.zip", bytearray(b"no zip"))], "path string, content binary")
    got = {r["path"]: r for r in base.probe_files(df).collect()}
    assert got["a.json"]["error"] and got["c.zip"]["error"] and got["b.md"]["structure"]["toc"][0]["title"] == "é"


def test_markdown_and_csv():
    p = base.parse("a.md", BIG.encode())
    assert [(e["level"], e["title"]) for e in p["structure"]["toc"]] == [(1, "Top"), (2, "Sub One"), (2, "Sub Two"), (1, "Next")]
    assert [c["section"] for c in p["chunks"]] == ["preamble", "Top", "Sub One", "Sub Two", "Next"]
    rows = "a,b\n" + "".join(f"{i},{'' if i % 4 == 0 else 'v'}\n" for i in range(100)) + "9999,v\n"
    s = json.loads(base.parse("a.csv", rows.encode())["stats"])
    assert s["row_count"] == 101 and s["columns"]["a"]["n_outliers"] == 1 and s["columns"]["b"]["null_count"] == 25 and not s["is_full_content"]


def test_jsonl_groups():
    lines = [{"type": "session"}, *({"type": "message", "timestamp": f"t{i}", "message": {"role": r, "content": [dict(thinking="no", type="thinking"), dict(text=f"say {i}", type="text")]}} for i, r in enumerate(["user", "assistant", "user", "system"]))]
    raw = "\n".join(map(json.dumps, lines)) + "\nbad\n[1]\n"
    roles = dict(value=["user", "assistant"], op="in", field="message.role")
    c = dict(group_size=2, label_field="message.role", text_field="message.content.text", filters=[dict(value="message", field="type"), roles])
    p = base.parse("s.jsonl", raw.encode(), c)
    assert [x["content"] for x in p["chunks"]] == ["user: say 0\nassistant: say 1", "user: say 2"]
    assert p["chunks"][0]["metadata"]["timestamp"] == "t0" and json.loads(p["stats"])["parse_errors"] == 2


def test_archives():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for i in range(120):
            f.writestr(f"d{i % 40}/e/f/g/x{i}.py", "x" * i)
    s = json.loads((p := base.parse("a.zip", z.getvalue()))["stats"])
    assert s["file_count"] == 120 and s["extensions"] == {"py": 120} and len(p["structure"]["toc"]) == 30 and "and 20 more files" in p["chunks"][0]["content"]
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("a/b.txt")
        i.size = 3
        f.addfile(i, io.BytesIO(b"abc"))
    assert json.loads(base.parse("a.tar.gz", t.getvalue())["stats"])["total_size"] == 3


def _office(parts):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for n, x in parts.items():
            f.writestr(n, x)
    return z.getvalue()


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document {w}><w:body>{p("before")}{p("Title", "Heading1")}{p("one")}{p("item", "ListBullet")}{p("Below", "Heading2")}{p("two")}</w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>'
    got = base.parse("a.docx", _office({"word/document.xml": doc, "word/styles.xml": styles}))
    assert [(e["level"], e["title"], e["annotation"]) for e in got["structure"]["toc"]] == [(1, "Preamble", "1 paragraphs"), (1, "Title", "List, 1 items | 1 paragraphs"), (2, "Below", "1 paragraphs")]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda k, *ts: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{k}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts)}</p:txBody></p:sp>'
    rel = '<Relationships xmlns="x"><Relationship Type="z/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    got = base.parse("a.pptx", _office({"ppt/slides/slide1.xml": f"<p:sld {a}>{shape('title', 'Hello')}{shape('body', 'b1', 'b2', 'b3', 'b4')}</p:sld>", "ppt/slides/_rels/slide1.xml.rels": rel, "ppt/notesSlides/notesSlide1.xml": f"<p:notes {a}>{shape('body', 'say this')}</p:notes>"}))
    assert [e["title"] for e in got["structure"]["toc"]] == ["Hello", "b1", "b2", "b3"] and "Notes: say this" in got["chunks"][0]["content"] and got["structure"]["toc"][0]["preview"] == "say this"


def test_images_code_configs_calendar():
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 2, 0, 0, 0)
    assert json.loads(base.parse("a.png", png)["stats"]) == {"format": "PNG", "width": 30, "height": 20, "mode": "RGB", "exif": {}}
    py = base.parse("a.py", '"""É doc."""\nimport os\n\n@dec\nclass A(B):\n    def f(self): ...\n\ndef g(x: int) -> str:\n    """Say."""\n'.encode())
    assert py["structure"]["definitions"] == ["class A(B)", "g(x: int) -> str"] and json.loads(py["stats"])["imports"] == ["import os"]
    assert json.loads(base.parse("a.ini", b"[DEFAULT]\na=1\n[s]\nb=2\n")["stats"])["key_count"] == 4
    ics = b"BEGIN:VEVENT\nSUMMARY:B\nDTSTART:2\nATTENDEE:mailto:x@y\nATTENDEE:mailto:x@y\nRRULE:D\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:A\nDTSTART:1\nEND:VEVENT\n"
    c = base.parse("a.ics", ics)
    assert [e["title"] for e in c["structure"]["toc"]] == ["A", "B"] and json.loads(c["stats"])["attendees"] == ["x@y"]


def test_log_levels_of_one_file():
    log = "2024-01-01 00:00:00 WARNING disk full\n2024-01-01 00:00:01 critical stop\n" * 3
    s = json.loads(base.parse("a.log", log.encode())["stats"])
    assert s["levels"] == {"WARN": 3, "CRITICAL": 3} and s["error_count"] == 0 and s["format"] == "iso"
