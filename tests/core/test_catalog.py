"""Concurrent writers, queued content, kept files and what outlives a restart."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.plans import models
from quillspark.plans.catalog import Catalog, Changed
from quillspark.plans.engine import Engine
from quillspark.session import Settings


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "db"))


def hashes(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "hash string, doc_id string")


def test_interleaved_writers_lose_nothing(spark, catalog):
    catalog.append("content_hashes", hashes(spark, "a"))
    other = Catalog(spark, catalog.root)
    real, first = catalog._state, []

    def slow(table):  # another writer commits between this one's reading and its commit
        state = real(table)
        if not first:
            first.append(1)
            other.append("content_hashes", hashes(spark, "b"))
        return state

    catalog._state = slow
    catalog.append("content_hashes", hashes(spark, "c"))
    assert {r["hash"] for r in other.read("content_hashes").collect()} == {"a", "b", "c"}
    with pytest.raises(Changed):
        catalog._commit("content_hashes", 1, [])
    first.clear()
    catalog.upsert("content_hashes", spark.createDataFrame([("a", "new")], "hash string, doc_id string"), ["hash"])
    assert {tuple(r) for r in other.read("content_hashes").distinct().collect()} == {("a", "new"), ("b", "b"), ("c", "c")}


def test_threads_append(spark, catalog):
    threads = [threading.Thread(target=lambda i=i: Catalog(spark, catalog.root).append("content_hashes", hashes(spark, f"h{i}"))) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r["hash"] for r in catalog.read("content_hashes").collect()} == {f"h{i}" for i in range(6)}


def test_changes_rewrite_only_what_they_touch(spark, catalog):
    for n in "abc":
        catalog.append("content_hashes", hashes(spark, n))
    before = catalog._state("content_hashes")[1]
    catalog.delete("content_hashes", F.col("hash") == "b")
    after = catalog._state("content_hashes")[1]
    assert len(set(before) & set(after)) == 2 and {r["hash"] for r in catalog.read("content_hashes").collect()} == {"a", "c"}
    number = catalog._state("content_hashes")[0]
    catalog.delete_matching("content_hashes", spark.createDataFrame([("nobody",)], "doc_id string"))
    assert catalog._state("content_hashes")[0] == number
    catalog.compact("content_hashes")
    assert len(catalog._state("content_hashes")[1]) == 1 and catalog.read("content_hashes").count() == 2
    catalog.keep = 1
    catalog.append("content_hashes", hashes(spark, "d"))
    assert catalog.vacuum("content_hashes", older_than=-1) >= 3 and catalog.read("content_hashes").count() == 3


def test_queued_content_is_processed(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings())
    d = e.add_content("# One\nqueued words", "note.md", wait=False, metadata={"session_id": "s1"}, source="web:a")
    assert e.get_status(d) == {"doc_id": d, "status": "pending", "has_chunks": False}
    assert bytes(e.files.get(d)) == b"# One\nqueued words" and e.files.exists(d) and e.files.size(d) == 18 and e.files.get("none") is None
    again = Engine(spark, str(tmp_path / "db"), Settings())  # another session takes over
    assert again.process_pending() == 1 and again.get_status(d) == {"doc_id": d, "status": "completed", "has_chunks": True}
    row = again.catalog.read("chunks").first()
    assert row["source"] == "web:a" and row["session_id"] == "s1" and "queued words" in row["content"]
    assert {h["doc_id"] for h in again.search("queued", hybrid=True).collect()} == {d}


def test_what_cannot_be_read_fails(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings())
    good, gone = e.add_content("words", "a.md", wait=False), e.add_content("others", "b.md", wait=False)
    e.catalog.delete("raw_files", F.col("doc_id") == gone)
    assert e.process_pending() == 1
    assert e.get_status(good)["status"] == "completed" and e.get_status(gone)["status"] == "failed"
    assert [r["doc_id"] for r in e.catalog.read("failures").collect()] == [gone]
    bad = e.add_content(b"not a zip", "c.docx")  # a file that no reader can open has neither stub nor hash
    assert e.get_doc_meta(bad) is None and e.catalog.read("failures").count() == 2


def test_worker_and_shutdown(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings(max_concurrent_tasks=2))
    docs = [e.add_content(f"text {i}", f"{i}.md", wait=False) for i in range(3)]
    e.worker.poll = 0.05
    e.worker.start()
    assert e.worker.wait_empty(120) and all(e.get_status(d)["status"] == "completed" for d in docs)
    stopped = []
    e.close_with(type("Watcher", (), {"stop": lambda self: stopped.append(1)})())
    last = e.add_content("late", "late.md", wait=False)
    assert e.shutdown(timeout=120) and stopped == [1] and not e.worker.running and e.get_status(last)["status"] == "completed"


def test_lost_tasks_wait_again(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings())
    d = e.add_content("x", "x.md", wait=False)
    assert [x for x, _ in e._claim(5)] == [d] and e._claim(5) == [] and e.process_pending() == 0
    assert e.requeue_lost() == 1 and e.process_pending() == 1


def test_access_queues_outlive_a_restart(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings(access_recent_size=2))
    told = []
    e.on_promote.append(told.append)
    for k in ("/a", "/b", "/c", "/c"):
        e.track_access(k)
    again = Engine(spark, str(tmp_path / "db"), Settings(access_recent_size=1))
    assert told == ["/c"] and again.access.get_hot() == ["/c"] and again.access.get_recent() == ["/b"]
    again.access.load({"recent": "broken"})
    assert again.access.stats()["recent_count"] == 0


def test_hot_sections_are_told_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Settings(section_heat_threshold=3.0, section_heat_half_life=100.0))
    told = []
    e.on_hot_section.append(lambda d, s: told.append((d, s)))
    rows = spark.createDataFrame([("d", "S")], "doc_id string, section string")
    for t in (0.0, 1.0, 2.0, 3.0, 4.0):
        e.record_access(rows, 1.0, now=t)
    assert told == [("d", "S")]


def test_model_instructions(spark, tmp_path):
    def write(stub):
        if "bad" in stub["filename"]:
            raise ValueError
        return f"About {stub['filename']}", "Read it twice."

    e = Engine(spark, str(tmp_path / "db"), Settings(), instructor=write)
    a, b, c = e.add_content("one", "a.md", use_llm_instructions=True), e.add_content("two", "bad.md", use_llm_instructions=True), e.add_content("three", "c.md")
    assert e.get_doc_meta(a)["instructions"] == "Read it twice." and e.get_doc_meta(a)["brief_intro"] == "About a.md"
    assert "Read it twice." not in (e.get_doc_meta(b)["instructions"], e.get_doc_meta(c)["instructions"])


@pytest.fixture(scope="module")
def service():
    """A local service that embeds and reranks, and fails each first call of a kind."""
    seen = {"calls": 0, "at_once": 0, "most": 0, "keys": set()}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen["calls"] += 1
                seen["at_once"] += 1
                seen["most"] = max(seen["most"], seen["at_once"])
                seen["keys"].add(self.headers.get("Authorization"))
                fail = seen["calls"] == 1
            threading.Event().wait(0.05)
            if fail:
                status, out = 503, {}
            elif "input" in body:
                status, out = 200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                status, out = 200, {"results": [{"index": i, "relevance_score": 1.0} for i, t in enumerate(body["documents"]) if body["query"] in t]}
            with lock:
                seen["at_once"] -= 1
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x", seen
    s.shutdown()


def test_http_providers(spark, service, monkeypatch):
    url, seen = service
    monkeypatch.setattr(models, "FIRST_WAIT", 0.01)
    e = models.make(models.EMBEDDERS, "http", url=url, model="m", pause=0.0)
    texts = ["x" * (i % 50 + 1) for i in range(950)]
    got = models.in_batches(e.function, texts, 0.0)
    assert got == [[float(len(t)), 1.0] for t in texts] and 1 < seen["most"] <= models.IN_FLIGHT
    rows = spark.createDataFrame([(t,) for t in texts[:30]], "t string").select("t", e.column(F.col("t")).alias("v")).collect()
    assert all(r["v"][0] == len(r["t"]) for r in rows) and e.one("abc") == [3.0, 1.0]
    r = models.make(models.RERANKERS, "http", url=url, model="m")
    scored = spark.createDataFrame([("has word",), ("none",)], "t string").select(r.column("word", F.col("t")).alias("s")).collect()
    assert sorted(x["s"] for x in scored) == [0.0, 1.0]
    with pytest.raises(ValueError):
        models.make(models.RERANKERS, "http", url="", model="m")
    with pytest.raises(ValueError):
        models.make(models.RERANKERS, "cross_encoder", model="m")
    with pytest.raises(models.HttpError):
        models.with_retries(lambda: (_ for _ in ()).throw(models.HttpError(429, "")), models._transient, retries=1, sleep=lambda s: None)
