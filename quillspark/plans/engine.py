"""The engine: ingest, search, and two-step reading over the catalog's tables."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import brief_intro, file_name, suffix
from ..operators import chunking, dedup, filters, fts, heat, search, summaries, tasks, telemetry, toc
from ..operators.access import AccessQueues
from ..schemas import TOC_ENTRY
from ..session import Settings
from ..sources import base
from . import models
from .catalog import Catalog, route
from .file_store import FileStore, TableFileStore
from .worker import QueueWorker


def _shown(path: str) -> Column:
    """A file's name; for content without a file the name it was given."""
    return F.regexp_replace(file_name(path), "^__content__:", "")


class Engine:
    """One catalog with its settings and plug-ins. Results are DataFrames, or dicts where one document is asked for."""

    def __init__(self, spark: SparkSession, root: str | None = None, settings: Settings | None = None, embedder=None, reranker=None, summariser=None, instructor=None, file_store: FileStore | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.catalog = Catalog(spark, root or self.settings.db_path)
        self.files = file_store or TableFileStore(self.catalog)
        own = self.settings
        self.embedder = embedder or models.make(models.EMBEDDERS, own.embedding_provider, **models.told(own.embedding_provider, own.embedding_url, own.embedding_model))
        self.reranker = reranker or models.make(models.RERANKERS, own.rerank_provider, **models.told(own.rerank_provider, own.rerank_url, own.rerank_model))
        self.summariser, self.instructor, self.adaptors = summariser, instructor, []
        self.access = AccessQueues(self.settings.access_recent_size, self.settings.access_hot_size)
        self.access.load(self.catalog.get_json("access", {}))
        self.worker = QueueWorker(self, self.settings.max_concurrent_tasks)
        self.on_promote: list[Callable[[str], None]] = []
        self.on_hot_section: list[Callable[[str, str], None]] = []
        self._hot: set[tuple[str, str]] = set()
        self._closing: list[Any] = []

    def close_with(self, thing: Any) -> None:
        """``thing.stop()`` is called when the engine shuts down."""
        self._closing.append(thing)

    def shutdown(self, timeout: float = 30.0) -> bool:
        """Stops watchers, then the queue once nothing waits, and saves the access queues; whether all ended in time."""
        for thing in self._closing:
            thing.stop()
        self._closing.clear()
        ended = self.worker.stop(drain=True, timeout=timeout)
        self.catalog.put_json("access", self.access.dump())
        return ended

    # -- ingest ---

    def add(self, path: str, **how: Any) -> str:
        """Indexes one file and returns its document's id."""
        return self.add_batch([path], **how)[0]

    def add_batch(self, paths: Sequence[str], **how: Any) -> list[str]:
        """Indexes files in one job, in the order given."""
        full = [os.path.abspath(p) if "://" not in p else p for p in paths]
        missing = [p for p in full if base.format_of(p) is None]
        if missing:
            raise ValueError(f"no reader for {', '.join(missing)}")
        files = self.spark.read.format("binaryFile").load([p.replace("[", "\\[").replace("{", "\\{") for p in full])
        files = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content")
        found = self.index(files, **how)
        return [found[p] for p in full]

    def add_content(self, content: str | bytes, filename: str, content_type: str | None = None, **how: Any) -> str:
        """Indexes text without a file. A name whose format is unknown counts as Markdown."""
        raw = content.encode() if isinstance(content, str) else content
        name = filename if base.format_of(filename) else filename + ".md"
        row = self.spark.createDataFrame([(dedup.synthetic_path(name), bytearray(raw))], "path string, content binary")
        return self.index(row, **how)[dedup.synthetic_path(name)]

    def index(self, files: DataFrame, **how: Any) -> dict[str, str]:
        """``ingest``, with the ids of the caller's own paths as ``{path: doc_id}``."""
        return {r["path"]: r["doc_id"] for r in self.ingest(files, **how).toLocalIterator()}

    def ingest(self, files: DataFrame, *, source: str = "", collection: str | None = None, metadata: dict | None = None, wait: bool = True, force: bool = False, summarize: bool = False, probe_config: dict | None = None, now: float | None = None, use_llm_instructions: bool = False) -> DataFrame:
        """Indexes ``(path, content)`` rows, with their own ``metadata_json`` if they have that; gives ``(path, doc_id)``.

        Content that is known keeps its document, unless forced; a path with new
        content replaces its document. With ``wait=False`` documents get their
        stubs now, their bytes are kept and they are queued for ``process_pending``.
        """
        stamp, meta = time.time() if now is None else now, json.dumps(metadata or {})
        told = F.coalesce("metadata_json", F.lit(meta)) if "metadata_json" in files.columns else F.lit(meta)
        rows = files.select("path", "content", told.alias("metadata_json"), ids.content_hash("content").alias("hash"))
        rows = rows.withColumn("doc_id", ids.doc_id("hash", "path"))
        known = self.catalog.read("content_hashes")
        seen = rows.join(known.select("hash", F.col("doc_id").alias("known_id")), "hash").select("path", F.col("known_id").alias("doc_id"))
        fresh = rows if force else rows.join(known.select("hash"), "hash", "left_anti")
        lead = dedup.first_of_each(fresh, ["hash"], ["path"]).select("hash", F.col("doc_id").alias("lead"))
        fresh = fresh.join(lead, "hash").withColumn("mine", F.col("doc_id") == F.col("lead"))
        ident = fresh.select("path", "hash", F.col("lead").alias("doc_id"), "mine").persist()
        pairs = ident.select("path", "doc_id")
        # the table of hashes changes below: what is known now is kept
        pairs = (pairs if force else pairs.union(seen)).persist()
        pairs.count()
        if not ident.isEmpty():
            old = self.catalog.read("path_index").join(ident.select("path"), "path", "left_semi").select("doc_id")
            gone = old.union(ident.select("doc_id")).distinct().persist()
            if not self.catalog.read("stubs").join(gone, "doc_id", "left_semi").isEmpty():
                self.catalog.delete_documents(gone)
            gone.unpersist()
            clock = telemetry.Clock()
            own = fresh.where("mine")
            probed = base.probe_files(own.select("path", "content"), probe_config)
            probed = probed.join(own.select("path", "doc_id", "metadata_json"), "path").withColumn("source", F.lit(source)).persist()
            good = probed.where("error is null")
            clock.lap("probe")
            self.files.save(own.join(good.select("doc_id"), "doc_id", "left_semi"))
            self._write_stubs(good, use_llm_instructions)
            self.catalog.append("content_hashes", ident.where("mine").join(good.select("doc_id"), "doc_id", "left_semi").select("hash", "doc_id"))
            sizes = own.select("path", F.length("content").cast("long").alias("size"))
            self.catalog.append("files", good.join(sizes, "path").select("doc_id", "path", suffix("path").alias("suffix"), "size"))
            if wait:
                self._write_chunks(good, summarize, stamp)
                clock.lap("embedding")
            else:
                fresh_tasks = good.select("doc_id", F.lit(0).alias("priority"), F.lit(stamp).alias("submitted_at"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(summarize).alias("needs_summarization"))
                self.catalog.upsert("tasks", fresh_tasks, ["doc_id"])
            bad = probed.where("error is not null")
            if not bad.isEmpty():
                self.catalog.append("failures", bad.select("doc_id", F.lit(stamp).alias("ts"), "error", "source", F.col("path").alias("filename")))
            self.catalog.append("telemetry", telemetry.measures(good, sizes, clock.laps))
            if self.adaptors:  # hooks run here, one document after the other
                for r in good.select("doc_id", "metadata_json").distinct().toLocalIterator():
                    for a in self.adaptors:
                        a.on_document_indexed(r["doc_id"], {"source": source, **json.loads(r["metadata_json"])})
            probed.unpersist()
        ident.unpersist()
        if not pairs.isEmpty():
            self.catalog.upsert("path_index", dedup.first_of_each(pairs, ["path"], ["doc_id"]), ["path"])
            self._route(pairs, source, collection)
        return pairs

    def _route(self, docs: DataFrame, source: str, collection: str | None) -> None:
        names = {collection} if collection else set()
        if source:
            patterns = self.catalog.read("collections").select("name", F.explode("auto_add_sources").alias("pattern"))
            row = self.spark.createDataFrame([("", source)], "doc_id string, source string")
            names |= {r["name"] for r in route(row, patterns).collect()}
        for name in sorted(names):
            self.catalog.add_to_collection(name, docs)

    def _write_stubs(self, probed: DataFrame, use_llm: bool = False) -> None:
        intro, how = brief_intro("topic.title", "topic.abstract", "topic.first_paragraph", "brief_intro"), F.col("instructions")
        whole = F.to_json(F.struct("file_type", "topic", "structure", "stats", "raw_snippet"))
        rows = probed.select("doc_id", _shown("path").alias("filename"), intro.alias("brief_intro"), how.alias("instruction"), whole.alias("probe_json"), "source", "metadata_json")
        if use_llm and self.instructor is not None:
            rows = models.guided(rows, self.instructor)
        self.catalog.append("stubs", rows)

    def _write_chunks(self, probed: DataFrame, summarize: bool, stamp: float) -> None:
        """Cuts, embeds and indexes the chunks of probed files, which have their document's source and metadata."""
        more = ["source", "metadata_json"]
        c = probed.select("doc_id", _shown("path").alias("filename"), F.col("file_type"), *more, F.explode("chunks").alias("c"))
        c = c.select("doc_id", "filename", "file_type", *more, F.col("c.content").alias("content"), F.col("c.index").alias("chunk_index"), F.col("c.section").alias("section"))
        c = summaries.summarise(c, self.summariser if summarize else None)
        if not summarize:
            c = c.withColumn("summary", F.lit(""))
        p = chunking.embed_pieces(c)
        p = p.withColumn("chunk_id", chunking.piece_id("doc_id", "chunk_index")).withColumn("vector", self.embedder.column(F.col("embed_text")))
        made = {"session_id": F.get_json_object("metadata_json", "$.session_id"), "indexed_at": F.lit(stamp), "content": F.col("piece"), "content_tokenized": F.array_join(fts.terms("piece"), " ")}
        rows = p.withColumns(made).persist()
        self.catalog.append("chunks", rows)
        self.catalog.append("postings", fts.stored(rows))
        rows.unpersist()

    def _claim(self, limit: int) -> list[tuple[str, bool]]:
        """Takes waiting tasks, highest priority first; no two workers get the same."""
        got: list[tuple[str, bool]] = []

        def take(queue: DataFrame) -> DataFrame:
            got[:] = [(r["doc_id"], bool(r["needs_summarization"])) for r in tasks.next_tasks(queue, limit).select("doc_id", "needs_summarization").collect()]
            mine = self.spark.createDataFrame([(d,) for d, _ in got], "doc_id string").withColumn("__mine", F.lit(True))
            state = F.when(F.col("__mine"), F.lit("processing")).otherwise(F.col("status"))
            return queue.join(mine, "doc_id", "left").withColumn("status", state).drop("__mine")

        if not self.catalog.read("tasks").where("status = 'pending'").isEmpty():
            self.catalog.rewrite("tasks", take)
        return got

    def _finish(self, results: DataFrame) -> None:
        """Sets tasks to the ``(doc_id, done, why)`` given."""
        told = results.select("doc_id", F.col("done").alias("__done"), F.col("why").alias("__why"))
        self.catalog.rewrite("tasks", lambda q: q.join(told, "doc_id", "left").withColumn("status", F.coalesce("__done", "status")).withColumn("error", F.coalesce("__why", "error")).drop("__done", "__why"))

    def process_pending(self, limit: int | None = None, now: float | None = None) -> int:
        """Embeds queued documents, highest priority first, from the bytes kept; the number of those completed.

        A document whose bytes are gone, or whose file can't be read, fails and enters the failure ledger.
        """
        stamp, claimed = time.time() if now is None else now, self._claim(limit or 2**31 - 1)
        if not claimed:
            return 0
        todo = self.spark.createDataFrame(claimed, "doc_id string, flag boolean")
        try:
            stubs = self.catalog.read("stubs").select("doc_id", "source", "metadata_json")
            raw = self.files.load(todo)
            probed = base.probe_files(raw.select(F.concat_ws("\x1f", "doc_id", "path").alias("path"), "content"))
            at = F.split("path", "\x1f")
            probed = probed.withColumn("doc_id", at[0]).withColumn("path", at[1]).join(stubs, "doc_id").join(todo, "doc_id").persist()
            good = probed.where("error is null")
            # a task that runs again must not double its chunks
            self.catalog.delete_matching("chunks", good.select("doc_id"))
            self.catalog.delete_matching("postings", good.select("doc_id"))
            for flag in sorted({f for _, f in claimed}):
                self._write_chunks(good.where(F.col("flag") == flag), flag, stamp)
            told = probed.select("doc_id", "error", "source", F.col("path").alias("filename"))
            results = todo.join(told, "doc_id", "left").withColumn("why", F.when(F.col("filename").isNull(), F.lit("its bytes are not kept")).otherwise(F.col("error")))
            results = results.withColumn("done", F.when(F.col("why").isNull(), F.lit("completed")).otherwise(F.lit("failed"))).persist()
            lost = results.where("done = 'failed'")
            if not lost.isEmpty():
                self.catalog.append("failures", lost.select("doc_id", F.lit(stamp).alias("ts"), F.col("why").alias("error"), "source", "filename"))
            n = results.where("done = 'completed'").count()
            self._finish(results)
            probed.unpersist()
            return n
        except Exception:
            self._finish(todo.select("doc_id", F.lit("pending").alias("done"), F.lit(None).cast("string").alias("why")))
            raise

    def unfinished(self) -> int:
        return self.catalog.read("tasks").where(F.col("status").isin(*tasks.ACTIVE)).count()

    def requeue_lost(self) -> int:
        """Tasks that a worker took and never ended wait again; call it when no other worker runs."""
        n = self.catalog.read("tasks").where("status = 'processing'").count()
        if n:
            self.catalog.rewrite("tasks", lambda q: q.withColumn("status", F.when(F.col("status") == "processing", F.lit("pending")).otherwise(F.col("status"))))
        return n

    # -- search ---

    def _scored(self, query: str, top_k: int, conditions, *, hybrid: bool, source, collections, doc_ids, now: float | None) -> DataFrame:
        s = self.settings
        for a in self.adaptors:
            query = a.transform_query(query)
        chunks = self.catalog.read("chunks")
        scope = search.scope_ids(self.catalog.read("collection_docs"), collections, self.catalog.read("stubs"), source, doc_ids) if (collections is not None or source or doc_ids is not None) else None
        found = filters.apply_filters(search.in_scope(chunks, scope), conditions)
        n = search.candidate_limit(top_k, s.rerank_enabled, s.rerank_top_n, s.rerank_multiplier, s.search_heat_weight)
        hits = search.vector_top_k(found, self.embedder.one(query), n)
        words = [r[0] for r in self.spark.range(1).select(F.explode(fts.terms(F.lit(query)))).collect()] if hybrid else []
        if words:
            index = self.catalog.read("postings")
            if scope is not None or conditions:
                index = index.join(found.select(F.col("chunk_id").alias("id")), "id", "left_semi")
            size = index.where(F.col("term") == fts.WHOLE).agg(F.count("*"), F.avg("len")).first()
            if size[0]:
                text = fts.bm25(index, words, size[0], size[1] or 1.0)
                a = fts.ranked(hits.select(F.col("chunk_id").alias("id"), "_distance"), "_distance", n, descending=False)
                both = fts.fuse(a, fts.ranked(text, "score", n)).orderBy(F.desc("_relevance_score"), "id").limit(n)
                hits = found.join(both, F.col("chunk_id") == F.col("id")).drop("id")
        score = search.unified_score(hits)
        if s.rerank_enabled:
            ready = hits.withColumn("__r", self.reranker.column(query, F.coalesce("content", F.lit(""))))
            hits = search.blend(ready, score, F.col("__r"), s.rerank_weight).drop("__r")
            score = F.col("_final_score")
        if s.search_heat_weight > 0:
            hits = search.heat_bias(hits.withColumn("__s", score), self._heat(now), F.col("__s"), s.search_heat_weight).drop("__s")
            score = F.col("_final_score")
        return hits.withColumn("score", score).orderBy("score", "chunk_id").limit(top_k)

    def search(self, query: str, *, filters: dict | None = None, source: str | None = None, collections: Sequence[str] | None = None, doc_ids: Sequence[str] | None = None, top_k: int = 5, toc_only: bool = False, hybrid: bool = False, with_metadata: bool | None = None, record_heat: bool = True, now: float | None = None) -> DataFrame:
        """The best chunks, or with ``toc_only`` one row per document with its matching sections."""
        hits = self._scored(query, top_k, filters, hybrid=hybrid, source=source, collections=None if collections is None else list(collections), doc_ids=None if doc_ids is None else list(doc_ids), now=now).persist()
        if record_heat:
            self.record_access(hits, heat.WEIGHTS["search"], now)
            self._hurry(hits)
        meta = toc_only if with_metadata is None else with_metadata
        extra = ["filename", "brief_intro", *(["instruction", "metadata_json"] if meta else [])]
        shaped = search.toc_by_document(hits) if toc_only else hits.select("chunk_id", "doc_id", "chunk_index", "section", "content", "summary", "source", "score")
        out = search.with_stub(shaped, self.catalog.read("stubs"), extra).orderBy("score", *(["doc_id"] if toc_only else ["chunk_id"]))
        for a in self.adaptors:
            out = a.on_search_results(query, out)
        return out

    def search_grouped(self, query: str, *, top_k: int = 5, **how: Any) -> DataFrame:
        """The best chunks grouped by document. ``top_k`` counts chunks."""
        hits = self.search(query, top_k=top_k, with_metadata=False, **{k: v for k, v in how.items() if k in ("hybrid", "doc_ids", "source", "collections", "filters", "now")})
        grouped = search.group_by_document(hits.drop("filename", "brief_intro"), ["chunk_id", "chunk_index", "section", "content", "summary", "score"])
        return search.with_stub(grouped, self.catalog.read("stubs"), ["filename", "brief_intro", "instruction"]).orderBy("score", "doc_id")

    # -- heat ---

    def _hurry(self, hits: DataFrame) -> None:
        """Documents of hits that still wait to be embedded move up in the queue."""
        waiting = self.catalog.read("tasks").where(F.col("status") == "pending")
        if not waiting.join(hits.select("doc_id"), "doc_id", "left_semi").isEmpty():
            self.catalog.rewrite("tasks", lambda queue: tasks.bump(queue, hits))

    def record_access(self, sections: DataFrame, weight: float, now: float | None = None) -> None:
        rows = sections.where(F.trim(F.coalesce("section", F.lit(""))) != "").select("doc_id", "section").distinct()
        self.catalog.append("access_events", rows.select("doc_id", "section", F.lit(float(weight)).alias("weight"), F.lit(time.time() if now is None else now).alias("ts")))
        if self.on_hot_section:
            self._tell_hot(rows, now)

    def _tell_hot(self, sections: DataFrame, now: float | None) -> None:
        """Calls the hooks for sections that have become hot, once until they cool down."""
        rows = self._heat(now).join(sections, ["doc_id", "section"], "left_semi").select("doc_id", "section", (F.col("heat") >= self.settings.section_heat_threshold).alias("hot"))
        for r in rows.orderBy("doc_id", "section").collect():  # as many as one call has touched
            key = (r["doc_id"], r["section"])
            if not r["hot"]:
                self._hot.discard(key)
            elif key not in self._hot:
                self._hot.add(key)
                for hook in self.on_hot_section:
                    hook(*key)

    def _heat(self, now: float | None = None) -> DataFrame:
        return heat.scores(heat.totals(self.catalog.read("access_events")), F.lit(time.time() if now is None else float(now)), self.settings.section_heat_half_life)

    def get_section_heat(self, doc_id: str | None = None, limit: int = 20, now: float | None = None) -> DataFrame:
        return heat.report(self._heat(now), doc_id, self.settings.section_heat_threshold, limit)

    def track_access(self, path: str, now: float | None = None) -> dict:
        """Notes an access to a file; the second while recent promotes it, which indexes it with summaries."""
        promoted = self.access.touch(path, time.time() if now is None else now)
        self.catalog.put_json("access", self.access.dump())
        if promoted and os.path.exists(path) and base.format_of(path):
            self.add(path, summarize=True)
        for hook in self.on_promote if promoted else ():
            hook(path)
        return {"path": path, "promoted": promoted, "is_hot": path in self.access.hot, "is_recent": path in self.access.recent, "stats": self.access.stats()}

    # -- reading ---

    def _stub(self, doc_id: str) -> dict | None:
        r = self.catalog.read("stubs").where(F.col("doc_id") == doc_id).first()
        return r.asDict() if r else None

    def _toc(self, doc_id: str) -> DataFrame:
        stub = self.catalog.read("stubs").where(F.col("doc_id") == doc_id)
        entries = F.from_json(F.get_json_object("probe_json", "$.structure.toc"), f"array<{TOC_ENTRY}>")
        return stub.select("doc_id", F.posexplode(entries).alias("pos", "e")).select("doc_id", "pos", "e.*")

    def _chunks(self, doc_id: str) -> DataFrame:
        return self.catalog.read("chunks").where(F.col("doc_id") == doc_id).orderBy("chunk_index", "piece_index")

    def get_doc_meta(self, doc_id: str) -> dict | None:
        stub = self._stub(doc_id)
        if stub is None:
            return None
        p = json.loads(stub["probe_json"])
        return {"doc_id": doc_id, "filename": stub["filename"], "brief_intro": stub["brief_intro"], "instructions": stub["instruction"], "file_type": p.get("file_type"), "source": stub["source"], "metadata": json.loads(stub["metadata_json"] or "{}"), "toc": (p.get("structure") or {}).get("toc") or [], "processing_status": self.get_status(doc_id)["status"]}

    def inspect(self, doc_id: str, *, sections: Sequence[str] | None = None, full: bool = False, now: float | None = None) -> dict | None:
        """A document's contents; with sections their chunks, children included; in full the probe and all summaries."""
        out = self.get_doc_meta(doc_id)
        if out is None:
            return None
        if full:
            stub = self._stub(doc_id)
            out["probe"] = json.loads(stub["probe_json"])
            out["chunk_summaries"] = [{"chunk_index": r["chunk_index"], "section": r["section"], "summary": r["summary"]} for r in self._chunks(doc_id).collect()]
        if sections:
            want = self.spark.createDataFrame([(doc_id, s) for s in sections if s], "doc_id string, section string")
            hit = toc.expand(self._toc(doc_id), want)
            self.record_access(hit.select("doc_id", F.col("title").alias("section")), heat.WEIGHTS["inspect"], now)
            named = hit.select("doc_id", "title").union(want.select("doc_id", "section"))
            out["sections"] = [r.asDict() for r in toc.chunks_of(self._chunks(doc_id), named).select("chunk_index", "section", "content", "summary").orderBy("chunk_index").collect()]
        return out

    def read_segment(self, doc_id: str, section_path: str, now: float | None = None, include_summary: bool = True) -> dict:
        """One section with all that lies below it."""
        stub = self._stub(doc_id)
        if stub is None:
            return {"error": "document_not_found", "doc_id": doc_id}
        entries = self._toc(doc_id)
        want = self.spark.createDataFrame([(doc_id, section_path)], "doc_id string, section string")
        hit = toc.expand(entries, want).persist()
        self.record_access(hit.select("doc_id", F.col("title").alias("section")), heat.WEIGHTS["read"], now)
        named = hit.select("doc_id", "title").union(want.select("doc_id", "section")).where("title <> ''")
        cols = ["chunk_index", "section", "content", *(["summary"] if include_summary else [])]
        chunks = [r.asDict() for r in toc.chunks_of(self._chunks(doc_id), named).select(*cols).orderBy("chunk_index").collect()]
        context = [{"level": r["level"], "title": r["title"], "preview": r["preview"]} for r in hit.orderBy("pos").collect()]
        hit.unpersist()
        out = {"doc_id": doc_id, "filename": stub["filename"], "section_path": section_path, "chunks": chunks, "toc_context": context, "token_estimate": max(1, len(json.dumps(chunks, ensure_ascii=False)) // 3), "expanded": len({c["title"] for c in context}) > 1}
        if not chunks:
            state = self.get_status(doc_id)
            out["note"] = "still being processed" if state["status"] in tasks.ACTIVE else "no chunk has this section; small documents are one chunk without sections"
        return out

    def read_structured(self, path: str, *, sections: Sequence[str] | None = None, include_content: bool = False) -> dict:
        """A file's structure, from the index where it is there, else read now and not kept. Sections match exactly."""
        full = os.path.abspath(path)
        if base.format_of(full) is None:
            return {"filename": base.safe_name(full), "processing_status": "unsupported", "toc": [], "chunks": [], "token_estimate": 1}
        row = self.catalog.read("path_index").where(F.col("path") == full).first()
        stub = self._stub(row["doc_id"]) if row else None
        if stub:
            p, doc = json.loads(stub["probe_json"]), row["doc_id"]
            chunks = [r.asDict() for r in self._chunks(doc).select("chunk_index", "section", "content").collect()]
            intro, how, state = stub["brief_intro"], stub["instruction"], self.get_status(doc)["status"]
        else:
            with open(full, "rb") as f:
                p = base.parse(full, f.read())
            from ..sources.guides import guide

            doc, (intro, how), state = None, guide(p), "not_indexed"
            chunks = [{"chunk_index": c["index"], "section": c["section"], "content": c["content"]} for c in p["chunks"]]
        if sections:
            names = {s.lower() for s in sections}
            chunks = [c for c in chunks if (c["section"] or "").lower() in names]
        elif not include_content:
            chunks = []
        return {"doc_id": doc, "filename": base.safe_name(full), "file_type": p["file_type"], "brief_intro": intro, "toc": p["structure"]["toc"], "instructions": how, "chunks": chunks, "processing_status": state, "token_estimate": max(1, len(json.dumps(chunks, ensure_ascii=False)) // 3)}

    def probe(self, path: str) -> dict:
        with open(path, "rb") as f:
            return base.parse(path, f.read())

    def summarize_doc(self, doc_id) -> bool:
        """Summarises a stored document's chunks that have none; False where there is nothing to do."""
        rows = self._chunks(doc_id)
        todo = rows.where(F.coalesce("summary", F.lit("")) == "")
        if todo.isEmpty():
            return False
        fresh = summaries.summarise(todo.drop("summary"), self.summariser).select("doc_id", "chunk_index", "summary").dropDuplicates(["doc_id", "chunk_index"])
        self.catalog.replace_chunks(summaries.merge_summaries(rows, fresh))
        return True

    # -- state ---

    def get_status(self, doc_id: str) -> dict:
        row = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return tasks.status(row, self.catalog.read("tasks"), self.catalog.read("stubs"), self.catalog.read("chunks")).first().asDict()

    def wait_for(self, doc_id: str, timeout: float = 300, poll: float = 0.5) -> bool:
        """Processes what is queued until the document is done; unknown ones are."""
        end = time.monotonic() + timeout
        while self.get_status(doc_id)["status"] in tasks.ACTIVE:
            if not self.worker.running:
                self.process_pending()
            if time.monotonic() > end:
                return False
            time.sleep(poll)
        return self.get_status(doc_id)["status"] != "failed"

    def recover_orphans(self, now: float | None = None) -> int:
        """Queues documents without chunks that have retries left."""
        ledger = tasks.failure_ledger(self.catalog.read("failures"))
        lost = tasks.orphans(self.catalog.read("stubs"), self.catalog.read("chunks"), ledger)
        new = lost.select("doc_id", "priority", F.lit(time.time() if now is None else now).alias("submitted_at"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("needs_summarization"))
        n = new.count()
        if n:
            self.catalog.rewrite("tasks", lambda queue: tasks.submit(queue, new))
        return n

    def stats(self) -> dict:
        one = lambda t, c=F.count("*"): self.catalog.read(t).agg(c).first()[0]
        hot = self._heat().agg(F.count("*"), F.count_if(F.col("heat") >= self.settings.section_heat_threshold)).first()
        return {"docs_indexed": one("stubs"), "chunks_stored": one("chunks"), "cached_hashes": one("content_hashes"), "collections": one("collections"), "storage_bytes": one("files", F.coalesce(F.sum("size"), F.lit(0))), "access": self.access.stats(), "section_heat": {"tracked": hot[0], "hot": hot[1]}}

    def telemetry(self, doc_id: str | None = None) -> DataFrame:
        """Seconds by phase, tokens, chunks and the share of reading that the introduction saves, by document."""
        t = telemetry.summary(self.catalog.read("telemetry"))
        return t if doc_id is None else t.where(F.col("doc_id") == doc_id)

    def list_docs(self, source: str | None = None) -> DataFrame:
        stubs = self.catalog.read("stubs")
        return stubs if source is None else stubs.where(filters.source_scope("source", source))

    def resolve(self, prefix: str) -> str | None:
        return filters.resolve_prefix(self.catalog.read("stubs"), prefix)

    def delete(self, doc_id: str) -> bool:
        if self._stub(doc_id) is None:
            return False
        self.catalog.delete_documents(self.spark.createDataFrame([(doc_id,)], "doc_id string"))
        return True

    def register_adaptor(self, adaptor: models.Adaptor) -> None:
        self.adaptors.append(adaptor)

    def collection(self, name: str) -> CollectionHandle:
        return CollectionHandle(self, name)


class CollectionHandle:
    """The engine's operations inside one collection."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    def add(self, path: str, **how: Any) -> str:
        return self.engine.add(path, **{**how, "collection": self.name})

    def search(self, query: str, **how: Any) -> DataFrame:
        return self.engine.search(query, **{**how, "collections": [self.name]})

    def remove(self, doc_id: str) -> None:
        self.engine.catalog.remove_from_collection(self.name, doc_id)

    def list_docs(self) -> DataFrame:
        return self.engine.catalog.collection_documents(self.name)

    def delete(self) -> bool:
        return self.engine.catalog.delete_collection(self.name)

    @property
    def doc_ids(self) -> list[str]:
        found = self.engine.catalog.get_collection(self.name)
        return found["doc_ids"] if found else []


