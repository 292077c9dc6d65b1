"""The catalog: tables as versioned Parquet folders, and the statements that change them.

A version is a small file that lists folders. A change reads a version, writes
folders beside the old ones and then claims the next number; if another writer
has claimed it meanwhile, the change is made again from that writer's version,
so none is lost, and readers never see half a change. Claims are atomic on local
disks and where a rename to a taken name fails, as on HDFS; on an object store
that lets it overwrite, a table needs one writer at a time.

A deletion or an update rewrites only the folders that hold rows it touches.
Folders are joined once there are ``FEW`` of them.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import glob_regex
from ..schemas import TABLES, columns

#: Folders of a version before they are joined, and how often a change is tried.
FEW, TRIES = 128, 20


class Changed(RuntimeError):
    """Another writer claimed the version first."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str, keep_versions: int = 256):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep_versions

    # -- storage ---

    def _path(self, *parts: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _get(self, *parts: str) -> bytes:
        p, fs = self._path(*parts)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, content: bytes, *parts: str, replace: bool = False) -> bool:
        """Writes a file whole; False where it exists and isn't to be replaced."""
        tmp, fs = self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(content))
        out.close()
        final, _ = self._path(*parts)
        if fs.getUri().getScheme() == "file":
            a, b = tmp.toUri().getPath(), final.toUri().getPath()
            try:
                os.replace(a, b) if replace else os.link(a, b)
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        if replace:
            fs.delete(final, False)
        done = fs.rename(tmp, final)
        if not done:
            fs.delete(tmp, False)
        return done

    def put_json(self, name: str, value: Any) -> None:
        self._put(json.dumps(value).encode(), f"{name}.json", replace=True)

    def get_json(self, name: str, default: Any = None) -> Any:
        """What was put; the default where there is nothing or nothing readable."""
        p, fs = self._path(f"{name}.json")
        try:
            return json.loads(self._get(f"{name}.json")) if fs.exists(p) else default
        except ValueError:
            return default

    def _versions(self, table: str) -> list[str]:
        p, fs = self._path(table)
        if not fs.exists(p):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("v") and x.getPath().getName().endswith(".json"))

    def _state(self, table: str) -> tuple[int, list[str]]:
        """Number of the newest version, 0 where there is none, and its folders."""
        found = self._versions(table)
        return (int(found[-1][1:-5]), json.loads(self._get(table, found[-1]))) if found else (0, [])

    def _commit(self, table: str, number: int, folders: list[str]) -> None:
        """Makes these folders the version after ``number``, the one that the change was made from."""
        if not self._put(json.dumps(folders).encode(), table, f"v{number + 1:012d}.json"):
            raise Changed(f"{table} was changed by another writer")
        for old in self._versions(table)[: -self.keep]:
            p, fs = self._path(table, old)
            fs.delete(p, False)

    def _change(self, table: str, make: Callable[[list[str]], list[str] | None]) -> None:
        """Commits what ``make`` makes of the newest version's folders, again from the start if another writer was first."""
        for attempt in range(TRIES):
            number, folders = self._state(table)
            new = make(folders)
            if new is None:
                return
            try:
                return self._commit(table, number, new)
            except Changed:
                if attempt == TRIES - 1:
                    raise
                time.sleep(random.uniform(0, 0.02 * 2 ** min(attempt, 6)))

    def _frame(self, table: str, folders: list[str], named: bool = False) -> DataFrame:
        """Rows of some folders; ``named`` with the folder's name as ``__folder``."""
        if not folders:
            empty = self.spark.createDataFrame([], TABLES[table])
            return empty.withColumn("__folder", F.lit("")) if named else empty
        rows = self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{f}" for f in folders])
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"/(part-[0-9a-f]+)/[^/]*$", 1).alias("__folder")) if named else rows

    def read(self, table: str) -> DataFrame:
        return self._frame(table, self._state(table)[1])

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        self._shaped(table, df).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns(TABLES[table])])

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows; columns that ``df`` lacks are null."""
        folder = self._write(table, df)
        self._change(table, lambda folders: [*folders, folder])
        if len(self._state(table)[1]) >= FEW:
            self.compact(table)

    def overwrite(self, table: str, df: DataFrame) -> None:
        """The rows become the table. They must not come from the table itself: see ``rewrite``."""
        folder = self._write(table, df)
        self._change(table, lambda _: [folder])

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """The table becomes what ``change`` makes of it; ``change`` runs again if another writer was first."""
        self._change(table, lambda folders: [self._write(table, change(self._frame(table, folders)))])

    def compact(self, table: str) -> None:
        """Joins the folders of a table."""
        self._change(table, lambda folders: None if len(folders) < 2 else [self._write(table, self._frame(table, folders))])

    def vacuum(self, table: str, older_than: float = 86_400.0) -> int:
        """Deletes folders that no kept version lists and that are older than so many seconds; their number."""
        used = {f for v in self._versions(table) for f in json.loads(self._get(table, v))}
        p, fs = self._path(table)
        gone = [x.getPath() for x in (fs.listStatus(p) if fs.exists(p) else []) if x.getPath().getName().startswith("part-") and x.getPath().getName() not in used and time.time() - x.getModificationTime() / 1000 > older_than]
        for g in gone:
            fs.delete(g, True)
        return len(gone)

    def _replace(self, table: str, touched: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> None:
        """Rewrites the folders that hold ``touched`` rows to their ``rest``, with ``more`` rows."""

        def make(folders: list[str]) -> list[str] | None:
            hit = {r[0] for r in touched(self._frame(table, folders, named=True)).select("__folder").distinct().collect()} if folders else set()
            if not hit and more is None:
                return None
            parts = [self._shaped(table, rest(self._frame(table, [f for f in folders if f in hit])))] if hit else []
            new = parts + ([self._shaped(table, more)] if more is not None else [])
            return [*(f for f in folders if f not in hit), self._write(table, new[0] if len(new) == 1 else new[0].unionByName(new[1]))]

        self._change(table, make)

    def delete(self, table: str, condition: Column) -> None:
        gone = F.coalesce(condition, F.lit(False))
        self._replace(table, lambda df: df.where(gone), lambda df: df.where(~gone))

    def delete_matching(self, table: str, ids: DataFrame, key: str = "doc_id") -> None:
        keys = ids.select(key).distinct()
        self._replace(table, lambda df: df.join(keys, key, "left_semi"), lambda df: df.join(keys, key, "left_anti"))

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """Rows with the keys of ``df`` become its rows."""
        own = df.select(*keys).distinct()
        self._replace(table, lambda t: t.join(own, keys, "left_semi"), lambda t: t.join(own, keys, "left_anti"), df)

    # -- documents ---

    def replace_chunks(self, rows: DataFrame) -> None:
        """All chunks of the rows' documents become the rows; columns that begin with ``_`` are dropped."""
        self.upsert("chunks", rows.drop(*[c for c in rows.columns if c.startswith("_")]), ["doc_id"])

    def delete_documents(self, ids: DataFrame) -> None:
        """Removes documents with chunks, hashes and paths. Collections keep the id; listings leave it out."""
        for t in ("stubs", "chunks", "content_hashes", "path_index", "files", "raw_files", "postings"):
            self.delete_matching(t, ids)

    def delete_session(self, session_id, collection=None) -> list[str]:
        """Removes the documents of a session, of one collection where named; returns their ids."""
        found = self.read("chunks").where(F.col("session_id") == session_id).select("doc_id").distinct()
        if collection is not None:
            found = found.join(self.read("collection_docs").where(F.col("name") == collection), "doc_id", "left_semi")
        gone = sorted(r[0] for r in found.collect())
        if gone:
            ids = self.spark.createDataFrame([(x,) for x in gone], "doc_id string")
            self.delete_documents(ids)
            self.delete_matching("collection_docs", ids)
        return gone

    # -- collections ---

    def put_collection(self, name: str, metadata: dict | None = None, watch_paths: list[str] | None = None, watch_ignore: list[str] | None = None, auto_add_sources: list[str] | None = None, watch_config: dict | None = None, now: float | None = None) -> None:
        """Creates a collection or changes the fields given; watch settings inside metadata move to their own fields."""
        if not name:
            raise ValueError("a collection needs a name")
        old = self.get_collection(name) or dict(created_at=time.time() if now is None else now, metadata={}, auto_add_sources=[], watch_paths=[], watch_ignore=[], watch_config=None)
        meta = dict(metadata) if metadata is not None else None
        if meta is not None:
            watch_paths = meta.pop("watch_paths", None) if watch_paths is None else watch_paths
            watch_ignore = meta.pop("watch_ignore", None) if watch_ignore is None else watch_ignore
        pick = lambda new, k: old[k] if new is None else new
        config = pick(watch_config, "watch_config")
        row = (name, json.dumps(pick(meta, "metadata")), pick(watch_paths, "watch_paths"), pick(watch_ignore, "watch_ignore"), pick(auto_add_sources, "auto_add_sources"), float(old["created_at"]), None if config is None else json.dumps(config))
        self.upsert("collections", self.spark.createDataFrame([row], TABLES["collections"]), ["name"])

    def merge_metadata(self, name: str, more: dict) -> None:
        old = self.get_collection(name)
        self.put_collection(name, metadata={**(old["metadata"] if old else {}), **more})

    def get_collection(self, name: str) -> dict | None:
        r = self.read("collections").where(F.col("name") == name).first()
        if r is None:
            return None
        docs = sorted(x[0] for x in self.read("collection_docs").where(F.col("name") == name).select("doc_id").collect())
        d = r.asDict()
        return {**d, "metadata": json.loads(d["metadata"] or "{}"), "watch_config": json.loads(d["watch_config"]) if d["watch_config"] else None, "watch_paths": d["watch_paths"] or [], "watch_ignore": d["watch_ignore"] or [], "auto_add_sources": d["auto_add_sources"] or [], "doc_ids": docs}

    def list_collections(self) -> list[str]:
        return sorted(r[0] for r in self.read("collections").select("name").distinct().collect())

    def delete_collection(self, name: str) -> bool:
        if self.read("collections").where(F.col("name") == name).isEmpty():
            return False
        self.delete("collections", F.col("name") == name)
        self.delete("collection_docs", F.col("name") == name)
        return True

    def add_to_collection(self, name: str, doc_ids: list[str] | DataFrame) -> None:
        """Adds members, each once; the collection is made if it doesn't exist."""
        if self.read("collections").where(F.col("name") == name).isEmpty():
            self.put_collection(name)
        if isinstance(doc_ids, DataFrame):
            new = doc_ids.select(F.lit(name).alias("name"), "doc_id").distinct()
        else:
            new = self.spark.createDataFrame([(name, x) for x in dict.fromkeys(doc_ids)], TABLES["collection_docs"])
        self.upsert("collection_docs", new, ["name", "doc_id"])

    def remove_from_collection(self, name: str, doc_id: str) -> None:
        self.delete("collection_docs", (F.col("name") == name) & (F.col("doc_id") == doc_id))

    def collections_of(self, doc_id: str) -> list[str]:
        return sorted(r[0] for r in self.read("collection_docs").where(F.col("doc_id") == doc_id).select("name").distinct().collect())

    def collection_documents(self, name: str) -> DataFrame:
        """Stubs of a collection; members that no longer exist are left out."""
        return self.read("stubs").join(self.read("collection_docs").where(F.col("name") == name).select("doc_id").distinct(), "doc_id")

    def watch_configs(self) -> DataFrame:
        """Collections with something to watch, and their settings, from metadata where there are none."""
        c = self.read("collections").where(F.size("watch_paths") > 0)
        return c.select("name", "watch_paths", "watch_ignore", F.coalesce("watch_config", F.get_json_object("metadata", "$.watch_config")).alias("watch_config"))

    def collect_garbage(self, now: float | None = None) -> list[str]:
        """Removes collections past their time to live and names them."""
        c = self.read("collections").withColumn("ttl", ttl_seconds(F.get_json_object("metadata", "$.ttl")))
        gone = sorted(r[0] for r in expired(c, F.lit(time.time() if now is None else now)).select("name").collect())
        if gone:
            self.delete("collections", F.col("name").isin(gone))
            self.delete("collection_docs", F.col("name").isin(gone))
        return gone


def ttl_seconds(value: Column) -> Column:
    """Seconds of a number, or of a number with s, m, h or d behind it."""
    number = F.try_to_number(F.regexp_extract(value, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("9999999999.999999")).cast("double")
    plain = value.try_cast("double")
    unit = F.lower(F.regexp_extract(value, r"([smhdSMHD])\s*$", 1))
    scale = F.when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86_400.0)
    return F.coalesce(plain, F.coalesce(F.regexp_extract(value, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), number) * scale)


def expired(collections: DataFrame, now: Column) -> DataFrame:
    return collections.where(F.col("ttl").isNotNull() & (now - F.col("created_at") > F.col("ttl")))


def route(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(name, doc_id)``: documents whose source matches a collection's pattern; an empty source matches none.

    Distinct sources are matched, not documents, and joined back by equality.
    """
    sources = docs.where(F.coalesce("source", F.lit("")) != "").select("source").distinct()
    hits = sources.join(patterns.select("name", glob_regex(F.col("pattern")).alias("__p")), F.expr("source rlike __p")).select("source", "name").distinct()
    return docs.select("doc_id", "source").join(hits, "source").select("name", "doc_id").distinct()
