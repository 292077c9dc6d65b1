"""Watched folders as streaming queries.

*Full* mode indexes each new or changed file again when its content changed.
*Append* mode reads what was added to growing files since the last offset, whole
lines only, as one new document per batch.
"""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import ids
from ..functions.glob import ignored
from ..functions.text import stem
from ..operators import dedup
from ..plans.engine import Engine
from ..sources import base


def folders(paths: Sequence[str]) -> list[str]:
    """Folders among the paths, patterns expanded; missing ones are left out."""
    found = [d for p in paths for d in (glob.glob(p, recursive=True) if any(c in p for c in "*?[") else [p]) if os.path.isdir(d)]
    return sorted(dict.fromkeys(os.path.abspath(d) for d in found))


def wait_for_folders(paths: Sequence[str], timeout: float, poll: float = 2.0) -> list[str]:
    """Waits until a folder exists."""
    end = time.monotonic() + timeout
    while not (found := folders(paths)) and time.monotonic() < end:
        time.sleep(poll)
    return found


def file_stream(spark: SparkSession, path: str, ignore: Sequence[str] = (), max_files: int = 1000, max_age: str | None = None) -> DataFrame:
    """``(path, content, hash, modificationTime)`` of new files under a folder that some reader takes."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(max_files)).option("latestFirst", "true")
    if max_age:
        reader = reader.option("maxFileAge", max_age)
    df = reader.load(path).withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))
    return df.where(base.format_column(F.col("path")).isNotNull() & ~ignored(F.col("path"), list(ignore))).withColumn("hash", ids.content_hash("content"))


def watch(engine: Engine, path: str, checkpoint: str, ignore: Sequence[str] = (), once: bool = True, **how) -> StreamingQuery:
    """Keeps an index of a folder; ``once`` stops when all files there now are done. Known content is skipped."""

    def batch(df: DataFrame, _: int) -> None:
        latest = dedup.first_of_each(df, ["path"], ["hash"]).select("path", "content")
        if not latest.isEmpty():
            engine.ingest(latest, **how)

    writer = file_stream(engine.spark, path, ignore).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class AppendReader(DataSourceStreamReader):
    """Offsets are byte positions by file, at line ends; a file that shrank is read again from its start."""

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def _ends(self) -> dict[str, int]:
        out = {}
        for folder, _, names in sorted(os.walk(self.root)):
            for n in sorted(names):
                p = os.path.join(folder, n)
                if n.endswith(self.suffix):
                    with open(p, "rb") as f:
                        size = f.seek(0, 2)
                        at = size
                        while at > 0:  # back to the last line end
                            step = min(65_536, at)
                            f.seek(at - step)
                            cut = f.read(step).rfind(b"\n")
                            if cut >= 0:
                                out[p] = at - step + cut + 1
                                break
                            at -= step
        return out

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        return [_Part(p, a.get(p, 0) if a.get(p, 0) <= stop else 0, stop) for p, stop in b.items() if stop != a.get(p, 0) and stop > 0]

    def read(self, part: _Part) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            yield (part.path, part.start, part.stop, f.read(part.stop - part.start))

    def commit(self, end: dict) -> None:
        return None


class AppendSource(DataSource):
    """``spark.readStream.format("appended_lines").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, start long, stop long, content binary"

    def streamReader(self, schema) -> AppendReader:
        return AppendReader(self.options)


def sound_offsets(offsets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(path, offset)`` with 0 where the index has no chunk of the file's session: such a file is read anew."""
    sessions = chunks.select(F.col("session_id").alias("__s")).where("__s is not null").distinct().withColumn("__has", F.lit(True))
    joined = offsets.withColumn("__s", stem("path")).join(sessions, "__s", "left")
    return joined.select("path", F.when(F.col("__has"), F.col("offset")).otherwise(0).cast("long").alias("offset"))


def watch_appends(engine: Engine, path: str, checkpoint: str, suffix: str = ".jsonl", once: bool = True, probe_config: dict | None = None, source: str = "", collection: str | None = None) -> StreamingQuery:
    """Indexes what grows: each batch of a file is the document ``file@offset``, of the session of the file's stem.
    All files that have grown are one job.

    A batch that runs again after a failure gives the same documents.
    """
    engine.spark.dataSource.register(AppendSource)

    def batch(df: DataFrame, _: int) -> None:
        name, session = F.concat("path", F.lit("@"), F.col("start").cast("string"), F.lit(suffix)), stem("path")
        meta = F.to_json(F.struct(session.alias("session_id"), F.col("start").alias("offset")))
        rows = df.select(name.alias("path"), "content", meta.alias("metadata_json"))
        if not rows.isEmpty():
            engine.ingest(rows, force=True, source=source, collection=collection, probe_config=probe_config)

    writer = engine.spark.readStream.format("appended_lines").option("suffix", suffix).load(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def file_removed(engine, path, collection=None) -> list[str]:
    """Removes what append mode made of a file that is gone."""
    return engine.catalog.delete_session(os.path.splitext(os.path.basename(path))[0], collection)


class Watchers:
    """Running queries by collection, kept equal to the collections' settings."""

    def __init__(self, engine: Engine, checkpoint_root: str):
        self.engine, self.root, self.running = engine, checkpoint_root, {}
        engine.close_with(self)

    def sync(self, once: bool = False) -> dict[str, list[str]]:
        """Starts what is configured and stops what no longer is; the names started and stopped."""
        want = {r["name"]: r for r in self.engine.catalog.watch_configs().collect()}
        stopped = [n for n in self.running if n not in want]
        for n in stopped:
            for q in self.running.pop(n):
                q.stop()
        started = [n for n in want if n not in self.running]
        for n in started:
            r, config = want[n], json.loads(want[n]["watch_config"] or "{}")
            queries = []
            for i, folder in enumerate(folders(r["watch_paths"])):
                checkpoint = f"{self.root}/{n}-{i}"
                if config.get("mode") == "append":
                    queries.append(watch_appends(self.engine, folder, checkpoint, once=once, probe_config=config.get("probe_config"), collection=n))
                else:
                    queries.append(watch(self.engine, folder, checkpoint, r["watch_ignore"] or (), once=once, collection=n))
            self.running[n] = queries
        return {"started": sorted(started), "stopped": sorted(stopped)}

    def stop(self) -> None:
        for queries in self.running.values():
            for q in queries:
                q.stop()
        self.running.clear()
