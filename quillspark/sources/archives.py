"""Archives: listing, folder rollup, extension histogram."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import suffix
from .base import chunk, entry, probe, safe_name

DEPTH, TOC_MOST, LISTED, EXTENSIONS = 3, 30, 100, 15


def directory_rollup(entries: DataFrame, partition: list[str], path: str = "path", size: str = "size", depth: int = DEPTH) -> DataFrame:
    """Files and bytes of every folder down to ``depth``, each file counted in all its ancestors."""
    parts = F.split(path, "/")
    reach = F.least(F.size(parts) - 1, F.lit(depth))
    levels = entries.where(F.size(parts) > 1).select(*partition, parts.alias("s"), F.col(size).alias("b"), F.explode(F.sequence(F.lit(1), reach)).alias("level"))
    dirs = levels.groupBy(*partition, F.array_join(F.slice("s", 1, F.col("level")), "/").alias("dir"))
    return dirs.agg(F.first("level").alias("level"), F.count("*").alias("files"), F.sum("b").alias("bytes"))


def extension_histogram(entries: DataFrame, partition: list[str], path: str = "path", most: int = EXTENSIONS) -> DataFrame:
    """The most frequent extensions."""
    ext = F.coalesce(F.nullif(suffix(path), F.lit("")), F.lit("(none)"))
    counts = entries.groupBy(*partition, ext.alias("ext")).agg(F.count("*").alias("n"))
    if not partition:
        return counts.orderBy(F.desc("n"), "ext").limit(most)
    w = Window.partitionBy(*partition).orderBy(F.desc("n"), "ext")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def listing(path: str, raw: bytes) -> list[tuple[str, int, bool]]:
    """``(name, size, is_folder)`` of a zip or tar file."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [(i.filename, i.file_size, i.is_dir()) for i in z.infolist()]
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        return [(m.name, m.size, m.isdir()) for m in t.getmembers()]


def archive(path: str, raw: bytes) -> dict:
    entries = listing(path, raw)
    files = [(n, s) for n, s, folder in entries if not folder]
    dirs: dict[str, list[int]] = {}
    for name, size in files:
        parts = name.strip("/").split("/")
        for k in range(1, min(len(parts) - 1, DEPTH) + 1):
            d = dirs.setdefault("/".join(parts[:k]), [0, 0])
            d[0] += 1
            d[1] += size
    ext = Counter((n.rsplit("/", 1)[-1].rsplit(".", 1) + [""])[1].lower() or "(none)" for n, _ in files)
    toc = [entry(d.rsplit("/", 1)[-1] + "/", d.count("/") + 1, annotation=f"{n} files, {b} bytes") for d, (n, b) in sorted(dirs.items())[:TOC_MOST]]
    lines = [f"{n} ({s} bytes)" for n, s in files[:LISTED]]
    if len(files) > LISTED:
        lines.append(f"and {len(files) - LISTED} more files")
    stats = {"file_count": len(files), "dir_count": sum(f for _, _, f in entries), "total_size": sum(s for _, s in files), "extensions": dict(sorted(ext.items(), key=lambda x: (-x[1], x[0]))[:EXTENSIONS])}
    intro = f"Archive {safe_name(path)} with {len(files)} files"
    return probe("archive", title=safe_name(path), toc=toc, stats=stats, chunks=[chunk("\n".join(lines) or "(empty archive)", 0, "Listing")], intro=intro)
