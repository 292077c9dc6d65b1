"""Readers: files of a format become rows of ``schemas.PROBE``.

Files are listed and read by Spark's binary source; parsers are plain functions
from bytes to a dict that run in Arrow batches on the executors. A file that a
parser can't read gives a row whose ``error`` says why, and never fails the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROBE, columns

#: First match wins.
FORMATS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("pdf", ("pdf",)),
    ("image", ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp")),
    ("docx", ("docx",)),
    ("pptx", ("pptx",)),
    ("calendar", ("ics",)),
    ("archive", ("zip", "tar", "tar.gz", "tgz", "tar.bz2", "tar.xz")),
    ("csv", ("csv",)),
    ("json", ("json",)),
    ("jsonl", ("jsonl", "ndjson")),
    ("config", ("yaml", "yml", "toml", "ini", "conf", "cfg")),
    ("code", ("py", "js", "jsx", "mjs", "ts", "tsx")),
    ("log", ("log",)),
    ("markdown", ("md", "markdown")),
    ("web", ("html", "htm")),
)
#: Readers of other formats, by name: extensions and parser. Add with ``register_reader``.
CUSTOM: dict[str, tuple[tuple[str, ...], Callable[[str, bytes], dict]]] = {}


def register_reader(name: str, extensions: Iterable[str], parser: Callable[[str, bytes], dict]) -> None:
    """A reader of one's own; its parser takes path and bytes and returns any fields of ``schemas.PROBE``."""
    CUSTOM[name] = (tuple(e.lower().lstrip(".") for e in extensions), parser)


def format_of(path: str) -> str | None:
    p = path.lower()
    for name, ends in ((n, e) for n, (e, _) in CUSTOM.items()):
        if any(p.endswith("." + e) for e in ends):
            return name
    return next((name for name, ends in FORMATS if any(p.endswith("." + e) for e in ends)), None)


def format_column(path: Column) -> Column:
    """The same as a Column; null where no reader takes the file."""
    out, p = F.lit(None).cast("string"), F.lower(path)
    every = [(n, e) for n, (e, _) in CUSTOM.items()] + list(FORMATS)
    for name, ends in reversed(every):
        hit = F.lit(False)
        for e in ends:
            hit = hit | p.endswith("." + e)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def decode(raw: bytes) -> str:
    """UTF-8, or Latin-1 where that fails."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def decode_column(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def tokens(text: str) -> int:
    return max(1, len(text) // 3)


def whole(text: str, limit: int = 2000) -> bool:
    return tokens(text) < limit


def preview(text: str, size: int = 120) -> str:
    for line in text.split("\n"):
        line = line.strip()
        if line and not line.startswith("#"):
            return line if len(line) <= size else line[:size].rsplit(" ", 1)[0] + "..."
    return ""


def entry(title: str, level: int = 1, page: int | None = None, preview: str | None = None, annotation: str | None = None) -> dict:
    return {"level": level, "title": title, "page": page, "preview": preview, "annotation": annotation}


def chunk(content: str, index: int, section: str | None = None, page: int | None = None, **metadata) -> dict:
    return {"content": content, "index": index, "section": section, "page": page, "metadata": {k: str(v) for k, v in metadata.items()}}


def probe(file_type: str, *, title=None, abstract=None, first_paragraph=None, toc=(), captions=(), schema_tree=None, columns=(), definitions=(), stats=None, chunks=(), snippet=None, intro="") -> dict:
    return {
        "file_type": file_type,
        "topic": {"title": title, "abstract": abstract, "first_paragraph": first_paragraph},
        "structure": {"toc": list(toc), "captions": list(captions), "schema_tree": None if schema_tree is None else json.dumps(schema_tree, ensure_ascii=False, default=str), "columns": list(columns), "definitions": list(definitions)},
        "stats": json.dumps(stats or {}, ensure_ascii=False, default=str),
        "chunks": list(chunks),
        "brief_intro": intro,
        "raw_snippet": snippet,
    }


def parser_of(kind: str, config: dict | None = None) -> Callable[[str, bytes], dict]:
    """The parser of a format; ``config`` reaches those that take settings."""
    if kind in CUSTOM:
        return CUSTOM[kind][1]
    from . import archives, code, configs, documents, images, json_files, office, tables

    found = {
        "markdown": documents.markdown,
        "web": documents.web,
        "log": documents.log,
        "calendar": documents.calendar,
        "pdf": office.pdf,
        "docx": office.docx,
        "pptx": office.pptx,
        "image": images.image,
        "archive": archives.archive,
        "csv": tables.csv_file,
        "json": json_files.json_file,
        "jsonl": lambda p, b: json_files.jsonl(p, b, config or {}),
        "config": configs.config,
        "code": code.code,
    }
    return found[kind]


def parse(path: str, raw: bytes, config: dict | None = None) -> dict:
    """One file. ``ValueError`` where no reader takes it."""
    kind = format_of(path)
    if kind is None:
        raise ValueError(f"no reader for {path}")
    from .guides import instructions

    out = {**probe(kind), **parser_of(kind, config)(path, raw), "path": path, "error": None}
    out["instructions"] = out.get("instructions") or instructions(out)
    return out


def probe_files(files: DataFrame, config: dict | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of ``schemas.PROBE`` for rows with a path and bytes."""
    names = [n for n, _ in columns(PROBE)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["p"], pdf["c"]):
                try:
                    row = parse(p, bytes(raw), config)
                except Exception as e:  # noqa: BLE001  one bad file must not fail the job
                    row = {**probe(format_of(p) or "unsupported"), "path": p, "error": f"{type(e).__name__}: {e}"}
                rows.append([row.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, PROBE)


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, config: dict | None = None) -> DataFrame:
    """Every readable file under a path, or of a glob, as ``schemas.PROBE`` rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return probe_files(reader.load(path).where(format_column(F.col("path")).isNotNull()), config)


def safe_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def suffix_of(path: str) -> str:
    return safe_name(path).lower().rsplit(".", 1)[-1] if "." in safe_name(path) else ""
