"""Schemas of the tables and nested values."""

from __future__ import annotations


def columns(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a schema in DDL; needs no session."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind.strip()))
            start = i + 1
    return out


TOC_ENTRY = "STRUCT<level: INT, title: STRING, page: INT, preview: STRING, annotation: STRING>"
PROBE_CHUNK = "STRUCT<content: STRING, index: INT, section: STRING, page: INT, metadata: MAP<STRING, STRING>>"
CAPTION = "STRUCT<text: STRING, page: INT, kind: STRING>"
TOPIC = "STRUCT<title: STRING, abstract: STRING, first_paragraph: STRING>"
STRUCTURE = f"STRUCT<toc: ARRAY<{TOC_ENTRY}>, captions: ARRAY<{CAPTION}>, schema_tree: STRING, columns: ARRAY<STRING>, definitions: ARRAY<STRING>>"

#: What a reader makes of one file. ``stats`` and ``schema_tree`` hold JSON, their values being of mixed types.
PROBE = f"path STRING, file_type STRING, topic {TOPIC}, structure {STRUCTURE}, stats STRING, chunks ARRAY<{PROBE_CHUNK}>, brief_intro STRING, instructions STRING, raw_snippet STRING, error STRING"

STUBS = "doc_id STRING, filename STRING, brief_intro STRING, instruction STRING, probe_json STRING, source STRING, metadata_json STRING"
CHUNKS = "chunk_id STRING, doc_id STRING, filename STRING, content STRING, content_tokenized STRING, summary STRING, section STRING, chunk_index INT, vector ARRAY<FLOAT>, is_split BOOLEAN, piece_index INT, total_pieces INT, source STRING, file_type STRING, metadata_json STRING, session_id STRING, indexed_at DOUBLE"
COLLECTIONS = "name STRING, metadata STRING, watch_paths ARRAY<STRING>, watch_ignore ARRAY<STRING>, auto_add_sources ARRAY<STRING>, created_at DOUBLE, watch_config STRING"
COLLECTION_DOCS = "name STRING, doc_id STRING"
CONTENT_HASHES = "hash STRING, doc_id STRING"
PATH_INDEX = "path STRING, doc_id STRING"
ACCESS_EVENTS = "doc_id STRING, section STRING, weight DOUBLE, ts DOUBLE"
TASKS = "doc_id STRING, priority INT, submitted_at DOUBLE, status STRING, error STRING, needs_summarization BOOLEAN"
FAILURES = "doc_id STRING, ts DOUBLE, error STRING, source STRING, filename STRING"
TELEMETRY = "doc_id STRING, phase STRING, seconds DOUBLE, tokens LONG, saved_ratio DOUBLE, num_chunks INT"
OFFSETS = "path STRING, offset LONG"
RAW_FILES = "doc_id STRING, path STRING, content BINARY"
POSTINGS = "doc_id STRING, id STRING, term STRING, tf LONG, len INT"
FILES = "doc_id STRING, path STRING, suffix STRING, size LONG"

TABLES = {
    "stubs": STUBS,
    "chunks": CHUNKS,
    "collections": COLLECTIONS,
    "collection_docs": COLLECTION_DOCS,
    "content_hashes": CONTENT_HASHES,
    "path_index": PATH_INDEX,
    "access_events": ACCESS_EVENTS,
    "tasks": TASKS,
    "failures": FAILURES,
    "telemetry": TELEMETRY,
    "offsets": OFFSETS,
    "files": FILES,
    "raw_files": RAW_FILES,
    "postings": POSTINGS,
}
