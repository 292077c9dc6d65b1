"""Module-level functions over one engine, which ``configure`` replaces.

Options are keywords, with the defaults of the tables below; an unknown one is
a ``TypeError``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .plans.engine import CollectionHandle, Engine
from .plans.models import Adaptor
from .plans.skill import export_skill, get_system_prompt, get_tool_schemas  # noqa: F401
from .session import Settings, build_session

_ENGINE: Engine | None = None

#: How to index. ``wait``: embed now rather than queue. ``force``: even if the content is known.
INDEX = dict(source="", collection=None, metadata=None, wait=False, force=False, summarize=False, use_llm_instructions=False)
#: How to search. ``top_k`` counts chunks; ``with_metadata`` follows ``toc_only`` unless given.
SEARCH = dict(source=None, collections=None, doc_ids=None, filters=None, top_k=5, hybrid=False, toc_only=False, with_metadata=None)
GROUPED = {k: v for k, v in SEARCH.items() if k not in ("toc_only", "with_metadata")}


def _take(given: dict, known: dict) -> dict:
    odd = given.keys() - known.keys()
    if odd:
        raise TypeError(f"unknown options: {', '.join(sorted(odd))}")
    return {**known, **given}


def configure(settings: Settings | None = None, *, spark: SparkSession | None = None, **plug_ins: Any) -> Engine:
    """Starts anew with these settings."""
    global _ENGINE
    settings = settings or Settings()
    _ENGINE = Engine(spark or SparkSession.getActiveSession() or build_session(), settings.db_path, settings, **plug_ins)
    return _ENGINE


def engine() -> Engine:
    return _ENGINE or configure()


def add(path: str, **options: Any) -> str:
    """Indexes a file; options of ``INDEX``."""
    return engine().add(path, **_take(options, INDEX))


def add_batch(paths: list[str], **options: Any) -> list[str]:
    """Indexes files in one job; options of ``INDEX``, waiting unless told otherwise."""
    return engine().add_batch(paths, **_take(options, {**INDEX, "wait": True}))


def add_content(content: str | bytes, filename: str, **options: Any) -> str:
    """Indexes text; options of ``INDEX``, and ``content_type``. Queued text is kept until it is processed."""
    return engine().add_content(content, filename, **_take(options, {**INDEX, "content_type": None}))


def search(query: str, **options: Any) -> list[dict]:
    """The best chunks, or documents with their sections; options of ``SEARCH``."""
    return [r.asDict(recursive=True) for r in engine().search(query, **_take(options, SEARCH)).collect()]


def search_grouped(query: str, **options: Any) -> list[dict]:
    """The best chunks by document; options of ``GROUPED``."""
    return [r.asDict(recursive=True) for r in engine().search_grouped(query, **_take(options, GROUPED)).collect()]


def inspect(doc_id: str, sections: list[str] | None = None, full: bool = False) -> dict | None:
    return engine().inspect(doc_id, sections=sections, full=full)


def get_doc_meta(doc_id: str) -> dict | None:
    return engine().get_doc_meta(doc_id)


def read_segment(doc_id: str, section_path: str, include_summary: bool = True) -> dict:
    return engine().read_segment(doc_id, section_path, include_summary=include_summary)


def read_structured(path: str, sections: list[str] | None = None, include_content: bool = False) -> dict:
    return engine().read_structured(path, sections=sections, include_content=include_content)


def probe(path: str) -> dict:
    return engine().probe(path)


def start_processor(background: bool = False) -> int:
    """Queues what was left without chunks and processes the queue; the number of documents done. In the background
    a worker goes on doing so until ``shutdown``, and the number is 0."""
    if not engine().worker.running:
        engine().requeue_lost()
    engine().recover_orphans()
    if background:
        engine().worker.start()
        return 0
    return engine().process_pending()


def shutdown(timeout: float = 30.0) -> bool:
    """Stops watchers and, when nothing waits, the queue; whether all ended in time."""
    global _ENGINE
    ended = _ENGINE.shutdown(timeout) if _ENGINE else True
    _ENGINE = None
    return ended


def get_status(doc_id: str) -> dict:
    return engine().get_status(doc_id)


def wait_for(doc_id: str, timeout: int | float = 300) -> bool:
    return engine().wait_for(doc_id, timeout)


def stats() -> dict:
    return engine().stats()


def track_access(path: str) -> dict:
    return engine().track_access(path)


def get_section_heat(doc_id: str | None = None, limit: int = 20) -> list[dict]:
    return [r.asDict() for r in engine().get_section_heat(doc_id, limit).collect()]


def collection(name: str) -> CollectionHandle:
    return engine().collection(name)


def collections() -> list[str]:
    return engine().catalog.list_collections()


def create_collection(name: str, **fields: Any) -> dict:
    """Makes or changes a collection: ``metadata``, ``watch_paths``, ``watch_ignore``, ``auto_add_sources``."""
    engine().catalog.put_collection(name, **_take(fields, dict.fromkeys(("metadata", "watch_paths", "watch_ignore", "auto_add_sources"))))
    return get_collection_info(name) or {}


def get_collection_info(name: str) -> dict | None:
    return engine().catalog.get_collection(name)


def delete_collection(name: str) -> bool:
    return engine().catalog.delete_collection(name)


def gc_collections() -> list[str]:
    return engine().catalog.collect_garbage()


def list_docs(source: str | None = None) -> list[dict]:
    return [r.asDict() for r in engine().list_docs(source).collect()]


def delete(doc_id: str) -> bool:
    return engine().delete(doc_id)


def delete_by_session_id(session_id, collection=None) -> list[str]:
    """Removes a session's documents, of one collection where named; their ids."""
    return engine().catalog.delete_session(session_id, collection)


def register_adaptor(adaptor: Adaptor) -> None:
    engine().register_adaptor(adaptor)


def documents(source: str | None = None) -> DataFrame:
    """The documents as a DataFrame, for further work."""
    return engine().list_docs(source)
