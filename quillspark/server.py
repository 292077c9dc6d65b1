"""HTTP service of the standard library over the module-level functions. JSON in, JSON out."""

from __future__ import annotations

import json
import logging
import re
import tempfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from . import api
from .plans.skill import export_skill

LOG = logging.getLogger("quillspark.server")


class NotFound(Exception):
    pass


def _found(value: Any, what: str = "not found") -> Any:
    if value is None or value is False:
        raise NotFound(what)
    return value


def _flag(q: dict, name: str) -> bool:
    return str(q.get(name, "")).lower() in {"yes", "true", "1"}


def _names(b: dict) -> list[str] | None:
    """``collection`` and ``collections`` together."""
    both = ([b["collection"]] if b.get("collection") else []) + list(b.get("collections") or [])
    return list(dict.fromkeys(both)) or None


def _pick(b: dict, *names: str) -> dict:
    return {n: b[n] for n in names if n in b}


def _search(b: dict, **extra: Any) -> dict:
    how = _pick(b, "top_k", "hybrid", "toc_only", "source", "with_metadata", "doc_ids", "filters") | {"collections": _names(b)} | extra
    return {"results": api.search(b["query"], **how)}


def _grouped(b: dict) -> dict:
    return {"results": api.search_grouped(b["query"], **_pick(b, "top_k", "hybrid", "source", "doc_ids", "filters"), collections=_names(b))}


def _indexed(doc_id: str) -> dict:
    return {"doc_id": doc_id, "status": api.get_status(doc_id)["status"]}


def _probe(b: dict) -> dict:
    if "path" in b:
        return api.probe(b["path"])
    with tempfile.NamedTemporaryFile("w", suffix="-" + re.sub(r"[^\w.]", "_", b.get("filename", "text.md"))) as f:
        f.write(b["content"])
        f.flush()
        return api.probe(f.name)


def _put_collection(n: str, b: dict) -> dict:
    return api.create_collection(n, **_pick(b, "metadata", "watch_paths", "watch_ignore", "auto_add_sources"))


def _add_doc(n: str, b: dict) -> dict:
    api.engine().catalog.add_to_collection(n, [b["doc_id"]])
    return api.get_collection_info(n) or {}


def _remove_doc(n: str, d: str) -> dict:
    api.collection(n).remove(d)
    return {"removed": d}


_ADD = ("force", "summarize", "wait", "source", "metadata", "collection")
#: Method, path pattern, and a function of the path's parts, the body and the query.
ROUTES: list[tuple[str, str, Callable[..., Any]]] = [
    ("GET", r"/health", lambda b, q: {"status": "ok"}),
    ("POST", r"/index", lambda b, q: _indexed(api.add(b["path"], **_pick(b, *_ADD)))),
    ("POST", r"/index-content", lambda b, q: _indexed(api.add_content(b["content"], b["filename"], **_pick(b, "content_type", *_ADD)))),
    ("POST", r"/search", lambda b, q: _search(b)),
    ("POST", r"/search-grouped", lambda b, q: _grouped(b)),
    ("GET", r"/status/([^/]+)", lambda d, b, q: api.get_status(d)),
    ("GET", r"/doc-meta/([^/]+)", lambda d, b, q: _found(api.get_doc_meta(d))),
    ("GET", r"/inspect/([^/]+)", lambda d, b, q: _found(api.inspect(d, sections=[s for s in q.get("sections", "").split(",") if s] or None, full=_flag(q, "full")))),
    ("POST", r"/track", lambda b, q: api.track_access(b["path"])),
    ("POST", r"/read", lambda b, q: api.read_structured(b["path"], **_pick(b, "sections", "include_content"))),
    ("POST", r"/read-segment", lambda b, q: api.read_segment(b["doc_id"], b["section_path"], **_pick(b, "include_summary"))),
    ("POST", r"/probe", lambda b, q: _probe(b)),
    ("GET", r"/skill", lambda b, q: export_skill()),
    ("GET", r"/section-heat", lambda b, q: {"sections": api.get_section_heat(q.get("doc_id"), int(q.get("limit", 20)))}),
    ("GET", r"/stats", lambda b, q: api.stats()),
    ("GET", r"/docs", lambda b, q: {"docs": api.list_docs(q.get("source"))}),
    ("DELETE", r"/docs/by-session/([^/]+)", lambda s, b, q: {"deleted": api.delete_by_session_id(s, q.get("collection"))}),
    ("DELETE", r"/docs/([^/]+)", lambda d, b, q: {"deleted": _found(api.delete(d)) and d}),
    ("GET", r"/collections", lambda b, q: {"collections": [api.get_collection_info(n) for n in api.collections()]}),
    ("POST", r"/collections/gc", lambda b, q: {"removed": api.gc_collections()}),
    ("POST", r"/collections/([^/]+)/search", lambda n, b, q: _search(b, collections=[n])),
    ("POST", r"/collections/([^/]+)/docs", lambda n, b, q: _add_doc(n, b)),
    ("DELETE", r"/collections/([^/]+)/docs/([^/]+)", lambda n, d, b, q: _remove_doc(n, d)),
    ("POST", r"/collections/([^/]+)", lambda n, b, q: _put_collection(n, b)),
    ("PUT", r"/collections/([^/]+)", lambda n, b, q: _put_collection(n, b)),
    ("GET", r"/collections/([^/]+)", lambda n, b, q: _found(api.get_collection_info(n))),
    ("DELETE", r"/collections/([^/]+)", lambda n, b, q: {"deleted": _found(api.delete_collection(n)) and n}),
]


def handle(method: str, url: str, body: dict | None = None) -> tuple[int, Any]:
    """Status and answer of one request."""
    parts = urlsplit(url)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    for m, pattern, f in ROUTES:
        hit = re.fullmatch(pattern, parts.path.rstrip("/") or "/")
        if m == method and hit:
            try:
                return 200, f(*map(unquote, hit.groups()), body or {}, query)
            except NotFound as e:
                return 404, {"detail": str(e)}
            except KeyError as e:
                return 422, {"detail": f"missing field {e}"}
            except (ValueError, FileNotFoundError) as e:
                return 400, {"detail": str(e)}
    return 404, {"detail": "no such route"}


class Handler(BaseHTTPRequestHandler):
    def _answer(self) -> None:
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        try:
            status, out = handle(self.command, self.path, json.loads(raw) if raw else None)
        except json.JSONDecodeError:
            status, out = 400, {"detail": "the body is no JSON"}
        LOG.info("%s %s %s %s", self.command, self.path, status, raw[:1024])
        data = json.dumps(out, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PUT = do_DELETE = _answer

    def log_message(self, *_: Any) -> None:
        return None


def serve(host: str = "127.0.0.1", port: int = 7832) -> ThreadingHTTPServer:
    """A server; call its ``serve_forever``."""
    return ThreadingHTTPServer((host, port), Handler)
