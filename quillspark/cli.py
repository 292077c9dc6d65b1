"""Command line: ``python -m quillspark.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from . import api
from .plans.skill import export_skill
from .sources.base import format_of


def _files(paths: list[str]) -> list[str]:
    """Files as given; of folders, every file below that a reader takes."""
    out: list[str] = []
    for p in paths:
        if os.path.isdir(p):
            out += sorted(os.path.join(d, n) for d, _, names in os.walk(p) for n in names if format_of(n))
        else:
            out.append(p)
    return out


def _doc(prefix: str) -> str:
    found = api.engine().resolve(prefix)
    if found is None:
        sys.exit(f"no document {prefix}")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=about)

    c = add("index", "index files and folders")
    c.add_argument("paths", nargs="+")
    c.add_argument("--force", action="store_true")
    c.add_argument("--summarize", action="store_true")
    c.add_argument("--source", default="")
    c.add_argument("-c", "--collection")
    c = add("search", "search")
    c.add_argument("query")
    c.add_argument("-k", "--top-k", default=5, type=int)
    c.add_argument("--hybrid", action="store_true")
    c.add_argument("--toc", action="store_true")
    c.add_argument("--source")
    c.add_argument("-c", "--collection", action="append")
    c = add("inspect", "show a document")
    c.add_argument("doc")
    c.add_argument("--section", action="append")
    c.add_argument("--full", action="store_true")
    c = add("segment", "read a section")
    c.add_argument("doc")
    c.add_argument("section")
    add("status", "state of a document").add_argument("doc")
    add("probe", "structure of a file").add_argument("path")
    add("stats", "counts")
    add("list", "documents").add_argument("--source")
    c = add("collection", "collections")
    c.add_argument("action", choices=["list", "show", "delete", "remove"])
    c.add_argument("name", nargs="?")
    c.add_argument("doc", nargs="?")
    add("skill", "tool descriptions for agents")
    c = add("serve", "HTTP service")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=7832)
    return p


def run(args: argparse.Namespace) -> Any:
    a = args
    if a.command == "index":
        files = _files(a.paths)
        return dict(zip(files, api.engine().add_batch(files, force=a.force, summarize=a.summarize, source=a.source, collection=a.collection))) if files else {}
    if a.command == "search":
        return api.search(a.query, top_k=a.top_k, hybrid=a.hybrid, toc_only=a.toc, source=a.source, collections=a.collection)
    if a.command == "inspect":
        return api.inspect(_doc(a.doc), sections=a.section, full=a.full)
    if a.command == "segment":
        return api.read_segment(_doc(a.doc), a.section)
    if a.command == "status":
        return api.get_status(_doc(a.doc))
    if a.command == "probe":
        return api.probe(a.path)
    if a.command == "stats":
        return api.stats()
    if a.command == "list":
        return api.list_docs(a.source)
    if a.command == "collection":
        if a.action == "list":
            return [api.get_collection_info(n) for n in api.collections()]
        if not a.name:
            sys.exit("name a collection")
        if a.action == "show":
            return api.get_collection_info(a.name)
        if a.action == "delete":
            return {"deleted": api.delete_collection(a.name)}
        api.collection(a.name).remove(_doc(a.doc or ""))
        return api.get_collection_info(a.name)
    if a.command == "skill":
        return export_skill()
    from .server import serve

    serve(a.host, a.port).serve_forever()
    return None


def main(argv: list[str] | None = None) -> int:
    out = run(parser().parse_args(argv))
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
