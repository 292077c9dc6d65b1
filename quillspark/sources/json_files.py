"""JSON documents and JSON lines."""

from __future__ import annotations

import json
import re
from typing import Any

from .base import chunk, decode, entry, probe, safe_name, whole

DEPTH, STRING_CUT, TOC_ALL = 3, 40, 20
MISSING = object()


def schema_tree(value: Any, depth: int = 0) -> Any:
    """Types of a value to three levels."""
    if isinstance(value, bool):
        return "bool"
    if value is None:
        return "null"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return f"str({value[:STRING_CUT] + '...' if len(value) > STRING_CUT else value})"
    if isinstance(value, list):
        if not value:
            return "[]"
        if isinstance(value[0], (dict, list)) and depth < DEPTH:
            return {"__array_of__": schema_tree(value[0], depth + 1), "__length__": len(value)}
        return f"[{type(value[0]).__name__} x {len(value)}]"
    if depth >= DEPTH:
        return "{...}"
    return {k: schema_tree(v, depth + 1) for k, v in value.items()}


def max_depth(value: Any) -> int:
    if isinstance(value, dict):
        return 1 + max(map(max_depth, value.values()), default=0)
    if isinstance(value, list):
        return 1 + max(map(max_depth, value), default=0)
    return 0


def key_count(value: Any) -> int:
    """Keys at all levels; a list counts by its first item."""
    if isinstance(value, dict):
        return len(value) + sum(map(key_count, value.values()))
    return key_count(value[0]) if isinstance(value, list) and value else 0


def describe(value: Any) -> str:
    if isinstance(value, dict):
        return f"object with {len(value)} keys"
    if isinstance(value, list):
        return f"list of {len(value)}"
    text = json.dumps(value, ensure_ascii=False)
    return text if len(text) <= 60 else text[:57] + "..."


def json_file(path: str, raw: bytes) -> dict:
    text = decode(raw)
    data = json.loads(text)
    keys = data if isinstance(data, dict) else data[0] if isinstance(data, list) and isinstance((data or [None])[0], dict) else {}
    toc = [entry(str(k), 1, annotation=describe(v)) for k, v in keys.items()]
    full = whole(text)
    if full:
        chunks = [chunk(text, 0)]
    elif keys:
        chunks = [chunk(json.dumps({k: v}, indent=2, ensure_ascii=False), i, str(k)) for i, (k, v) in enumerate(keys.items())]
    else:
        chunks = [chunk(text[:2000], 0)]
    stats = {"key_count": key_count(data), "max_depth": max_depth(data), "root": type(data).__name__, "length": len(data) if isinstance(data, (list, dict)) else 1, "is_full_content": full}
    return probe("json", title=safe_name(path), toc=toc, schema_tree=schema_tree(data), stats=stats, chunks=chunks, snippet=text if full else text[:500], intro=f"JSON {safe_name(path)}: {describe(data)}")


def resolve(record: Any, path: str) -> Any:
    """Value at a dotted path of one record; see ``operators.records`` for the same over columns."""
    values, listed = [record], False
    for part in path.split("."):
        opened = []
        for v in values:
            if isinstance(v, list):
                listed = True
                opened += v
            else:
                opened.append(v)
        values = [v[part] for v in opened if isinstance(v, dict) and part in v]
        if not values:
            return MISSING
    if not listed:
        return values[0]
    return [x for v in values for x in (v if isinstance(v, list) else [v])]


def record_matches(record: Any, spec: dict) -> bool:
    """A record filter ``{field, op, value}`` on one record."""
    op, want, v = spec.get("op", "eq"), spec.get("value"), resolve(record, spec["field"])
    if op == "exists":
        return (v is not MISSING) == (True if want is None else bool(want))
    if v is MISSING:
        return False
    if op in ("in", "nin"):
        return ((not isinstance(v, list)) and v in want) == (op == "in")
    if op == "contains":
        return want in v if isinstance(v, list) else isinstance(v, str) and str(want) in v
    tests = {"eq": lambda x: x == want, "neq": lambda x: x != want, "gt": lambda x: x > want, "gte": lambda x: x >= want, "lt": lambda x: x < want, "lte": lambda x: x <= want, "regex": lambda x: re.search(str(want), str(x)) is not None}

    def test(x: Any) -> bool:
        try:
            return bool(tests[op](x))
        except TypeError:  # values of different kinds aren't ordered
            return False

    return any(map(test, v)) if isinstance(v, list) else test(v)


def extract_text(record: Any, path: str | None) -> str:
    if not path:
        return json.dumps(record, ensure_ascii=False)
    v = resolve(record, path)
    if v is MISSING or v is None:
        return ""
    if isinstance(v, list):
        return "\n".join(x for x in v if isinstance(x, str) and x.strip())
    return v if isinstance(v, str) else str(v)


def jsonl(path: str, raw: bytes, config: dict) -> dict:
    """Settings: ``filters, logic, text_field, label_field, timestamp_field, group_size, strip_patterns``."""
    records, bad = [], 0
    for line in decode(raw).split("\n"):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
        except ValueError:
            r = None
        if isinstance(r, dict):
            records.append(r)
        else:
            bad += 1
    specs, either = config.get("filters") or [], str(config.get("logic", "AND")).upper() == "OR"
    kept = [r for r in records if not specs or (any if either else all)(record_matches(r, s) for s in specs)]
    size, stamp = max(1, int(config.get("group_size", 1))), config.get("timestamp_field", "timestamp")
    chunks = []
    for at in range(0, len(kept), size):
        texts = []
        for r in kept[at : at + size]:
            t = extract_text(r, config.get("text_field"))
            for p in config.get("strip_patterns") or []:
                t = re.sub(p, "", t, flags=re.S).strip()
            label = resolve(r, config["label_field"]) if config.get("label_field") else MISSING
            if t.strip():
                texts.append(t if label in (MISSING, None, "") else f"{label}: {t}")
        if not texts:
            continue
        first = resolve(kept[at], stamp)
        meta = {"record_start": at, "record_end": min(at + size, len(kept)) - 1} | ({} if first is MISSING else {"timestamp": first})
        chunks.append(chunk("\n".join(texts), len(chunks), f"Records {at + 1}-{min(at + size, len(kept))}", **meta))
    n = len(chunks)
    shown = range(n) if n <= TOC_ALL else sorted({0, n // 2, n - 1})
    note = lambda c: f"ts: {c['metadata']['timestamp']}" if "timestamp" in c["metadata"] else None
    toc = [entry(chunks[i]["section"] if n <= TOC_ALL else f"{chunks[i]['section']} (sample, {i + 1} of {n} chunks)", 1, preview=chunks[i]["content"][:80], annotation=note(chunks[i])) for i in shown]
    stats = {"record_count": len(records), "matched": len(kept), "parse_errors": bad, "chunk_count": n}
    return probe("jsonl", title=safe_name(path), toc=toc, schema_tree=schema_tree(kept[0]) if kept else None, stats=stats, chunks=chunks, intro=f"JSON lines {safe_name(path)}, {len(records)} records")
