"""Configuration files: YAML, TOML, INI."""

from __future__ import annotations

import configparser
from typing import Any

from .base import chunk, decode, entry, probe, safe_name, suffix_of, whole
from .json_files import describe, key_count, max_depth, schema_tree

FULL_CHARS, SNIPPET_CHARS, DEPTH = 2000, 500, 3


def parse_config(kind: str, text: str) -> dict:
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs the yaml package") from e
        data = yaml.safe_load(text)
        if not isinstance(data, dict):
            data = dict(root=data)
        return data
    if kind == "toml":
        import tomllib

        return tomllib.loads(text)
    ini = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    try:
        ini.read_string(text)
    except configparser.MissingSectionHeaderError:
        ini.read_string("[DEFAULT]\n" + text)
    own = {s: {k: v for k, v in ini[s].items() if k not in ini.defaults() or ini.defaults()[k] != v} for s in ini.sections()}
    return ({"DEFAULT": dict(ini.defaults())} if ini.defaults() else {}) | own


def _walk(data: Any, level: int = 1) -> list[dict]:
    if not isinstance(data, dict) or level > DEPTH:
        return []
    return [x for k, v in data.items() for x in (entry(str(k), level, annotation=describe_safe(v)), *_walk(v, level + 1))]


def describe_safe(v: Any) -> str:
    try:
        return describe(v)
    except TypeError:
        return str(v)[:60]


def config(path: str, raw: bytes) -> dict:
    text = decode(raw)
    kind = suffix_of(path)
    data = parse_config(kind, text)
    full = whole(text)
    stats = {"format": kind, "key_count": key_count(data), "max_depth": max_depth(data), "is_full_content": full}
    body = text if full else text[:FULL_CHARS]
    return probe("config", title=safe_name(path), toc=_walk(data), schema_tree=schema_tree(data), stats=stats, chunks=[chunk(body, 0)] if body.strip() else [], snippet=text if full else text[:SNIPPET_CHARS], intro=f"Configuration {safe_name(path)}, {stats['key_count']} keys")
