"""Shell-style patterns as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """``* ? [seq] [!seq]``, matched against a whole string."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out) + "$"


def glob_regex(pattern: Column) -> Column:
    """The same for a column of patterns."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    stars = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), F.replace(stars, F.lit("[!"), F.lit("[^")), F.lit("$"))


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(glob_to_regex(pattern))


def ignored(path: Column, patterns: list[str]) -> Column:
    """A path whose name matches a pattern, or one of whose segments equals it."""
    name, parts = F.element_at(F.split(path, "/"), -1), F.split(path, "/")
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(name, p) | F.array_contains(parts, p)
    return hit
