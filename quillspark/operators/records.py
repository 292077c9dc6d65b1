"""Predicates on nested JSON records, evaluated over VARIANT values in the JVM.

A path's segments are joined by dots. Where a segment meets a list of objects,
the rest of the path is taken from each of them, and lists met on the way are
flattened by one level. JSON null is a value; only an absent key is missing,
and a missing value fails every comparison but ``exists: false``.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = tuple("eq neq in nin gt gte lt lte exists regex contains".split())
_MANY = "array<variant>"


def check_path(path: str) -> list[str]:
    parts = path.split(".")
    if any(not p or (p.startswith("__") and p.endswith("__")) for p in parts):
        raise ValueError(f"not a valid path: {path!r}")
    return parts


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that has the value: however often it names the variable, the value is computed once."""
    return F.transform(F.array(value), body)[0]


def _open(values: Column, listed: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of the values with lists among them replaced by their members, and of whether there were lists."""
    lists = F.transform(values, lambda v: F.try_variant_get(v, "$", _MANY))

    def opened(x: Column) -> Column:
        flat = F.flatten(F.zip_with(values, x, lambda v, inner: F.coalesce(inner, F.array(v))))
        return then(flat, listed | F.coalesce(F.exists(x, lambda inner: inner.isNotNull()), F.lit(False)))

    return _let(lists, opened)


def _pair(values: Column, listed: Column) -> Column:
    return F.struct(values.alias("values"), listed.alias("listed"))


def _step(found: Column, part: str) -> Column:
    """Values under a key. Lists on the way are opened before their members' key is taken."""
    key = "$['" + part.replace("'", "\\'") + "']"

    def taken(opened: Column, listed: Column) -> Column:
        got = F.filter(F.transform(opened, lambda v: F.try_variant_get(v, key, "variant")), lambda v: v.isNotNull())
        return _let(got, lambda g: _pair(F.when(F.size(g) > 0, g), listed))

    return _let(found, lambda s: _open(s["values"], s["listed"], taken))


def _found(record: Column, path: str) -> Column:
    """What ``resolve`` gives, as one struct; a caller binds it by ``_let``."""
    start = _let(record, lambda r: _pair(F.when(r.isNotNull(), F.array(r)), F.lit(False)))
    found = functools.reduce(_step, check_path(path), start)
    return _let(found, lambda s: _open(s["values"], s["listed"], _pair))


def resolve(record: Column, path: str) -> tuple[Column, Column]:
    """Values at the path as ``array<variant>``, null where it is missing, and whether they came from a list."""
    found = _found(record, path)
    return found["values"], found["listed"]


def _same(v: Column, value: Any) -> Column:
    if value is None:
        return F.is_variant_null(v)
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        number = _let(kind, lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))
        return number & (F.try_variant_get(v, "$", "double") == float(value))
    return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == str(value))


def _ordered(v: Column, value: Any, op: str) -> Column:
    compare = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op]
    if isinstance(value, str):
        return (F.schema_of_variant(v) == "STRING") & compare(F.try_variant_get(v, "$", "string"), F.lit(value))
    number = _let(F.schema_of_variant(v), lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))
    return number & compare(F.try_variant_get(v, "$", "double"), F.lit(float(value)))


@dataclass(frozen=True)
class RecordFilter:
    field: str
    op: str = "eq"
    value: Any = None

    def __post_init__(self) -> None:
        check_path(self.field)
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPS)}")
        several = (list, tuple, set, frozenset)
        if self.op.endswith("in") and not isinstance(self.value, several):
            raise ValueError(f"{self.op!r} takes a list")

    def column(self, record: Column) -> Column:
        """Whether a VARIANT column's record matches."""
        return _let(_found(record, self.field), lambda s: self._holds(s["values"], s["listed"]))

    def _holds(self, values: Column, listed: Column) -> Column:
        there = values.isNotNull()
        if self.op == "exists":
            return there == F.lit(True if self.value is None else bool(self.value))
        v = self.value
        any_of = lambda test: F.coalesce(F.exists(values, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
        if self.op == "eq":
            hit = any_of(lambda x: _same(x, v))
        elif self.op == "neq":
            hit = any_of(lambda x: ~F.coalesce(_same(x, v), F.lit(False)))
        elif self.op in ("in", "nin"):
            among = any_of(lambda x: functools.reduce(operator.or_, [F.coalesce(_same(x, w), F.lit(False)) for w in sorted(v, key=repr)], F.lit(False)))
            among = among & ~listed  # a list as such is none of the values
            hit = among if self.op == "in" else ~among
        elif self.op == "regex":
            hit = any_of(lambda x: F.try_variant_get(x, "$", "string").rlike(str(v)))
        elif self.op == "contains":
            inside = any_of(lambda x: (F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").contains(str(v)))
            hit = F.when(listed, any_of(lambda x: _same(x, v))).otherwise(inside)
        else:
            hit = any_of(lambda x: _ordered(x, v, self.op))
        return there & hit


@dataclass(frozen=True)
class RecordFilterSet:
    filters: Sequence[RecordFilter] = ()
    logic: str = "AND"

    @classmethod
    def from_dicts(cls, specs: Sequence[Mapping[str, Any]], logic: str = "AND") -> RecordFilterSet:
        return cls(tuple(RecordFilter(s["field"], s.get("op", "eq"), s.get("value")) for s in specs), logic)

    def column(self, record: Column) -> Column:
        if not self.filters:
            return F.lit(True)
        join = operator.and_ if self.logic.upper() == "AND" else operator.or_
        return _let(record, lambda r: functools.reduce(join, [f.column(r) for f in self.filters]))


def parse(text: Column | str) -> Column:
    """A JSON object as VARIANT; null for bad JSON and for other values."""
    v = F.try_parse_json(F.col(text) if isinstance(text, str) else text)
    return _let(v, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), x))


def literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def texts(record: Column, path: str) -> Column:
    """Strings at a path, other scalars as strings, blank members of lists left out, joined by line breaks."""

    def joined(values: Column, listed: Column) -> Column:
        as_text = F.transform(values, lambda v: F.when(F.is_variant_null(v), F.lit(None)).otherwise(F.try_variant_get(v, "$", "string")))
        return F.array_join(F.filter(as_text, lambda x: x.isNotNull() & (~listed | (F.trim(x) != ""))), "\n")

    return F.coalesce(_let(_found(record, path), lambda s: joined(s["values"], s["listed"])), F.lit(""))
