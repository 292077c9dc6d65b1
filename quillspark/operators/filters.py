"""Metadata predicates, compiled to Columns so that they reach the scan."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = tuple("eq neq gt gte lt lte in like between".split())
_NAME = re.compile(r"[A-Za-z_]\w*", re.ASCII)


@dataclass(frozen=True)
class MetadataFilter:
    """One comparison of a column with a value; invalid ones raise ``ValueError``."""

    field: str
    op: str = "eq"
    value: Any = None

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.field):
            raise ValueError(f"not a column name: {self.field!r}")
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPS)}")
        many, pair = (list, tuple, set, frozenset), (list, tuple)
        if not isinstance(self.value, many) and self.op == "in":
            raise ValueError("'in' takes a list, tuple or set")
        if self.op == "between" and not (isinstance(self.value, pair) and len(self.value) == 2):
            raise ValueError("'between' takes a pair")

    def column(self) -> Column:
        c, v = F.col(self.field), self.value
        if self.op == "in":
            return c.isin(sorted(v, key=repr)) if v else F.lit(False)
        if self.op == "between":
            return c.between(*v)
        if self.op == "like":
            return c.like(v)
        compare = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
        return compare[self.op](c, F.lit(v))


@dataclass(frozen=True)
class MetadataFilterSet:
    """Comparisons joined by AND or OR; an empty set is no predicate."""

    filters: Sequence[MetadataFilter] = field(default_factory=tuple)
    logic: str = "AND"

    def __post_init__(self) -> None:
        if self.logic.upper() not in ("AND", "OR"):
            raise ValueError("logic is AND or OR")

    def column(self) -> Column | None:
        if not self.filters:
            return None
        join = operator.and_ if self.logic.upper() == "AND" else operator.or_
        return functools.reduce(join, [f.column() for f in self.filters])


def build_filters(spec: Mapping[str, Any] | None) -> MetadataFilterSet:
    """``{"k": v}`` is equality, ``{"k": {"op": ..., "value": ...}}`` any comparison; all must hold."""
    out = []
    for k, v in (spec or {}).items():
        if isinstance(v, Mapping):
            if "value" not in v:
                raise ValueError(f"{k}: a comparison needs a value")
            out.append(MetadataFilter(k, v.get("op", "eq"), v["value"]))
        else:
            out.append(MetadataFilter(k, "eq", v))
    return MetadataFilterSet(tuple(out))


def apply_filters(df: DataFrame, filters: MetadataFilterSet | Mapping[str, Any] | None) -> DataFrame:
    if filters is None or isinstance(filters, Mapping):
        filters = build_filters(filters)
    c = filters.column()
    return df if c is None else df.where(c)


def source_scope(source: Column | str, wanted: str) -> Column:
    """Equality, or a prefix where ``wanted`` ends in ``*``; both are pushed to the scan."""
    c = F.col(source) if isinstance(source, str) else source
    return c.startswith(wanted[:-1]) if wanted.endswith("*") else c == wanted


def resolve_prefix(df: DataFrame, prefix: str, id_col: str = "doc_id") -> str | None:
    """The one id that begins with ``prefix``; None without any, ``ValueError`` with several."""
    if not prefix:
        return None
    found = [r[0] for r in df.where(F.col(id_col).startswith(prefix)).select(id_col).distinct().limit(2).collect()]
    exact = [x for x in found if x == prefix]
    if len(found) > 1 and not exact:
        raise ValueError(f"{prefix!r} is the beginning of several ids")
    return (exact or found or [None])[0]


def exists(df: DataFrame, **equal: Any) -> bool:
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return not df.limit(1).isEmpty()
