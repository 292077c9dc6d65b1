"""Vector arithmetic over arrays, without Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in double precision, summed in order."""
    parts = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def deterministic_embedding(text: Column | str, dim: int = 8) -> Column:
    """A stand-in embedding: from b, the sum of code points modulo 97, components ``((b + i) mod 17) / 17``."""
    total = F.aggregate(F.split(col(text), ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))
    # the sum is bound to a variable, so that the text is read once and not for each component
    return F.transform(F.array(total % 97), lambda base: F.array(*[((base + i) % 17).cast("double") / F.lit(17.0) for i in range(dim)]))[0]


def is_close(a: Column, b: Column) -> Column:
    """Equal to a relative 1e-9."""
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))
