"""Tables of contents: sections own what follows them until a heading of their level or above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_level(toc: DataFrame, partition: str, level: str) -> DataFrame:
    """A row for each entry and each level ``__l`` that its document has, from the entry's own down; an entry without
    a level has one row. The work is entries by levels of their document."""
    known = toc.groupBy(F.col(partition).alias("__p")).agg(F.collect_set(level).alias("__levels"))
    at = F.filter("__levels", lambda x: x >= F.col(level))
    return toc.join(known, F.col(partition) == F.col("__p")).withColumn("__l", F.explode_outer(at)).drop("__p", "__levels")


def with_ends(toc: DataFrame, partition: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds ``end_pos``: the next entry of the same level or above, or none.

    One ordered pass for each document and level gives every entry the next of those entries, so that nothing is
    joined by range and no array holds a document. Positions are whole numbers.
    """
    later = Window.partitionBy(partition, "__l").orderBy(F.desc(pos)).rangeBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("__l").isNotNull() & F.col(pos).isNotNull(), F.min(pos).over(later))
    ends = _by_level(toc, partition, level).withColumn("end_pos", end)
    return ends.where(F.col("__l").isNull() | (F.col("__l") == F.col(level))).drop("__l")


def matches(title: Column, wanted: Column) -> Column:
    """Equal, or either inside the other, whatever the case; empty names match nothing."""
    a, b = F.lower(F.trim(title)), F.lower(F.trim(wanted))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def _pieces(long: DataFrame, short: DataFrame) -> DataFrame:
    """``(__d, __n, __k)``: of each name of the first table all substrings of the lengths that the second table's
    names have in its document. They meet those names by equality, so the work grows with the names, not with their
    product."""
    sizes = short.groupBy("__d").agg(F.collect_set(F.length("__k")).alias("__sizes"))
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.length("__k") - n + 1), lambda i: F.substring(F.col("__k"), i, n))
    every = F.array_distinct(F.flatten(F.transform(F.filter("__sizes", lambda n: n <= F.length("__k")), cuts)))
    return long.join(sizes, "__d").select("__d", "__n", F.explode(every).alias("__k"))


def _names(df: DataFrame, partition: str, name: str) -> DataFrame:
    """Distinct names of each document, ``__n``, and what of them is compared, ``__k``; empty ones are left out."""
    names = df.select(F.col(partition).alias("__d"), F.col(name).alias("__n")).distinct()
    return names.withColumn("__k", F.lower(F.trim("__n"))).where("__k <> ''")


def expand(toc: DataFrame, wanted: DataFrame, partition: str = "doc_id", pos: str = "pos", level: str = "level", title: str = "title") -> DataFrame:
    """Sections that the ``(doc_id, section)`` rows of ``wanted`` name, each with all its descendants, once.

    Sections found are ranges of the document's numbered positions; those inside another are left out, the rest are
    opened into their numbers, and entries are taken by number: the work is that of the entries and the result.
    """
    numbered = toc.withColumn("__no", F.dense_rank().over(Window.partitionBy(partition).orderBy(F.col(pos).asc_nulls_last()))).where(F.col(pos).isNotNull())
    size = F.max("__no").over(Window.partitionBy(partition)) + 1
    ends = with_ends(numbered, partition, "__no", level).select(F.col(partition).alias("__d"), F.col(title).alias("__n"), F.col("__no").alias("__lo"), F.coalesce("end_pos", size).alias("__hi"))
    titles, wants = _names(toc, partition, title), _names(wanted, partition, "section")
    of = lambda a, b: a.join(b.withColumnRenamed("__n", "__m"), ["__d", "__k"])
    named = of(_pieces(titles, wants), wants).select("__d", "__n", F.col("__m").alias("__want"))
    named = named.union(of(_pieces(wants, titles), titles).select("__d", "__m", "__n")).distinct()
    hit = ends.join(named, ["__d", "__n"]).select("__d", "__want", "__lo", "__hi").distinct()
    before = Window.partitionBy("__d", "__want").orderBy("__lo", F.desc("__hi")).rowsBetween(Window.unboundedPreceding, -1)
    outer = hit.withColumn("__seen", F.coalesce(F.max("__hi").over(before), F.lit(0))).where(F.col("__hi") > F.col("__seen"))
    opened = outer.select("__d", "__want", F.explode(F.sequence(F.greatest("__lo", "__seen"), F.col("__hi") - 1)).alias("__at"))
    found = numbered.join(opened, (F.col(partition) == F.col("__d")) & (F.col("__no") == F.col("__at")))
    return found.select(*toc.columns, F.col("__want").alias("wanted")).distinct()


def chunks_of(chunks: DataFrame, sections: DataFrame, partition: str = "doc_id") -> DataFrame:
    """Chunks whose section matches one of the ``(doc_id, title)`` rows, each once. Names are matched before chunks."""
    have, want = _names(chunks, partition, "section"), _names(sections, partition, "title")
    key = ["__d", "__k"]
    longer = _pieces(have, want).join(want, key, "left_semi").select("__d", "__n")
    found = longer.union(have.join(_pieces(want, have), key, "left_semi").select("__d", "__n")).distinct()
    return chunks.join(found, (F.col(partition) == F.col("__d")) & (F.col("section") == F.col("__n")), "left_semi")


def chunks_exact(chunks: DataFrame, names: list[str]) -> DataFrame:
    """Chunks whose section is one of the names, whatever the case."""
    return chunks.where(F.lower("section").isin([n.lower() for n in names]))


def section_path(toc: DataFrame, partition: str = "doc_id", pos: str = "pos", level: str = "level", title: str = "title") -> DataFrame:
    """Adds ``path``: the titles from the top down to each entry."""
    entries = toc.groupBy(partition).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(level).alias("l"), F.col(title).alias("t")))).alias("__all"))
    before = F.filter("__all", lambda x: x["p"] < F.col(pos))
    # walking back, an entry is an ancestor when its level is below all seen so far
    start = F.struct(F.col(level).cast("int").alias("l"), F.array(F.col(title)).alias("path"))
    step = lambda s, x: F.when(x["l"] < s["l"], F.struct(x["l"].cast("int").alias("l"), F.concat(F.array(x["t"]), s["path"]).alias("path"))).otherwise(s)
    walked = F.aggregate(F.reverse(before), start, step, lambda s: s["path"])
    return toc.join(entries, partition).withColumn("path", F.array_join(walked, " > ")).drop("__all")


def forward_fill(df: DataFrame, value: str, partition: list[str], order: str, name: str) -> DataFrame:
    """The last value at or before each row."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
