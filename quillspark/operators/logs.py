"""Log lines: format vote, levels, time range, keywords, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b"
LEVEL_ORDER = tuple("FATAL CRITICAL ERROR WARNING WARN INFO DEBUG TRACE".split())
_CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
#: ISO, syslog, common log format, epoch seconds.
TIMES = (
    r"[0-9]{4}(?:-[0-9]{2}){2}[ T]" + _CLOCK + r"(?:[,.][0-9]+)?(?:[+-][0-9]{2}:?[0-9]{2}|Z)?",
    r"[A-Z][a-z]{2}[ ]+[0-9]{1,2}[ ]+" + _CLOCK,
    r"[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:" + _CLOCK,
    r"\b1[0-9]{9}(?:[.][0-9]+)?\b",
)
STOP = ("the and for with from this that have has been was were are not but you your its into out about will can all any new get set via per when then than our").split()


def format_vote(lines: DataFrame, partition: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """``format`` of each partition by its first ten non-blank lines: jsonl over 70 %, else syslog, apache or iso over
    half, else custom."""
    w = Window.partitionBy(*partition).orderBy(order)
    first = lines.where(F.trim(text) != "").withColumn("__rn", F.row_number().over(w)).where("__rn <= 10")
    share = lambda c: F.avg(c.cast("int"))
    t = F.trim(text)
    votes = first.groupBy(*partition).agg(
        share(t.startswith("{") & t.endswith("}")).alias("j"),
        share(F.col(text).rlike(r"^" + TIMES[1])).alias("s"),
        share(F.col(text).rlike(r"\[" + TIMES[2])).alias("a"),
        share(F.col(text).rlike(r"^\[?" + TIMES[0])).alias("i"),
    )
    kind = F.when(F.col("j") > 0.7, "jsonl").when(F.col("s") > 0.5, "syslog").when(F.col("a") > 0.5, "apache").when(F.col("i") > 0.5, "iso").otherwise("custom")
    return votes.select(*partition, kind.alias("format"))


def levels(lines: DataFrame, partition: list[str], text: str = "line") -> DataFrame:
    """``(level, n)``: every level word of every line, WARNING counted as WARN."""
    words = lines.select(*partition, F.explode(F.regexp_extract_all(text, F.lit(LEVEL), F.lit(1))).alias("w"))
    name = F.upper("w")
    return words.groupBy(*partition, F.when(name == "WARNING", "WARN").otherwise(name).alias("level")).agg(F.count("*").alias("n"))


def time_range(lines: DataFrame, partition: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """First and last timestamp: of the first pattern that any of the first, or last, 20 lines has."""

    def pick(ascending: bool, name: str) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(F.asc(order) if ascending else F.desc(order))
        near = lines.withColumn("__rn", F.row_number().over(w)).where("__rn <= 20")
        found = [F.min_by(F.regexp_extract(text, p, 0), F.when(F.col(text).rlike(p), F.col("__rn"))) for p in TIMES]
        return near.groupBy(*partition).agg(F.coalesce(*found).alias(name))

    return pick(True, "first_time").join(pick(False, "last_time"), partition)


def keywords(lines: DataFrame, partition: list[str], order: str = "line_no", text: str = "line", n: int = 10) -> DataFrame:
    """The n most frequent words of three letters or more, times, levels and stop words left out; of equally frequent
    ones those that come first."""
    bare = F.regexp_replace(F.regexp_replace(text, TIMES[0], " "), LEVEL, " ")
    words = lines.select(*partition, order, F.posexplode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))).alias("__p", "w"))
    words = words.select(*partition, F.lower("w").alias("keyword"), F.struct(F.col(order), F.col("__p")).alias("at")).where(~F.col("keyword").isin(STOP))
    counts = words.groupBy(*partition, "keyword").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(*partition).orderBy(F.desc("n"), "at")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("at")


def error_samples(lines: DataFrame, partition: list[str], order: str = "line_no", text: str = "line", n: int = 5) -> DataFrame:
    """The first n lines with an ERROR or FATAL."""
    w = Window.partitionBy(*partition).orderBy(order)
    return lines.where(F.col(text).rlike(r"(?i)\b(ERROR|FATAL)\b")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
