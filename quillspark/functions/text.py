"""Text functions as Columns. Lengths count code points throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts below this many tokens are kept whole instead of being cut into chunks.
WHOLE_BELOW = 2000
#: Longest text that is embedded, in tokens and in characters.
EMBED_TOKENS, EMBED_CHARS = 6000, 18_000
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text: Column | str) -> Column:
    """A third of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 3)).cast("long")


def embed_tokens(text: Column | str) -> Column:
    """A third of the characters."""
    return F.floor(F.length(col(text)) / 3).cast("long")


def fits_whole(text: Column | str, limit: int = WHOLE_BELOW) -> Column:
    return estimate_tokens(text) < limit


def preview(text: Column | str, size: int = 120) -> Column:
    """First line that is neither blank nor starts with ``#``, cut at a word and marked where longer than ``size``."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.trim(x))
    first = F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(1))
    cut = F.concat(F.regexp_replace(F.left(first, F.lit(size)), r" [^ ]*$", ""), F.lit("..."))
    return F.coalesce(F.when(F.length(first) > size, cut).otherwise(first), F.lit(""))


def shorten(text: Column | str, head: int, tail: int) -> Column:
    """Head and tail of a text that is more than five characters longer than both."""
    t = col(text)
    short = F.concat(F.left(t, F.lit(head)), F.lit("..."), F.right(t, F.lit(tail)), F.lit(" (Len: "), F.length(t).cast("string"), F.lit(")"))
    return F.when(F.length(t) > head + tail + 5, short).otherwise(t)


def format_size(size: Column | str, largest: str = "TB") -> Column:
    """Bytes in words: whole below 1 KB, else one decimal, in units up to the largest, which takes all above it."""
    n = col(size).cast("double")
    one = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**power), 1))
    units = ("B", "KB", "MB", "GB", "TB")
    top = units.index(largest)
    if top == 0:
        return F.format_string("%d B", col(size).cast("long"))
    out = one(largest, top)
    for power in range(top - 1, 0, -1):
        out = F.when(n < 1024.0 ** (power + 1), one(units[power], power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", col(size).cast("long"))).otherwise(out)


def format_seconds(seconds: Column | str) -> Column:
    """Milliseconds below one second, else seconds with two decimals."""
    s = col(seconds).cast("double")
    return F.when(s < 1, F.format_string("%.0fms", s * 1000)).otherwise(F.format_string("%.2fs", s))


def has_cjk(text: Column | str) -> Column:
    return col(text).rlike(CJK)


def strip_tags(html: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(html), r"<[^>]+>", ""))


def strip_patterns(text: Column | str, patterns: list[str]) -> Column:
    """Removes every match of the patterns, with ``.`` over lines too, and trims."""
    t = col(text)
    for p in patterns:
        t = F.regexp_replace(t, "(?s)" + p, "")
    return F.trim(t)


def labelled(text: Column | str, label: Column | str) -> Column:
    """``label: text`` where the label is neither null nor empty."""
    tag = col(label)
    return F.when(tag.isNull() | (tag == ""), col(text)).otherwise(F.concat(tag, F.lit(": "), col(text)))


def first_paragraph(text: Column | str, enough: int = 100) -> Column:
    """Lines joined by a space until they pass ``enough`` characters, a blank line or a heading; leading ones skip."""
    state = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        x = F.trim(line)
        stop = (x == "") | x.startswith("#")
        grown = F.when(s["t"] == "", x).otherwise(F.concat(s["t"], F.lit(" "), x))
        t = F.when(s["done"] | stop, s["t"]).otherwise(grown)
        return F.struct(t.alias("t"), (s["done"] | (stop & (s["t"] != "")) | (F.length(t) > enough)).alias("done"))

    return F.aggregate(F.split(col(text), "\n"), state, step, lambda s: s["t"])


def brief_intro(title: Column | str, abstract: Column | str, paragraph: Column | str, intro: Column | str) -> Column:
    """Title, and the abstract or the opening of the first paragraph, before a probe's own introduction."""
    p = col(paragraph)
    opening = F.when(F.length(p) > 150, F.concat(F.left(p, F.lit(147)), F.lit("..."))).otherwise(p)
    blank = lambda c: F.when(F.trim(col(c)) != "", col(c))
    head = F.concat_ws(" — ", blank(title), F.coalesce(blank(abstract), F.when(F.trim(opening) != "", opening)))
    return F.concat_ws("\n\n", F.when(head != "", head), blank(intro))


def embed_text(text: Column | str) -> Column:
    """Text cut to what an embedding model takes."""
    return F.when(embed_tokens(text) > EMBED_TOKENS, F.left(col(text), F.lit(EMBED_CHARS))).otherwise(col(text))


def suffix(path: Column | str) -> Column:
    """Lower-case extension without its dot; ``tar.gz`` and its kin are one."""
    p = F.lower(col(path))
    double = F.regexp_extract(p, r"\.(tar\.(?:gz|bz2|xz))$", 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(p, r"\.([^./]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def lexical_overlap(query: Column | str, text: Column | str) -> Column:
    """Share of the query's distinct characters that the text has: a rerank score without a model."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.lower(col(c)), ""), lambda x: F.trim(x) != ""))
    q = chars(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, chars(text))).cast("double") / F.size(q)).otherwise(0.0)


#: Words of a question that ask for an action or a place, and words of a text that answer it.
HINTS = ((("做什么", "干什么"), ("正在", "开", "谈", "做")), (("什么地方", "在哪", "哪里"), ("在", "酒店", "机场", "家", "公司")))


def lexical_baseline(query: str, text: Column | str) -> Column:
    """Number of the query's distinct characters that the text has, and 2 for each hint that it answers."""
    c = F.coalesce(col(text), F.lit(""))
    score = sum((F.contains(c, F.lit(x)).cast("double") for x in sorted(set(query))), F.lit(0.0))
    for asked, answers in HINTS:
        if any(a in query for a in asked):
            score = score + F.when(F.exists(F.array(*[F.lit(a) for a in answers]), lambda a: F.contains(c, a)), 2.0).otherwise(0.0)
    return score
