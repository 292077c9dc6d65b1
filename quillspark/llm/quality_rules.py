"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each rule names a metric and the range that it must lie in. All metrics are
columns of one projection over two arrays, the words and the lines of a text,
which are split once, and one class-mapped copy of it; no user function runs. A document passes when it breaks
no rule. No metric changes its definition with a text's size: the stop-word
ratio is smoothed, (stop words + 1) / (words + 1), so that a text of a few words
can't show a lack of them, and the variety of words is the logarithm of the
number of different words over that of all words, which, unlike their ratio,
stays level as a text of one kind grows. A metric that is undefined, as every
ratio of an empty text and the variety of a single word are, breaks no rule;
empty and null texts fail ``n_words`` alone.

Words are runs of characters other than ASCII white space; lines are separated
by ``\\n`` and count where they hold more than white space. Repeated rows are
judged each, an empty table gives an empty result, and columns beside id and
text are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words of the four languages; a text without any is no prose.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by be this are or an not at from which "
    "der die das und in zu den von mit ist des sich dem ein eine nicht auf für als auch "
    "le la les de et un une des du en est que qui dans pour au avec ce sur pas par "
    "el los las y en del se por un una con para no su al lo como más que"
).split()
SYMBOLS = "#$%&*@^|~<>{}[]\\_=+"


@dataclass(frozen=True)
class Rule:
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("n_words", low=1, high=1_000_000),
    Rule("mean_word_chars", high=16.0),
    Rule("symbol_ratio", high=0.10),
    Rule("digit_ratio", high=0.60),
    Rule("upper_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.03),
    Rule("word_variety", low=0.65),
    Rule("repeated_line_ratio", high=0.60),
    Rule("bullet_line_ratio", high=0.90),
    Rule("ellipsis_line_ratio", high=0.50),
)


_SPACES, _DIGITS, _CAPITALS = " \t\n\r\f\x0b", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Whole numbers behind the metrics, each computed once."""
    # one pass maps every class of characters to its first and drops white space; the rest is byte search
    classes = F.translate(text, SYMBOLS + _DIGITS + _CAPITALS + _SPACES, SYMBOLS[0] * len(SYMBOLS) + "0" * 10 + "A" * 26)
    return {"__classes": classes, "__chars": F.length(text), "__n": F.size(words), "__lines": F.size(lines), "__stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))), "__words": F.size(F.array_distinct(words)), "__kinds": F.size(F.array_distinct(lines))}


def metrics(lines: Column) -> dict[str, Column]:
    """Every metric as a column over ``counts``, all doubles but for the first two."""
    n_words, n_lines, solid = F.col("__n"), F.col("__lines"), F.col("__solid")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part.cast("double") / whole, 6))

    return {
        "n_chars": F.col("__chars").cast("long"),
        "n_words": n_words.cast("long"),
        "mean_word_chars": ratio(solid, n_words),
        "symbol_ratio": ratio(solid - F.col("__symbols"), solid),
        "digit_ratio": ratio(solid - F.col("__digits"), solid),
        "upper_ratio": ratio(solid - F.col("__upper"), solid),
        "stop_word_ratio": F.when(n_words > 0, ratio(F.col("__stop") + 1, n_words + 1)),
        "word_variety": F.when(n_words > 1, F.round(F.log(F.col("__words")) / F.log(n_words), 6)),
        "repeated_line_ratio": ratio(n_lines - F.col("__kinds"), n_lines),
        "bullet_line_ratio": ratio(F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))), n_lines),
        "ellipsis_line_ratio": ratio(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))), n_lines),
    }


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, every metric, the names of the broken rules, and ``keep``, for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t"))
    base = base.select("*", F.filter(F.split("__t", r"[ \t\n\r\f\x0B]+"), lambda w: w != "").alias("__w"), F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != "").alias("__x"))
    numbers = base.select("doc_id", "__x", *[c.alias(n) for n, c in counts(F.col("__t"), F.col("__w"), F.col("__x")).items()])
    without = lambda c: F.length(F.replace("__classes", F.lit(c)))
    numbers = numbers.select("*", F.length("__classes").alias("__solid"), without(SYMBOLS[0]).alias("__symbols"), without("0").alias("__digits"), without("A").alias("__upper"))
    values = numbers.select("doc_id", *[c.alias(n) for n, c in metrics(F.col("__x")).items()])

    def broken(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        return F.when(bad, F.lit(r.metric))

    failed = F.concat_ws(",", *[broken(r) for r in rules])
    return values.select("*", failed.alias("broken_rules"), (failed == "").alias("keep"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    quoted = SYMBOLS.replace("'", "''")
    less = lambda chars: f"length(translate(t, '{chars}', ''))"
    solid = "length(translate(t, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11), ''))"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / ({b}), 6) END"
    cols = {
        "n_chars": "length(t)",
        "n_words": "len(w)::BIGINT",
        "mean_word_chars": ratio(solid, "len(w)"),
        "symbol_ratio": ratio(f"length(t) - {less(quoted)}", solid),
        "digit_ratio": ratio(f"length(t) - {less('0123456789')}", solid),
        "upper_ratio": ratio(f"length(t) - {less('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}", solid),
        "stop_word_ratio": f"CASE WHEN len(w) > 0 THEN round((len(list_filter(w, lambda v: lower(v) IN ({stop}))) + 1)::DOUBLE / (len(w) + 1), 6) END",
        "word_variety": "CASE WHEN len(w) > 1 THEN round(ln((SELECT count(DISTINCT v) FROM unnest(w) u(v))) / ln(len(w)), 6) END",
        "repeated_line_ratio": ratio("len(x) - len(list_distinct(x))", "len(x)"),
        "bullet_line_ratio": ratio("len(list_filter(x, lambda v: substring(ltrim(v), 1, 1) IN ('-', '*', '•')))", "len(x)"),
        "ellipsis_line_ratio": ratio("len(list_filter(x, lambda v: suffix(rtrim(v), '...')))", "len(x)"),
    }
    tests = []
    for r in rules:
        bad = " OR ".join([f"{r.metric} < {r.low!r}"] * (r.low is not None) + [f"{r.metric} > {r.high!r}"] * (r.high is not None))
        tests.append(f"CASE WHEN {bad} THEN '{r.metric}' END")
    return f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+') AS w, list_filter(string_split(t, chr(10)), lambda v: trim(v) <> '') AS x FROM b),
m AS (SELECT doc_id, {', '.join(f'{c} AS {n}' for n, c in cols.items())} FROM s),
f AS (SELECT *, concat_ws(',', {', '.join(tests)}) AS broken_rules FROM m)
SELECT *, broken_rules = '' AS keep FROM f"""
