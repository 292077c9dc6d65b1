"""Text formats: Markdown, HTML, logs, calendars."""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.logs import LEVEL, LEVEL_ORDER, STOP, TIMES
from .base import chunk, decode, entry, preview, probe, safe_name, tokens, whole

HEADING = r"^(#{1,6})[ \t]+(.*)$"
FENCE = r"^\s*(```|~~~)"
FRAGMENT_DENSITY, FRAGMENT_TOKENS = 0.25, 3000

# --- Markdown as DataFrames ---


def markdown_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per line with ``in_fence``, ``level`` (0: no heading), ``title`` and the running ``section_no``.

    A fence that is never closed lasts to the end. Headings inside fences are text.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    mark = F.col("line").rlike(FENCE)
    before = F.coalesce(F.sum(mark.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("in_fence", mark | (before % 2 == 1))
    level = F.when(~F.col("in_fence"), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    lines = lines.withColumn("level", level.cast("int")).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", HEADING, 2))))
    return lines.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w).cast("int"))


def markdown_toc(lines: DataFrame) -> DataFrame:
    """Headings in order, with the line where each section ends."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.where("level > 0").select("doc_id", F.row_number().over(w).alias("pos"), "level", "title", "line_no", F.lead("line_no").over(w).alias("next_line"))


def markdown_sections(lines: DataFrame) -> DataFrame:
    """A row per section with its text, heading included; text before the first heading is ``preamble``."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    s = lines.groupBy("doc_id", "section_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("content"), F.max("title").alias("title"))
    return s.where((F.col("section_no") > 0) | (F.trim("content") != "")).withColumn("section", F.coalesce("title", F.lit("preamble"))).drop("title")


def markdown_density(lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("doc_id").agg(F.count_if(F.col("level") > 0).alias("headings"), F.count("*").alias("lines"))
    return counts.withColumn("density", F.round(F.col("headings") / F.greatest(F.col("lines"), F.lit(1)), 3))


def section_annotation(text: Column) -> Column:
    """Counts of list items, code blocks, links and lines, those that are there."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    part = lambda k, name: F.when(k > 0, F.concat(k.cast("string"), F.lit(" " + name)))
    return F.concat_ws(" | ", part(n(r"(?m)^\s*([*+-]|[0-9]+\.)[ \t]+"), "list items"), part(F.floor(n(r"(?m)^\s*(?:```|~~~)") / 2), "code blocks"), part(n(r"\[[^\]]*\]\([^)]*\)"), "links"), part(n(r"(?m)^.*\S.*$"), "lines"))


# --- HTML as Columns ---


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title\b[^<>]*>([\s\S]*?)</title\s*>", 1))


def html_meta(html: Column, name: str) -> Column:
    """A meta tag's content, whichever attribute comes first."""
    a = F.regexp_extract(html, rf"(?is)<meta[^>]+name=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+name=[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), b)


def html_headings(html: Column) -> Column:
    """``ARRAY<STRUCT<level, title>>`` in order."""
    levels = F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b[^<>]*>([\s\S]*?)</h\1\s*>"), F.lit(1))
    titles = F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b[^<>]*>([\s\S]*?)</h\1\s*>"), F.lit(2))
    clean = F.transform(titles, lambda t: F.trim(F.regexp_replace(t, r"<[^>]+>", "")))
    return F.transform(F.arrays_zip(levels.alias("l"), clean.alias("t")), lambda x: F.struct(x["l"].cast("int").alias("level"), x["t"].alias("title")))


def html_nav_links(html: Column) -> Column:
    """Texts of the links of the first ``nav``."""
    nav = F.regexp_extract(html, r"(?i)<nav\b[^<>]*>([\s\S]*?)</nav\s*>", 1)
    links = F.regexp_extract_all(nav, F.lit(r"(?i)<a\b[^<>]*>([\s\S]*?)</a\s*>"), F.lit(1))
    return F.filter(F.transform(links, lambda t: F.trim(F.regexp_replace(t, r"<[^>]+>", ""))), lambda t: t != "")


def html_counts(html: Column) -> Column:
    """Counts of paragraphs, links, list items, images and tables."""
    n = lambda tag: F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]")).cast("long")
    return F.struct(*[n(t).alias(t) for t in ("p", "a", "li", "img", "table")])


def html_text(html: Column) -> Column:
    """Main text: scripts, styles, navigation and footers go, blocks become lines, tags and common entities vanish."""
    t = F.regexp_replace(html, r"(?is)<(head|script|style|nav|footer|header|aside|noscript)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article|ul|ol|table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


# --- single files ---


def _annotate(text: str) -> str:
    counts = (
        (len(re.findall(r"(?m)^\s*([*+-]|[0-9]+\.)[ \t]+", text)), "list items"),
        (len(re.findall(r"(?m)^\s*(?:```|~~~)", text)) // 2, "code blocks"),
        (len(re.findall(r"\[[^\]]*\]\([^)]*\)", text)), "links"),
        (sum(1 for x in text.split("\n") if x.strip()), "lines"),
    )
    return " | ".join(f"{n} {name}" for n, name in counts if n)


def _first_paragraph(text: str) -> str:
    out = ""
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            if out:
                break
            continue
        out = f"{out} {line}".strip()
        if len(out) > 100:
            break
    return out


def markdown(path: str, raw: bytes) -> dict:
    text = decode(raw)
    heads: list[tuple[int, int, str]] = []
    lines, fenced = text.split("\n"), False
    for no, line in enumerate(lines):
        if re.match(FENCE, line):
            fenced = not fenced
        elif not fenced and (m := re.match(HEADING, line)):
            heads.append((no, len(m[1]), m[2].strip()))
    ends = [h[0] for h in heads[1:]] + [len(lines)]
    body = ["\n".join(lines[h[0] + 1 : e]) for h, e in zip(heads, ends)]
    toc = [entry(t, level, preview=preview(b) or None, annotation=_annotate(b) or None) for (_, level, t), b in zip(heads, body)]
    density = round(len(heads) / max(1, len(lines)), 3)
    full = whole(text) or (density > FRAGMENT_DENSITY and tokens(text) < FRAGMENT_TOKENS)
    if full or not heads:
        chunks = [chunk(text, 0)] if text.strip() else []
    else:
        parts = [("preamble", "\n".join(lines[: heads[0][0]]))] + [(t, "\n".join(lines[no:e])) for (no, _, t), e in zip(heads, ends)]
        chunks = [chunk(t.strip(), i, s) for i, (s, t) in enumerate(x for x in parts if x[1].strip())]
    title = next((t for _, level, t in heads if level == 1), heads[0][2] if heads else None)
    stats = {"line_count": len(lines), "heading_count": len(heads), "heading_density": density, "tokens": tokens(text), "is_full_content": full}
    return probe("markdown", title=title, first_paragraph=_first_paragraph(text) or None, toc=toc, stats=stats, chunks=chunks, snippet=text if full else text[:500], intro=f"Markdown {safe_name(path)}, {len(heads)} headings")


def _plain(fragment: str) -> str:
    fragment = re.sub(r"(?is)<(head|script|style|nav|footer|header|aside|noscript)\b[^>]*>.*?</\1>", " ", fragment)
    fragment = re.sub(r"(?s)<!--.*?-->", " ", fragment)
    fragment = re.sub(r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article|ul|ol|table)\b[^>]*>", "\n", fragment)
    text = html_lib.unescape(re.sub(r"<[^>]+>", "", fragment))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", text)).strip()


def _meta(page: str, name: str) -> str | None:
    for p in (rf"(?is)<meta[^>]+name=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+name=[\"']{name}[\"']"):
        if m := re.search(p, page):
            return html_lib.unescape(m[1]).strip()
    return None


def _html_annotation(fragment: str, text: str) -> str:
    counts = [(len(re.findall(rf"(?i)<{tag}[\s>]", fragment)), name) for tag, name in (("p", "paragraphs"), ("a", "links"), ("li", "list items"), ("img", "images"), ("table", "tables"))]
    counts.append((sum(1 for x in text.split("\n") if x.strip()), "lines"))
    return " | ".join(f"{n} {name}" for n, name in counts if n)


def web(path: str, raw: bytes) -> dict:
    page = decode(raw)
    title = m[1] if (m := re.search(r"(?i)<title\b[^<>]*>([\s\S]*?)</title\s*>", page)) else ""
    title = html_lib.unescape(re.sub(r"<[^>]+>", "", title)).strip()
    found = list(re.finditer(r"(?i)<h([1-6])\b[^<>]*>([\s\S]*?)</h\1\s*>", page))
    heads = [(m, int(m[1]), html_lib.unescape(re.sub(r"<[^>]+>", "", m[2])).strip()) for m in found]
    text, toc = _plain(page), []
    for i, (m, level, t) in enumerate(heads):
        inner = page[m.end() : heads[i + 1][0].start() if i + 1 < len(heads) else len(page)]
        plain = _plain(inner)
        toc.append(entry(t, level, preview=preview(plain) or None, annotation=_html_annotation(inner, plain) or None))
    full = bool(text) and whole(text)
    if full:
        chunks = [chunk(text, 0)]
    else:
        places, at = [], 0
        for _, _, t in heads:
            pos = text.find(t, at) if t else -1
            if pos >= 0:
                places.append((pos, t))
                at = pos + len(t)
        if places:
            spans = [(0, places[0][0], "preamble")] + [(p, places[i + 1][0] if i + 1 < len(places) else len(text), t) for i, (p, t) in enumerate(places)]
            parts = [(s, text[a:b].strip()) for a, b, s in spans]
        else:
            parts = [(None, p.strip()) for p in text.split("\n")]
        chunks = [chunk(t, i, s) for i, (s, t) in enumerate(x for x in parts if x[1])]
    nav = re.search(r"(?i)<nav\b[^<>]*>([\s\S]*?)</nav\s*>", page)
    links = [re.sub(r"<[^>]+>", "", x).strip() for x in re.findall(r"(?i)<a\b[^<>]*>([\s\S]*?)</a\s*>", nav[1])] if nav else []
    stats = {
        "heading_count": len(heads),
        "nav_links": [x for x in links if x],
        "keywords": _meta(page, "keywords"),
        "semantic_tags": {t: n for t in ("article", "section", "nav", "aside", "header", "footer", "main") if (n := len(re.findall(rf"(?i)<{t}[\s>]", page)))},
        "tokens": tokens(text),
        "is_full_content": full,
    }
    return probe("web", title=title or None, abstract=_meta(page, "description"), first_paragraph=_first_paragraph(text) or None, toc=toc, stats=stats, chunks=chunks, snippet=text if full else text[:500], intro=f"Web page {safe_name(path)}")


def log(path: str, raw: bytes) -> dict:
    lines = decode(raw).split("\n")
    real = [x for x in lines if x.strip()]
    first = real[:10]
    share = lambda test: sum(bool(test(x)) for x in first) / max(1, len(first))
    kind = "custom"
    if share(lambda x: x.strip().startswith("{") and x.strip().endswith("}")) > 0.7:
        kind = "jsonl"
    elif share(lambda x: re.match(TIMES[1], x)) > 0.5:
        kind = "syslog"
    elif share(lambda x: re.search(r"\[" + TIMES[2], x)) > 0.5:
        kind = "apache"
    elif share(lambda x: re.match(r"^\[?" + TIMES[0], x)) > 0.5:
        kind = "iso"

    def stamp(near: list[str]) -> str | None:
        return next((m[0] for p in TIMES for x in near if (m := re.search(p, x))), None)

    levels: dict[str, int] = {}
    for w in re.findall(LEVEL, "\n".join(lines)):
        w = "WARN" if w.upper() == "WARNING" else w.upper()
        levels[w] = levels.get(w, 0) + 1
    counts: dict[str, int] = {}
    for x in lines:
        for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", re.sub(LEVEL, " ", re.sub(TIMES[0], " ", x))):
            if w.lower() not in STOP:
                counts[w.lower()] = counts.get(w.lower(), 0) + 1
    top = [w for w, _ in sorted(counts.items(), key=lambda x: -x[1])[:10]]
    errors = [x for x in real if re.search(r"(?i)\b(ERROR|FATAL)\b", x)][:5]
    toc = [entry(n, 1, annotation=f"{levels[n]} lines") for n in LEVEL_ORDER if levels.get(n)]
    parts = [("Head", "\n".join(real[:5])), ("Tail", "\n".join(real[-5:])), ("Errors", "\n".join(errors))]
    chunks = [chunk(t, i, s) for i, (s, t) in enumerate(x for x in parts if x[1])]
    stats = {"line_count": len(lines), "format": kind, "first_time": stamp(lines[:20]), "last_time": stamp(lines[::-1][:20]), "levels": levels, "error_count": levels.get("ERROR", 0) + levels.get("FATAL", 0), "keywords": top}
    return probe("log", title=safe_name(path), toc=toc, stats=stats, chunks=chunks, intro=f"Log {safe_name(path)}, {len(real)} lines, {kind}")


def calendar(path: str, raw: bytes) -> dict:
    text = re.sub(r"\r?\n[ \t]", "", decode(raw)).replace("\r", "")
    events = []
    for body in re.findall(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT", text):
        e: dict = {"attendees": []}
        for line in body.split("\n"):
            name, _, value = line.partition(":")
            key = name.split(";")[0].upper()
            value = value.replace("\\n", "\n").replace("\\,", ",").replace("\\;", ";")
            if key == "ATTENDEE":
                e["attendees"].append(re.sub(r"(?i)^mailto:", "", value))
            elif key:
                e.setdefault(key, value)
        events.append(e)
    events.sort(key=lambda e: e.get("DTSTART") or "")
    people = sorted({a for e in events for a in e["attendees"]})
    chunks = []
    for i, e in enumerate(events):
        rows = [("Event", e.get("SUMMARY")), ("Start", e.get("DTSTART")), ("End", e.get("DTEND")), ("Place", e.get("LOCATION")), ("Repeats", e.get("RRULE")), ("With", ", ".join(e["attendees"])), ("About", e.get("DESCRIPTION"))]
        chunks.append(chunk("\n".join(f"{k}: {v}" for k, v in rows if v), i, e.get("SUMMARY") or "Event"))
    recurring = sum("RRULE" in e for e in events)
    stats = {"event_count": len(events), "recurring": recurring, "one_time": len(events) - recurring, "attendees": people[:20], "first": events[0].get("DTSTART") if events else None, "last": events[-1].get("DTSTART") if events else None}
    name = m[1].strip() if (m := re.search(r"(?m)^X-WR-CALNAME:(.*)$", text)) else safe_name(path)
    toc = [entry(e.get("SUMMARY") or "Event", 1, annotation=e.get("DTSTART")) for e in events[:30]]
    return probe("calendar", title=name, toc=toc, stats=stats, chunks=chunks, intro=f"Calendar {safe_name(path)}, {len(events)} events")
