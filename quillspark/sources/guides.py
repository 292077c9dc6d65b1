"""Reading instructions for each format, as templates."""

from __future__ import annotations

import json

TEMPLATES = {
    "pdf": "A paged document of {pages} pages. Choose a section from the contents and read its pages.",
    "image": "An image of {width} by {height} pixels. Only its metadata is text.",
    "docx": "A word processor document with {section_count} sections. Read it section by section.",
    "pptx": "A presentation of {slide_count} slides. Each slide is one chunk, notes included.",
    "calendar": "A calendar of {event_count} events in order of their start. Each event is one chunk.",
    "archive": "An archive of {file_count} files. The chunk lists them; unpack it to read any.",
    "csv": "A table of {row_count} rows and {column_count} columns. Look at the column profile before querying it.",
    "json": "A JSON document with {key_count} keys, {max_depth} deep. Each top-level key is a chunk.",
    "jsonl": "{record_count} JSON records, one per line. Chunks hold records in order.",
    "config": "A configuration with {key_count} keys. The contents list sections and keys.",
    "code": "A {language} source file. Each top-level definition is a chunk.",
    "log": "A log of {line_count} lines in {format} format. Chunks show its head, its tail and errors.",
    "markdown": "A text with {heading_count} headings. Read sections by their titles; a title includes what lies below it.",
    "web": "A web page with {heading_count} headings. Read sections by their titles.",
}


def instructions(probe: dict) -> str:
    stats = json.loads(probe.get("stats") or "{}")
    values = type("Stats", (dict,), {"__missing__": lambda self, k: "some"})(stats)
    text = TEMPLATES.get(probe["file_type"], "Read the chunks in order.").format_map(values)
    if stats.get("is_full_content"):
        text += " The whole text is in one chunk."
    return text


def guide(probe: dict) -> tuple[str, str]:
    """Introduction and instructions without a model."""
    t = probe.get("topic") or {}
    opening = t.get("first_paragraph") or ""
    opening = opening[:147] + "..." if len(opening) > 150 else opening
    head = " — ".join(x for x in (t.get("title"), t.get("abstract") or opening) if x and x.strip())
    return "\n\n".join(x for x in (head, probe.get("brief_intro")) if x and x.strip()), probe.get("instructions") or instructions(probe)
