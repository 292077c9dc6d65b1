"""Descriptions of the engine's operations for agents that call tools."""

from __future__ import annotations


def _tool(name: str, what: str, need: list[str], **fields: tuple[str, str]) -> dict:
    props = {k: {"type": t, "description": d} | ({"items": {"type": "string"}} if t == "array" else {}) for k, (t, d) in fields.items()}
    parameters = dict(type="object", required=need, properties=props)
    return dict(type="function", function=dict(name=name, parameters=parameters, description=what))


def get_tool_schemas() -> list[dict]:
    return [
        _tool("search_memory", "Find documents and their sections that bear on a question.", ["query"], query=("string", "What to look for."), top_k=("integer", "How many chunks to find, 5 unless told."), hybrid=("boolean", "Whether words count beside meaning."), toc_only=("boolean", "Whether to list sections instead of text."), source=("string", "A source, or its beginning followed by *."), collections=("array", "Collections to look in.")),
        _tool("get_doc_meta", "A document's introduction, reading instructions and contents.", ["doc_id"], doc_id=("string", "The document.")),
        _tool("read_segment", "The text of one section with everything below it.", ["doc_id", "section_path"], doc_id=("string", "The document."), section_path=("string", "A section's title."), include_summary=("boolean", "Whether summaries come along.")),
        _tool("index_memory", "Store a text so that later searches find it.", ["content", "filename"], content=("string", "The text."), filename=("string", "A name, whose ending tells the format."), source=("string", "Where it is from."), collection=("string", "A collection to put it in.")),
        _tool("memory_status", "Counts of what is stored, or the state of one document.", [], doc_id=("string", "A document, if one is asked for.")),
    ]


def get_system_prompt() -> str:
    return (
        "You have a store of documents. Work in two steps. Search first, with toc_only if the question is broad: "
        "this shows which documents and sections matter, at little cost. Then read only the sections you need with "
        "read_segment; a section brings everything below it. Ask get_doc_meta when a title alone doesn't tell what a "
        "document is. Store what will be of use later with index_memory."
    )


def export_skill() -> dict:
    return {"system_prompt": get_system_prompt(), "tools": get_tool_schemas()}
