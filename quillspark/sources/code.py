"""Source code: Python through its own parser, JavaScript and TypeScript by their declarations."""

from __future__ import annotations

import ast
import re

from .base import chunk, decode, entry, probe, safe_name, suffix_of, whole

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript"}
_JS = re.compile(r"(?m)^(?:export\s+(?:default\s+)?)?(?:(?:abstract\s+)?class\s+(?P<cls>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?|(?:async\s+)?function\s*\*?\s*(?P<fn>[\w$]+)\s*\((?P<args>[^)]*)\)|(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\((?P<aargs>[^)]*)\)|(?P<one>[\w$]+))\s*(?::[^=\n]+)?=>)")
_METHOD = re.compile(r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>[\w$#]+)\s*\((?P<args>[^)]*)\)\s*(?::\s*[^{;\n]+)?\{")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor"} - {"constructor"}


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    back = f" -> {ast.unparse(f.returns)}" if f.returns else ""
    return f"{f.name}({ast.unparse(f.args)}){back}"


def _doc(node: ast.AST) -> str | None:
    text = ast.get_docstring(node)
    return text.strip().split("\n")[0][:120] if text else None


def _python(text: str) -> tuple[list, list, list, str | None]:
    tree, lines = ast.parse(text), text.split("\n")
    toc, chunks, imports = [], [], []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(ast.unparse(node))
            continue
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        if isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            bases = f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""
            toc.append(entry(f"class {node.name}{bases}", 1, preview=_doc(node), annotation=f"{len(methods)} methods"))
            toc += [entry(_signature(m), 2, preview=_doc(m), annotation=f"{m.end_lineno - m.lineno + 1} lines") for m in methods]
        else:
            toc.append(entry(_signature(node), 1, preview=_doc(node), annotation=f"{node.end_lineno - node.lineno + 1} lines"))
        chunks.append(("\n".join(lines[first - 1 : node.end_lineno]), node.name, first, node.end_lineno))
    doc = ast.get_docstring(tree)
    return toc, chunks, imports, doc[:300] if doc else None


def _closing(text: str, at: int) -> int:
    """End of the block that the first brace from ``at`` opens, else of the statement."""
    open_ = text.find("{", at)
    end = text.find("\n", at)
    if open_ < 0 or (0 <= text.find(";\n", at) < open_):
        return end if end >= 0 else len(text)
    depth, i, quote = 0, open_, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def _script(text: str) -> tuple[list, list, list, str | None]:
    imports = [m[0].strip() for m in re.finditer(r"(?m)^(?:import\s.+|export\s+(?:\*|\{[^}]*\})\s+from\s.+|(?:const|let|var)\s.+=\s*require\(.+\).*)$", text)]
    toc, chunks, last = [], [], 0
    for m in _JS.finditer(text):
        if m.start() < last:
            continue
        last = _closing(text, m.end())
        body, name = text[m.start() : last], m["cls"] or m["fn"] or m["arrow"]
        above = re.search(r"/\*\*\s*((?:(?!\*/)[\s\S])*?)\*/\s*$", text[: m.start()])
        note = next((x for x in (re.sub(r"^\s*\*?\s?", "", y).strip() for y in above[1].split("\n")) if x), None) if above else None
        if m["cls"]:
            methods = [x for x in _METHOD.finditer(body) if x["name"] not in _WORDS]
            toc.append(entry(f"class {name}" + (f"({m['base']})" if m["base"] else ""), 1, preview=note, annotation=f"{len(methods)} methods"))
            toc += [entry(f"{x['name']}({x['args'].strip()})", 2) for x in methods]
        else:
            args = m["args"] if m["fn"] else m["aargs"] if m["aargs"] is not None else m["one"] or ""
            toc.append(entry(f"{name}({args.strip()})", 1, preview=note, annotation=f"{body.count(chr(10)) + 1} lines"))
        line = text.count("\n", 0, m.start()) + 1
        chunks.append((body, name, line, line + body.count("\n")))
    head = re.match(r"\s*/\*\*([\s\S]*?)\*/", text)
    return toc, chunks, imports, re.sub(r"(?m)^\s*\*\s?", "", head[1]).strip()[:300] if head else None


def code(path: str, raw: bytes) -> dict:
    text, kind = decode(raw), suffix_of(path)
    language = LANGUAGES.get(kind)
    try:
        toc, parts, imports, doc = _python(text) if language == "python" else _script(text)
    except SyntaxError:  # still readable as text
        toc, parts, imports, doc = [], [], [], None
    full = whole(text)
    if full or not parts:
        chunks = [chunk(text, 0)] if text.strip() else []
    else:
        chunks = [chunk(t, i, name, start_line=a, end_line=b) for i, (t, name, a, b) in enumerate(parts)]
    stats = {"language": language, "line_count": text.count("\n") + 1, "imports": imports[:20], "definition_count": len(parts), "is_full_content": full}
    return probe("code", title=safe_name(path), abstract=doc, toc=toc, definitions=[e["title"] for e in toc if e["level"] == 1], stats=stats, chunks=chunks, snippet=text if full else text[:500], intro=f"{language} source {safe_name(path)}, {len(parts)} definitions")
