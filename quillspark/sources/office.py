"""Word, PowerPoint and PDF files with nothing beyond the standard library.

The PDF reader covers what most writers produce: plain or Flate streams, object
streams, simple fonts and two-byte fonts with a ToUnicode map. Encrypted files
raise ``ValueError``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections import Counter
from xml.etree import ElementTree

from .base import chunk, entry, preview, probe, safe_name

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
TITLE_CHARS, HEADER, BOLD = 100, 1.1, 2


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _core(z: zipfile.ZipFile) -> dict:
    x = _xml(z, "docProps/core.xml")
    return {} if x is None else {k: e.text for k, e in (("title", x.find(_DC + "title")), ("author", x.find(_DC + "creator")), ("subject", x.find(_DC + "subject"))) if e is not None and e.text}


def _section(title: str, level: int) -> dict:
    return dict(items=0, paragraphs=[], title=title, level=level)


def docx(path: str, raw: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(raw))
    body, styles, core = _xml(z, "word/document.xml").find(_W + "body"), {}, _core(z)
    if (sx := _xml(z, "word/styles.xml")) is not None:
        for s in sx.iter(_W + "style"):
            n = s.find(_W + "name")
            styles[s.get(_W + "styleId")] = n.get(_W + "val") if n is not None else ""
    sections: list[dict] = [_section("Preamble", 0)]
    tables, words = [], 0
    for node in body:
        if node.tag == _W + "tbl":
            first = node.find(_W + "tr")
            tables.append([" ".join(t.text or "" for t in c.iter(_W + "t")) for c in first.iter(_W + "tc")] if first is not None else [])
            continue
        if node.tag != _W + "p":
            continue
        text = "".join((t.text or "") if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "" for t in node.iter()).strip()
        style = node.find(f"{_W}pPr/{_W}pStyle")
        sid = style.get(_W + "val") if style is not None else ""
        name = styles.get(sid, sid) or ""
        if not text:
            continue
        words += len(text.split())
        if m := re.match(r"(?i)heading\s*(\d+)", name):
            sections.append(_section(text, int(m[1])))
        else:
            sections[-1]["paragraphs"].append(text)
            sections[-1]["items"] += name.lower().startswith("list") or node.find(f"{_W}pPr/{_W}numPr") is not None
    sections = [s for s in sections if s["level"] or s["paragraphs"]]

    def note(s: dict) -> str:
        plain = len(s["paragraphs"]) - s["items"]
        return " | ".join(x for x in (f"List, {s['items']} items" if s["items"] else "", f"{plain} paragraphs" if plain else "") if x)

    toc = [entry(s["title"], max(1, s["level"]), preview=preview("\n".join(s["paragraphs"])) or None, annotation=note(s) or None) for s in sections]
    chunks = [chunk("\n".join([s["title"], "", *s["paragraphs"]]) if s["level"] else "\n".join(s["paragraphs"]), i, s["title"]) for i, s in enumerate(sections)]
    stats = {"section_count": len(sections), "paragraph_count": sum(len(s["paragraphs"]) for s in sections), "table_count": len(tables), "table_headers": tables[:5], "word_count": words, **core}
    opening = next((p for s in sections for p in s["paragraphs"] if len(p) > 40), None)
    title = core.get("title") or next((s["title"] for s in sections if s["level"] == 1), None)
    return probe("docx", title=title, abstract=core.get("subject"), first_paragraph=opening and opening[:500], toc=toc, stats=stats, chunks=chunks or [chunk("(empty document)", 0)], intro=f"Document {safe_name(path)}, {len(sections)} sections")


def pptx(path: str, raw: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    toc, chunks, noted, images, tables = [], [], 0, 0, 0
    for i, name in enumerate(names):
        x, title, bullets = _xml(z, name), "", []
        for shape in x.iter(_P + "sp"):
            ph = shape.find(f".//{_P}nvPr/{_P}ph")
            lines = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in shape.iter(_A + "p")]
            lines = [t for t in lines if t]
            if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                title = " ".join(lines)
            else:
                bullets += lines
        images += sum(1 for _ in x.iter(_P + "pic"))
        tables += sum(1 for _ in x.iter(_A + "tbl"))
        notes, rel = "", z.namelist() and f"ppt/slides/_rels/{name.rsplit('/', 1)[1]}.rels"
        if (rx := _xml(z, rel)) is not None:
            for r in rx:
                if r.get("Type", "").endswith("/notesSlide"):
                    nx = _xml(z, "ppt/notesSlides/" + r.get("Target").rsplit("/", 1)[1])
                    for shape in [] if nx is None else nx.iter(_P + "sp"):
                        ph = shape.find(f".//{_P}nvPr/{_P}ph")
                        if ph is not None and ph.get("type") == "body":
                            notes = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in shape.iter(_A + "p"))))
        noted += bool(notes)
        title = title or f"Slide {i + 1}"
        toc.append(entry(title, 1, i + 1, preview=preview(notes or "\n".join(bullets)) or None))
        toc += [entry(b[:80], 2, i + 1) for b in bullets[:3]]
        text = "\n".join([title, *bullets]) + (f"\n\nNotes: {notes}" if notes else "")
        chunks.append(chunk(text, i, title, i + 1))
    core = _core(z)
    stats = {"slide_count": len(names), "slides_with_notes": noted, "image_count": images, "table_count": tables, **core}
    return probe("pptx", title=core.get("title") or (toc[0]["title"] if toc else None), toc=toc, stats=stats, chunks=chunks, intro=f"Presentation {safe_name(path)}, {len(names)} slides")


# --- PDF ---


class _Pdf:
    def __init__(self, raw: bytes):
        if b"/Encrypt" in raw[-4096:]:
            raise ValueError("encrypted PDF")
        self.objects: dict[int, bytes] = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                data = self.stream(body)
                n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
                nums = list(map(int, data[:first].split()[: 2 * n]))
                for j in range(n):
                    end = nums[2 * j + 3] + first if j + 1 < n else len(data)
                    self.objects.setdefault(nums[2 * j], data[nums[2 * j + 1] + first : end])
        self.raw = raw

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not m:
            return b""
        if b"FlateDecode" in body[: m.start()]:
            d = zlib.decompressobj()
            return d.decompress(m[1])
        return m[1]

    def get(self, number: int) -> bytes:
        return self.objects.get(number, b"")

    def ref(self, body: bytes, key: bytes) -> bytes:
        """The value of a key, followed where it is a reference."""
        m = re.search(rb"/" + key + rb"\s*(\d+)\s+\d+\s+R", body)
        if m:
            return self.get(int(m[1]))
        m = re.search(rb"(?s)/" + key + rb"\s*(<<.*)", body)
        return m[1] if m else b""

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []

        def walk(body: bytes, seen: int = 0) -> None:
            if re.search(rb"/Type\s*/Page\b(?!s)", body):
                out.append(body)
            elif seen < 50 and (kids := re.search(rb"(?s)/Kids\s*\[(.*?)\]", body)):
                for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                    walk(self.get(int(k)), seen + 1)

        walk(self.ref(root, b"Pages"))
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def info(self) -> dict[str, str]:
        m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", self.raw)
        body = self.get(int(m[1])) if m else b""
        return {k.decode().lower(): _text(v) for k in (b"Title", b"Author", b"Subject") if (v := _string(body, k)) is not None}


def _string(body: bytes, key: bytes) -> bytes | None:
    m = re.search(rb"(?s)/" + key + rb"\s*\(((?:\\.|[^\\)])*)\)", body)
    return _unescape(m[1]) if m else None


def _unescape(b: bytes) -> bytes:
    names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"(?s)\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else names.get(m[1], m[1]), b)


def _text(b: bytes) -> str:
    return b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("cp1252", "replace")


def _cmap(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", data):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", data):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + i] = chr(int(c, 16) + i)
    return out


_TOKEN = re.compile(rb"(?s)\[((?:\\.|\((?:\\.|[^\\)])*\)|[^\]])*)\]\s*TJ|\(((?:\\.|[^\\)])*)\)\s*(Tj|'|\")|<([0-9A-Fa-f\s]*)>\s*Tj|/([^\s/\[\]()<>]+)\s+(-?[\d.]+)\s+Tf|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]\b|((?:-?[\d.]+\s+){6})Tm\b|T\*|\bET\b")


def _lines(pdf: _Pdf, page: bytes) -> list[tuple[str, float, bool]]:
    """Text lines of a page with font size and weight."""
    fonts: dict[bytes, tuple[bool, dict[int, str]]] = {}
    res = pdf.ref(page, b"Resources") or page
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", pdf.ref(res, b"Font") or b""):
        body = pdf.get(int(number))
        base = re.search(rb"/BaseFont\s*/([^\s/<>\[\]]+)", body)
        cmap = pdf.ref(body, b"ToUnicode")
        fonts[name] = (bool(base and b"bold" in base[1].lower()), _cmap(pdf.stream(cmap)) if cmap else {})
    m = re.search(rb"(?s)/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page)
    data = b"\n".join(pdf.stream(pdf.get(int(n))) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])) if m else b""
    out: list[tuple[str, float, bool]] = []
    now, size, scale, font = "", 0.0, 1.0, (False, {})

    def show(b: bytes) -> str:
        if font[1]:
            wide = max(font[1]) > 255
            codes = [int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b), 2)] if wide else list(b)
            return "".join(font[1].get(c, "") for c in codes)
        return b.decode("cp1252", "replace")

    def flush() -> None:
        nonlocal now
        if now.strip():
            out.append((re.sub(r"\s+", " ", now).strip(), round(size * scale, 1), font[0]))
        now = ""

    for t in _TOKEN.finditer(data):
        if t[1] is not None:
            for s, h, k in re.findall(rb"(?s)\(((?:\\.|[^\\)])*)\)|<([0-9A-Fa-f\s]*)>|(-?[\d.]+)", t[1]):
                now += show(_unescape(s)) if s else show(bytes.fromhex(h.decode())) if h else " " if k and float(k) < -200 else ""
        elif t[2] is not None:
            now += show(_unescape(t[2]))
        elif t[4] is not None:
            now += show(bytes.fromhex(re.sub(rb"\s", b"", t[4]).decode()))
        elif t[5] is not None:
            if now and (float(t[6]) != size or fonts.get(t[5], font) != font):
                flush()
            font, size = fonts.get(t[5], (False, {})), float(t[6])
        elif t[7] is not None:
            if float(t[8]):
                flush()
            else:
                now += " "
        else:
            flush()
            if t[9] is not None:
                scale = abs(float(t[9].split()[3])) or 1.0
    flush()
    return out


def _outline(pdf: _Pdf) -> list[dict]:
    root = next((b for b in pdf.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    top, out = pdf.ref(root, b"Outlines"), []

    def walk(number: int | None, level: int) -> None:
        while number and len(out) < 5000:
            body = pdf.get(number)
            if (t := _string(body, b"Title")) is not None:
                out.append(entry(_text(t), level))
            child, after = (re.search(rb"/" + k + rb"\s+(\d+)\s+\d+\s+R", body) for k in (b"First", b"Next"))
            walk(int(child[1]) if child else None, level + 1)
            number = int(after[1]) if after else None

    first = re.search(rb"/First\s+(\d+)\s+\d+\s+R", top)
    walk(int(first[1]) if first else None, 1)
    return out


def pdf(path: str, raw: bytes) -> dict:
    doc = _Pdf(raw)
    pages = [_lines(doc, p) for p in doc.pages()]
    weight: Counter = Counter()
    for line, size, _ in (x for p in pages for x in p):
        weight[size] += len(line)
    body = weight.most_common(1)[0][0] if weight else 0.0
    info, native = doc.info(), _outline(doc)
    first = [(size * (BOLD if bold else 1), -i, line) for i, (line, size, bold) in enumerate(pages[0] if pages else []) if len(line) < TITLE_CHARS]
    title = (info.get("title") or "").strip() or (max(first)[2] if first else None)
    found = [(i + 1, line, size) for i, p in enumerate(pages) for line, size, _ in p if size > body * HEADER and 2 < len(line) < TITLE_CHARS]
    sizes = sorted({s for *_, s in found}, reverse=True)
    toc = []
    if native:
        for e in native:
            e["page"] = next((i + 1 for i, p in enumerate(pages) if any(e["title"].lower() in x[0].lower() for x in p)), None)
            toc.append(e)
    else:
        toc = [entry(line, min(sizes.index(size) + 1, 6), page) for page, line, size in found]
    texts = ["\n".join(x[0] for x in p) for p in pages]
    for e in toc:
        if e["page"]:
            at = texts[e["page"] - 1].find(e["title"])
            after = texts[e["page"] - 1][at + len(e["title"]) :][:300].strip() if at >= 0 else ""
            m = re.match(r"(?s)(.*?[.!?])\s", after)
            e["preview"] = m[1] if m else after[:200] if len(after) > 20 else None
    captions = [{"text": x[0], "page": i + 1, "kind": "figure" if x[0].lower().startswith("fig") else "table"} for i, p in enumerate(pages) for x in p if re.match(r"(?:Fig(?:ure|\.)|Tab(?:le|\.))\s*[0-9]+", x[0])]
    opening = next((x[0] for p in pages for x in p if x[1] == body and len(x[0]) > 80), None)
    chunks, section = [], None
    for i, t in enumerate(texts):
        here = [e["title"] for e in toc if e["page"] == i + 1]
        section = here[-1] if here else section
        if t.strip():
            chunks.append(chunk(t, i, section, i + 1))
    stats = {"pages": len(pages), "body_font_size": body, "toc_source": "outline" if native else "fonts", **{k: v for k, v in info.items() if k != "title"}}
    return probe("pdf", title=title, abstract=info.get("subject"), first_paragraph=opening and opening[:500], toc=toc, captions=captions, stats=stats, chunks=chunks, intro=f"PDF {safe_name(path)}, {len(pages)} pages")
