"""Images: format, size, EXIF values and position, from the headers alone."""

from __future__ import annotations

import struct

from .base import chunk, probe, safe_name

TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x010E: "ImageDescription", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x9003: "DateTimeOriginal"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _dimensions(b: bytes) -> tuple[str, int, int, str]:
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", b[16:24])
        return "PNG", w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(b[25], "?")
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", *struct.unpack("<HH", b[6:10]), "P"
    if b[:2] == b"BM":
        w, h = struct.unpack("<ii", b[18:26])
        return "BMP", w, abs(h), "RGB"
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        if b[12:16] == b"VP8X":
            return "WEBP", int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, "RGBA"
        if b[12:16] == b"VP8L":
            n = int.from_bytes(b[21:25], "little")
            return "WEBP", (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1, "RGBA"
        w, h = struct.unpack("<HH", b[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF, "RGB"
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                at += 1
                continue
            mark, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(b[at + 9], "?")
            at += 2 + size
    if b[:4] in (b"II*\0", b"MM\0*"):
        tags = _ifd(b, 0)
        return "TIFF", int(tags.get(256, 0) or 0), int(tags.get(257, 0) or 0), "?"
    raise ValueError("not an image that can be read")


def _value(b: bytes, e: str, kind: int, count: int, at: int):
    if kind == 2:
        return b[at : at + count].split(b"\0")[0].decode("utf-8", "replace")
    out = []
    for i in range(min(count, 16)):
        p = at + i * _SIZES[kind]
        if kind in (5, 10):
            x, y = struct.unpack(e + ("II" if kind == 5 else "ii"), b[p : p + 8])
            out.append(x / y if y else 0.0)
        else:
            out.append(int.from_bytes(b[p : p + _SIZES[kind]], "little" if e == "<" else "big", signed=kind == 9))
    return out[0] if len(out) == 1 else out


def _ifd(b: bytes, start: int, offset: int | None = None) -> dict:
    """Tags of a TIFF directory; ``start`` is where the TIFF header stands."""
    e = "<" if b[start : start + 2] == b"II" else ">"
    at = start + (struct.unpack(e + "I", b[start + 4 : start + 8])[0] if offset is None else offset)
    out = {}
    for i in range(struct.unpack(e + "H", b[at : at + 2])[0]):
        p = at + 2 + 12 * i
        tag, kind, count = struct.unpack(e + "HHI", b[p : p + 8])
        if kind not in _SIZES:
            continue
        size = _SIZES[kind] * count
        where = p + 8 if size <= 4 else start + struct.unpack(e + "I", b[p + 8 : p + 12])[0]
        out[tag] = _value(b, e, kind, count, where)
    return out


def exif(b: bytes) -> dict:
    """Named tags, and latitude and longitude."""
    at = b.find(b"Exif\0\0")
    start = at + 6 if at >= 0 else 0 if b[:4] in (b"II*\0", b"MM\0*") else -1
    if start < 0:
        return {}
    try:
        main = _ifd(b, start)
        every = main | (_ifd(b, start, main[0x8769]) if 0x8769 in main else {})
        out = {TAGS[t]: str(v)[:200] for t, v in every.items() if t in TAGS}
        if 0x8825 in main:
            gps = _ifd(b, start, main[0x8825])
            for name, ref, tag, minus in (("latitude", 1, 2, "S"), ("longitude", 3, 4, "W")):
                if isinstance(gps.get(tag), list) and len(gps[tag]) == 3:
                    d, m, s = gps[tag]
                    out[name] = round((d + m / 60 + s / 3600) * (-1 if gps.get(ref) == minus else 1), 6)
        return out
    except (struct.error, IndexError, KeyError):
        return {}


def image(path: str, raw: bytes) -> dict:
    kind, w, h, mode = _dimensions(raw)
    tags = exif(raw)
    stats = {"format": kind, "width": w, "height": h, "mode": mode, "exif": tags}
    rows = [f"File: {safe_name(path)}", f"Format: {kind}", f"Size: {w} x {h}", f"Mode: {mode}", *(f"{k}: {v}" for k, v in tags.items())]
    return probe("image", title=safe_name(path), stats=stats, chunks=[chunk("\n".join(rows), 0, "Metadata")], intro=f"{kind} image, {w} x {h}")
