import random

import numpy as np
import pytest

from quillspark.llm import chunk_dedup as cd
from quillspark.llm import pfp_dedup as pd_


def test_gear_hash_is_the_recurrence():
    data = np.frombuffer(random.Random(0).randbytes(500), np.uint8)
    fast = cd.gear_hash(data)
    for at in (0, 3, 15, 16, 17, 250, 499):
        h = 0
        for b in data[max(0, at - 15) : at + 1]:
            h = ((h << 1) + int(cd.GEAR[b])) & 0xFFFFFFFF
        assert fast[at] == h


def test_cuts_cover_and_resist_shifts(prose):
    text = prose(1, 2000)
    a, b = text.encode(), ("Inserted. " + text).encode()
    sets = []
    for raw in (a, b):
        buf = np.frombuffer(raw, np.uint8)
        s, e = cd.cuts(buf, np.array([0, len(buf)]), 4, 16, 512)
        assert s[0] == 0 and e[-1] == len(buf) and (s[1:] == e[:-1]).all() and (e - s).max() <= 512 + 3
        sets.append({raw[x:y] for x, y in zip(s, e)})
    assert len(sets[0] - sets[1]) <= 2


def test_cuts_respect_characters_and_rows():
    texts = ["é" * 700, "", "a" * 1300, "日本語" * 300]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    s, e = cd.cuts(np.frombuffer(raw, np.uint8), off, 4, 16, 512)
    for x, y in zip(s, e):
        raw[x:y].decode()
    assert set(off[1:]) <= set(e) and b"".join(raw[x:y] for x, y in zip(s, e)) == raw


@pytest.fixture(scope="module")
def rows(prose):
    passages = [prose(900 + i, 60) for i in range(6)]
    out = []
    for i in range(60):
        t = prose(i, 80)
        if i % 3 == 0:
            t = prose(i, 30) + " " + passages[(i // 3) % 6] + " " + prose(100 + i, 30)
        out.append((i, t))
    return out


MODULES = [(cd.report, cd.dedup), (pd_.report, pd_.dedup)]


@pytest.mark.parametrize("report,dedup", MODULES)
def test_finds_planted_passages_and_nothing_else(frame, rows, report, dedup):
    got = report(frame(rows, "digest")).collect()
    text = dict(rows)
    # the first document that has a passage keeps it, the others lose it
    assert {r["doc_id"] for r in got} == {i for i in range(60) if i % 3 == 0 and i >= 18}
    for r in got:
        piece = text[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert len(piece) >= 112 and r["first_doc_id"] < r["doc_id"]
        assert piece in text[r["first_doc_id"]].encode()
    kept = {r["doc_id"]: r for r in dedup(frame(rows, "digest")).collect()}
    assert len(kept) == 60 and all(kept[i]["text"] == t for i, t in rows if i % 3 or i < 18)
    assert all(len(kept[r["doc_id"]]["text"]) == kept[r["doc_id"]]["n_chars"] < len(text[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("report,dedup", MODULES)
def test_odd_rows(frame, prose, report, dedup):
    t = prose(5, 200)
    rows = [(1, None), (2, ""), (3, t), (3, t), (None, prose(6, 100)), (4, t), (5, "short"), (6, "short"), (7, prose(8, 40_000))]
    docs = frame(rows, "k").selectExpr("*", "1 AS own", "2 AS spans", "3 AS t", "4 AS i", "5 AS __k", "6 AS `a.b`")
    got = report(docs).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(4, 3)}
    kept = dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect() if r["doc_id"] != 4)
    assert ids == sorted((i is None, i or 0) for i, _ in rows if i != 4)
    assert report(frame([])).count() == 0 and dedup(frame([])).count() == 0


@pytest.mark.parametrize("report,dedup", MODULES)
def test_multibyte_texts_stay_valid(frame, prose, report, dedup):
    r = random.Random(3)
    some = lambda n: "".join(r.choice("äöüéèñ日本語мир абв") for _ in range(n))
    passage = some(400)
    rows = [(i, some(150) + passage) for i in range(5)]
    kept = {r["doc_id"]: r["text"] for r in dedup(frame(rows)).collect()}
    assert kept[0] == rows[0][1] and all("�" not in t for t in kept.values())
    assert all(len(kept[i]) < 300 for i in range(1, 5))


def test_repeats_within_one_document(frame, prose):
    p = prose(1, 60)
    got = cd.report(frame([(1, p + " " + prose(2, 60) + " " + p)])).collect()
    assert [(r["doc_id"], r["first_doc_id"]) for r in got] == [(1, 1)] and got[0]["start_byte"] > len(p)


# --- prefix-free parsing ---


def test_parse_overlaps_by_windows_and_is_prefix_free(prose):
    raw = prose(1, 3000).encode()
    buf = np.frombuffer(raw, np.uint8)
    row, s, e, digest = pd_.parse(buf, np.array([0, len(buf)]), 10, 20)
    assert s[0] == 0 and e[-1] == len(raw) and (s[1:] == e[:-1] - 10).all()
    words = sorted({raw[x:y] for x, y in zip(s, e)} - {raw[s[-1] : e[-1]]})
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


def test_suffix_array_equals_sorting():
    r = random.Random(2)
    strings = [[r.randrange(4) for _ in range(r.randint(1, 9))] for _ in range(200)]
    flat = np.array([x + 10 for s in strings for x in s], np.uint64)
    bounds = np.cumsum([0] + [len(s) for s in strings])
    order, shared = pd_.suffix_array(flat, bounds)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for k in range(1, len(got)):
        n = 0
        while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
            n += 1
        assert shared[k] == n


def test_long_repeats_are_always_found(frame, prose):
    """Every repeat of over min_bytes plus two phrases is reported, wherever it stands."""
    r = random.Random(9)
    rows = []
    for i in range(40):
        t = list(prose(i, 60))
        rows.append((i, "".join(t)))
    for i in range(40):
        src = prose(300 + i, 90)[: r.randint(380, 480)]
        rows.append((100 + i, prose(400 + i, 20)[: r.randint(1, 90)] + src + prose(500 + i, 20)))
        rows.append((200 + i, prose(600 + i, 20)[: r.randint(1, 90)] + src + prose(700 + i, 20)))
    got = {r["doc_id"] for r in pd_.report(frame(rows)).collect()}
    assert got == {200 + i for i in range(40)}


def test_first_occurrence_over_many_batches(frame, prose):
    """Copies in other batches name the corpus's first, not that of their own batch."""
    one, two = prose(801, 60), prose(802, 60)
    # the character before a copy is each document's own, so that all copies begin alike
    rows = [(i, prose(1000 + i, 8) + chr(256 + i) + (one, two)[i % 2] + chr(320 + i) + prose(2000 + i, 8)) for i in range(40)]
    rows = rows[20:] + rows[:20]  # the firsts are in the last partitions
    text = {i: t for i, t in rows}
    seen = {}
    for parts in (1, 4, 13):
        docs = frame(rows).repartitionByRange(parts, "doc_id") if parts > 1 else frame(rows).coalesce(1)
        got = sorted(map(tuple, pd_.report(docs).collect()))
        assert {r[0] for r in got} == set(range(2, 40)) and all(r[3] == r[0] % 2 for r in got)
        for i, s, e, src, at in got:
            assert text[src].encode()[at : at + e - s] == text[i].encode()[s:e]
        seen[parts] = got
    assert seen[1] == seen[4] == seen[13]


def plain_spans(rows, window, modulus, least):
    """The report from all suffixes of all texts: spans by document, and the first place of each marked byte's suffix."""
    texts = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    suffixes = []
    for i, t in texts:
        raw = t.encode()
        buf = np.frombuffer(raw, np.uint8)
        _, a, b, _ = pd_.parse(buf, np.array([0, len(raw)]), window, modulus)
        for p in range(len(raw)):
            own = max(j for j in range(len(a)) if a[j] <= p)  # the last phrase that begins here or before
            if b[own] - p >= least:
                end = p + least
            else:
                end = next((int(x) for x in b[own:] if x >= p + least), None)
            if end is not None:
                suffixes.append((raw[p:end], i, p, end))
    suffixes.sort(key=lambda x: x[0])  # a plain suffix array; equal ones are an interval
    first, spans = {}, {}
    for text, i, p, end in suffixes:
        order = (i is not None, i or 0, p)
        first[text] = min(first.get(text, order), order)
    for text, i, p, end in suffixes:
        if first[text] != (i is not None, i or 0, p):
            spans.setdefault(i, []).append((p, end))
    out = set()
    for i, own in spans.items():
        s, e = None, None
        for p, end in sorted(own):
            if s is None or p > e:
                if s is not None:
                    out.add((i, s, e))
                s, e = p, end
            e = max(e, end)
        out.add((i, s, e))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_report_equals_a_plain_suffix_array(frame, prose, parts):
    r = random.Random(17)
    passages = [prose(7000 + i, 14) for i in range(5)] + ["=" * 90, "ab" * 60, "| cell " * 12]
    rows = []
    for i in range(36):
        t = prose(i, r.randint(3, 20))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            t += p[r.randint(0, 12) : len(p) - r.randint(0, 12)] + prose(100 + i, r.randint(1, 9))
        rows.append((i, t))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "x"), (3, rows[3][1]), (52, None), (53, ""), (None, rows[7][1]), (54, "-" * 200)]
    got = pd_.report(frame(rows).repartition(parts), window=6, modulus=8, min_bytes=40).collect()
    assert {(x[0], x[1], x[2]) for x in got} == plain_spans(rows, 6, 8, 40)
    text = {(i, j): t for j, (i, t) in enumerate(rows)}
    for doc, s, _, src, at in got:
        mine = [t.encode()[s : s + 40] for (i, _), t in text.items() if i == doc and t]
        assert any(t.encode()[at : at + 40] in mine for (i, _), t in text.items() if i == src and t)


def test_repeated_lines_without_triggers(frame, prose):
    """Text that repeats every few bytes may have no trigger at all: it repeats itself, in one document and in others."""
    for line in ("-" * 7, "0123456789", "| a | b |\n"):
        block = line * 60
        got = pd_.report(frame([(1, prose(1, 30) + block + prose(2, 30)), (2, prose(3, 30) + block + prose(4, 30)), (3, prose(5, 60))])).collect()
        by = {x["doc_id"]: (x["end_byte"] - x["start_byte"]) for x in got}
        assert set(by) == {1, 2} and by[1] >= len(block) - len(line) - 112 and by[2] >= len(block) - 112


def test_dictionary_ranks_equal_sorting():
    r = random.Random(3)
    strings = [bytes(r.randrange(97, 100) for _ in range(r.randint(1, 30))) for _ in range(60)]
    off = np.cumsum([0] + [len(x) for x in strings])
    ranks = pd_.dictionary_ranks(np.frombuffer(b"".join(strings), np.uint8), off)
    suffixes = [x[j:] for x in strings for j in range(len(x))]
    order = {x: n for n, x in enumerate(sorted(set(suffixes)))}
    assert (ranks - 1).tolist() == [order[x] for x in suffixes]
