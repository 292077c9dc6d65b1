import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm import context_mixing as cm


def word_pairs(texts):
    """Place, text, last two words and next four bytes wherever two words precede a word."""
    out = []
    for d, t in enumerate(texts):
        words = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\r\f\x0b]+", t)]
        for k in range(2, len(words)):
            at = words[k][0]
            out.append((d, at, (words[k - 2][1], words[k - 1][1]), t[at : at + 4].ljust(4, b"\0")))
    return out


def slow_followers(texts, corpus):
    """For every byte of the texts what the own and the other documents' follower predicts, and its standing."""
    have, marks = {}, {}
    for doc, _, ctx, follow in word_pairs(corpus):
        have.setdefault(ctx, {}).setdefault(follow, set()).add(corpus[doc])
    for which in range(2):
        latest, right, live = {}, {}, []
        pairs = word_pairs(texts)
        for n, (d, at, ctx, follow) in enumerate(pairs):
            told, grade = None, 0
            if which == 1:
                told = latest.get((d, ctx))
            else:
                # the corpus has no two documents of one text here, so a text stands for its document
                top = sorted(((-len(v), f[::-1], f) for f, v in have.get(ctx, {}).items()))[:2]
                if sum(len(v) for v in have.get(ctx, {}).values()) > 1:
                    best = -1
                    for n0, _, f in top:
                        left = -n0 - (texts[d] in have[ctx][f])
                        if left > best:
                            best, told, grade = left, f, int(left > 1)
                    told = told if best > 0 else None
            if told is not None:
                stop = pairs[n + 1][1] if n + 1 < len(pairs) and pairs[n + 1][0] == d else len(texts[d])
                for j in range(4):
                    if at + j >= stop or told[:j] != texts[d][at : at + j]:
                        break
                    marks.setdefault((d, at + j), [None, None])[which] = (told[j], grade << 3 | right.get(d, 0) << 2 | j)
            latest[d, ctx] = follow
            right[d] = int(told == follow)
    return marks


def slow_score(texts, corpus, block, table_bits, head_bytes):
    """The same model, one byte after the other."""
    orders, prior, inputs = cm.ORDERS, float(cm.PRIOR), cm.INPUTS
    marks = slow_followers(texts, corpus)
    counts, weights = {}, {(j, g): [float(np.float32(0.35))] * (inputs - 1) + [0.0] for j in range(8) for g in range(6)}
    curve, started = {k: cm.FLOOR * np.eye(inputs) for k in weights}, set()
    followers = {}
    amap = {}
    for node in range(256):
        for s in range(cm.STEPS):
            c = 1 / (1 + math.exp(-(-cm.SPAN + 2 * cm.SPAN * s / (cm.STEPS - 1))))
            amap[node, s] = [(1 - c) * cm.MAP_PRIOR, c * cm.MAP_PRIOR]
    data = [(t, i, d) for d, t in enumerate(texts) for i in range(len(t))]
    cost = [0.0] * len(data)

    def slot(t, i, o, node):
        ctx = 0
        for j in range(1, o + 1):
            ctx = ctx << 8 | (t[i - j] if i - j >= 0 else 0)
        h = (ctx * len(orders) + orders.index(o)) & (2**64 - 1)
        h = int(cm.tc.mix64(np.uint64(h))[0]) & 0xFFFFFFFF
        return (((h ^ (node * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - table_bits)

    def run(lo, hi):
        learn = []
        for j in range(8):
            todo, fresh, said = [], [], []
            for p in range(lo, hi):
                t, i, d = data[p]
                c = t[i]
                node, bit = (1 << j) | (c >> (8 - j)), (c >> (7 - j)) & 1
                x, seen = [], 0
                for k, o in enumerate(orders):
                    s = slot(t, i, o, node)
                    n = counts.get(s, [0, 0])
                    x.append(math.log((n[1] + prior) / (n[0] + prior)))
                    learn.append((s, bit))
                    if k >= len(orders) - 2:
                        seen += sum(counts.get(slot(t, i, o, 1), [0, 0])) > 0
                known = 0
                for q, m in enumerate(reversed(marks.get((d, i), [None, None]))):
                    if m is None or m[0] >> (8 - j) != c >> (8 - j):
                        x.append(0.0)
                        continue
                    cell, guess = (q, m[1], j > 0), (m[0] >> (7 - j)) & 1
                    n = followers.get(cell, [0.5, 4.0])
                    odds = math.log(n[1] / n[0])
                    x.append(odds if guess else -odds)
                    said.append((cell, guess == bit))
                    known = 3
                x.append(0.3)
                gate = seen + known
                if known and (j, gate) not in started:
                    weights[j, gate] = list(weights[j, seen])
                    started.add((j, gate))
                dot = max(-12, min(12, sum(a * b for a, b in zip(weights[j, gate], x))))
                pr = 1 / (1 + math.exp(-dot))
                place = int((max(-cm.SPAN, min(cm.SPAN, dot)) + cm.SPAN) * ((cm.STEPS - 1) / (2 * cm.SPAN)) + 0.5)
                m = amap[node, place]
                final = (pr + m[1] / (m[0] + m[1])) / 2
                cost[p] -= math.log2(final if bit else 1 - final)
                todo.append((gate, pr, bit, x))
                fresh.append((node, place, bit))
            for g in range(6):
                mine = [(b - p, max(p * (1 - p), (b - p) ** 2), np.array(x)) for s, p, b, x in todo if s == g]
                if mine:
                    curve[j, g] = curve[j, g] * math.exp(-(hi - lo) / cm.MEMORY) + sum(c * np.outer(x, x) for _, c, x in mine)
                    weights[j, g] = list(np.array(weights[j, g]) + np.linalg.solve(curve[j, g] + np.eye(inputs), sum(r * x for r, _, x in mine)))
            for node, place, bit in fresh:
                amap[node, place][bit] += 1
            for cell, hit in said:
                followers.setdefault(cell, [0.5, 4.0])[hit] += 1
        for s, bit in learn:
            counts.setdefault(s, [0, 0])[bit] += 1

    for lo, hi in cm.schedule(len(data), block):
        run(lo, hi)
    head = min(head_bytes, len(data) // 4)
    for lo in range(0, head, block):
        hi = min(lo + block, head)
        for p in range(lo, hi):
            t, i, _ = data[p]
            for o in orders:
                for j in range(8):
                    n = counts[slot(t, i, o, (1 << j) | (t[i] >> (8 - j)))]
                    n[(t[i] >> (7 - j)) & 1] -= 1
            cost[p] = 0.0
        run(lo, hi)
    out, at = [], 0
    for t in texts:
        out.append(sum(cost[at : at + len(t)]))
        at += len(t)
    return out


def answers(streams):
    """What the ranges of contexts tell the first stream, through the steps of the query."""
    ask, rows = cm._ask(3), {}
    for n, texts in enumerate(streams):
        t = ask(pa.table({"stream": [n] * len(texts), "t": pa.array(texts, pa.binary())}))
        for key, blob in zip(t.column("key").to_pylist(), t.column("blob").to_pylist()):
            rows.setdefault(key, []).append(blob)
    out = [cm._follow(pa.table({"key": [k] * len(v), "blob": pa.array(v, pa.binary())})) for k, v in rows.items()]
    out = pa.concat_tables([t.filter(pc.equal(t.column("key"), 0)) for t in out])
    told = {}

    def keep(buf, off, found, *_):
        told["answer"] = found
        return np.zeros(len(off) - 1)

    real, cm.score = cm.score, keep
    try:
        cm._scorer(1, 1)(pa.table({"k": [0], "i": [0], "t": ["x"]}), out)
    finally:
        cm.score = real
    return told["answer"]


def _flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_equals_byte_by_byte_model(prose, monkeypatch):
    monkeypatch.setattr(cm, "FIRST_BLOCK", 64)
    monkeypatch.setattr(cm, "MEMORY", 500)
    shared = prose(50, 9)
    texts = [f"{prose(i, 7)} {shared} {prose(20 + i, 4)}".encode() for i in range(4)] + [b"", "größe é".encode(), (prose(9, 3) + " ").encode() * 4]
    others = [f"{prose(30 + i, 3)} {shared[: 20 + 9 * i]}".encode() for i in range(4)] + [texts[1] + b" more"]
    told = answers([texts, others])
    assert len(told[0])
    got = cm.score(*_flat(texts), told, block=256, table_bits=18, head_bytes=100)
    want = slow_score(texts, texts + others, 256, 18, 100)
    assert np.allclose(got, want, rtol=2e-3, atol=0.05)


def test_smaller_blocks_cost_no_more(prose):
    texts = [(prose(i, 60) + "\n").encode() * (1 + i % 3) for i in range(300)]
    whole = [cm.score(*_flat(texts), block=b).sum() for b in (1 << 17, 1 << 15, 1 << 13)]
    assert whole[0] > whole[1] > whole[2]


def test_repeated_line_is_cheap(prose):
    texts = [(prose(i, 60) + "\n").encode() * (1 + i % 2) for i in range(300)]
    plain = cm.score(*_flat(texts))
    texts += [(prose(999, 12) + "\n").encode() * 400]
    bits = cm.score(*_flat(texts))
    assert bits[-1] / len(texts[-1]) < 0.35 * plain.sum() / sum(map(len, texts[:-1]))
    assert bits[:-1].sum() < 1.1 * plain.sum()  # and the others pay nothing for it


def test_copies_in_other_streams_are_cheaper(frame, prose):
    """What the corpus gathers reaches every stream: a text that stands twice is told from those that stand once."""
    rows = [(i, prose(i, 120)) for i in range(220)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    rate = {r["doc_id"]: r["bits_per_byte"] for r in cm.bits_per_byte(frame(rows), stream_bytes=40_000).collect()}
    twice = [rate[i] for i in range(20)] + [rate[1000 + i] for i in range(20)]
    once = sorted(rate[i] for i in range(20, 220))
    assert sum(x < once[20] for x in twice) >= 38


def test_learns_and_ranks(prose):
    r = random.Random(0)
    texts = [prose(i, 300).encode() for i in range(150)]
    noise = bytes(r.randrange(256) for _ in range(3000))
    buf, off = _flat([*texts, noise, texts[5]])
    bits = cm.score(buf, off)
    rate = bits / np.diff(off)
    assert rate[-2] > 7.5 and rate[100:150].max() < 3.5
    assert rate[-1] < rate[100:150].mean()
    assert abs(rate[:20].mean() - rate[120:150].mean()) < 0.5  # the head is judged like the rest


def test_blocks_cover_texts_across_their_edges(prose):
    texts = [prose(i, 50).encode() for i in range(20)]
    buf, off = _flat(texts)
    key = cm.contexts(buf, off)
    for lo, hi in ((0, 100), (100, 357), (357, len(buf))):
        assert (cm._block(buf, off, lo, hi) == key[lo:hi]).all()


def test_query_over_odd_rows(frame, prose):
    rows = [(1, None), (2, ""), (3, prose(1, 50)), (3, prose(1, 50)), (None, "x y z"), (4, prose(2, 20_000)), (5, " "), (6, "a")]
    got = cm.bits_per_byte(frame(rows, "stream")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2):
        assert by[i][0]["n_bytes"] == 0 and by[i][0]["total_bits"] == 0 and by[i][0]["bits_per_byte"] is None
    assert len(by[3]) == 2 and by[4][0]["n_bytes"] == len(prose(2, 20_000))
    assert cm.bits_per_byte(frame([])).count() == 0


def test_partitions_do_not_matter(frame, prose):
    rows = [(i, prose(i, 40)) for i in range(60)]
    a = sorted(map(tuple, cm.bits_per_byte(frame(rows), stream_bytes=4000).collect()))
    b = sorted(map(tuple, cm.bits_per_byte(frame(rows[::-1]).repartition(7), stream_bytes=4000).collect()))
    assert a == b


def test_blocks_sort_plain_values(prose, monkeypatch):
    """Sorting places by their keys took most of a block's time beside its counts; what is left are keys of 8 bits."""
    buf, off = _flat([prose(i, 50).encode() for i in range(40)])
    key, model, kinds, real = cm._block(buf, off, 0, len(buf)), cm.Model(18), [], np.argsort

    def spy(a, *args, **kwargs):
        kinds.append(a.dtype.itemsize)
        return real(a, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", spy)
    model.code(key)
    assert max(kinds) == 1


def test_key_order_is_a_stable_sort(prose):
    buf, off = _flat([prose(i % 9, 50).encode() for i in range(40)])
    r = np.random.default_rng(0)
    marks = r.integers(0, 1 << 16, len(buf), dtype=np.uint64)
    wide = r.integers(0, 1 << 64, 5000, dtype=np.uint64)  # its ranks leave no room for places
    for key in (cm.contexts(buf, off), cm.contexts(buf, off) | marks, np.repeat(wide, 2), wide[:1], wide[:0], np.full(9, (1 << 64) - 1, np.uint64)):
        assert (cm.key_order(key) == np.argsort(key, kind="stable")).all()


def test_improbable_bytes_cost_finite_bits():
    """Chances of several bits are multiplied before their logarithm is taken; the least of them must not vanish."""
    r = random.Random(1)
    noise = bytes(r.randrange(128, 256) for _ in range(2000))
    bits = cm.score(*_flat([b"a" * 200_000, noise]), block=1 << 13)
    assert np.isfinite(bits).all() and bits[1] / len(noise) > 6
