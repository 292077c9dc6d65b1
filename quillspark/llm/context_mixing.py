"""Language-model scores by online logistic context mixing.

Every document gets the bits that a mixing model, which learns as it reads,
needs to code its bytes. Per bit of a byte, predictors keyed by hashed contexts
give log odds; weights, chosen by a gate (which bit, how many of the long
contexts were seen before, and whether a follower is known), add them; an
adaptive map from that estimate and the bit's place corrects the result.

Predictors. Five count the bits behind the last 1 to 5 bytes of the stream. Two
know the bytes that follow the last two words: one from the document's own
earlier text, one from all *other* documents of the corpus. What these gather
grows with the corpus: every pair of words of every document is sent, with the
four bytes that follow it, to hash ranges, which count the documents behind each
follower and tell the streams the two most frequent of every pair that several
documents have. A document's own share is taken out before one is chosen, so
that copies make each other cheaper, wherever they are, and no text itself.

Distribution. The corpus is split by a hash of the rows into streams of about
``stream_bytes``, whose number follows the corpus. A stream is coded in order of
its rows' hashes, in blocks that grow from 4 KB to ``block`` bytes: a block is
predicted, then learnt. Weights take Newton steps, over a matrix of curvature
summed with a memory of ``MEMORY`` bytes, so smaller blocks learn sooner and not
more restlessly. A stream's head, coded when the counts were empty, is coded again at
the end with its own counts taken out; weights, a few hundred numbers, and the
map keep what they learnt from it. Within a block equal events are computed once
and weighed by their number. Scores depend on which other documents the corpus
has, as for any adaptive model, but not on partitions or retries.

Defined results: null and empty texts have 0 bytes, 0 bits and a null
``bits_per_byte``; repeated rows are scored each, and as the copies they are;
rows whose hashes tie are taken by id; an id that is no whole number fails the
cast; other columns are ignored whatever their names; an empty table gives an
empty result. A very long text spans many blocks and is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import partitions, row_key

ORDERS = (1, 2, 3, 4, 5)
FIRST_BLOCK = 4096
_KNUTH, _MURMUR = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Prior count of each bit value in a predictor; estimates of the adaptive map start with this weight.
PRIOR, MAP_PRIOR = np.float32(0.4), 8.0
STEPS, SPAN = 33, 8.0
#: Bytes over which the weights' curvature is remembered, and its start.
MEMORY, FLOOR = 1 << 20, 20.0
#: Inputs of the mixer: the orders, the two followers and a constant.
INPUTS = len(ORDERS) + 3
#: Bytes of a follower, and what stands for none of it.
FOLLOW, NONE = 4, 15


def contexts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sortable key of each byte: itself, then the five bytes before it, latest first, 0 beyond the text's start."""
    n = len(buf)
    padded = np.concatenate([np.zeros(7, np.uint8), buf])
    # eight bytes read backwards from each position are a little-endian word
    key = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n,), (1,)) & np.uint64(0xFFFFFFFFFFFF0000) if n else np.zeros(0, np.uint64)
    for j in range(5):
        at = off[:-1] + j
        at = at[at < off[1:]]
        key[at] &= np.uint64((0xFFFFFFFFFFFFFFFF << (56 - 8 * j)) & 0xFFFFFFFFFFFFFFFF)
    return key


def key_order(key: np.ndarray) -> np.ndarray:
    """Places of keys in order, equal ones as they come: of each 16 bits only the rank among those that occur is kept,
    which mostly leaves room for the places, so that plain values are sorted."""
    low = len(key).bit_length()
    packed, used = np.zeros(len(key), np.uint64), low
    for piece in key.view("<u2").reshape(-1, 4).T[::-1]:
        piece = piece.astype(np.int64)
        seen = np.zeros(1 << 16, dtype=bool)
        seen[piece] = True
        rank = np.cumsum(seen, dtype=np.uint64)
        bits = int(rank[-1]).bit_length()
        packed <<= np.uint64(bits)
        packed |= rank.take(piece)
        used += bits
    if used > 64:
        return np.argsort(key, kind="stable")
    packed <<= np.uint64(low)
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << low) - 1)
    return packed.view(np.int64)


def by_context(ctx: np.ndarray, follow: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows in the order of context and follower; contexts that stand alone, as most do, need one quick sort."""
    if not len(ctx):
        return rows
    least = ctx.min()
    span = int(ctx.max() - least).bit_length()
    exact = span + len(ctx).bit_length() <= 64  # a range of contexts leaves room for the places
    order = tc.in_order((ctx - least) << np.uint64(min(63, 64 - span))) if exact else np.argsort(ctx)
    same = ctx[order][1:] == ctx[order][:-1]
    if same.any():
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        mine = order[some]
        order[some] = mine[np.lexsort((follow[mine], ctx[mine]))]
    return rows[order]


class Followers:
    """The pairs of words of a stream: place of the next word, text, context and the four bytes from there."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        at, rows, ctx = [], [], []
        lo, n = 0, len(off) - 1
        while lo < n:  # in slices, as the hashes need eight times the bytes
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + tc.SLICE_BYTES, "right")) - 1)
            own = buf[off[lo] : off[hi]]
            start, end, row = tc.word_spans(own, off[lo : hi + 1] - off[lo])
            if len(start) > 2:
                h = tc.SpanHash(own)(start, end)
                third = np.flatnonzero(row[2:] == row[:-2]) + 2
                at.append(start[third] + off[lo])
                rows.append(row[third] + lo)
                ctx.append(tc.mix64(h[third - 2] * np.uint64(31) + h[third - 1]) >> np.uint64(16))
            lo = hi
        empty = np.zeros(0, np.int64)
        self.at, self.row = np.concatenate([empty, *at]), np.concatenate([empty, *rows])
        self.ctx = np.concatenate([empty.astype(np.uint64), *ctx])
        padded = np.concatenate([buf, np.zeros(FOLLOW, np.uint8)])
        raw = np.stack([padded[self.at + j] for j in range(FOLLOW)]) if len(self.at) else np.zeros((FOLLOW, 0), np.uint8)
        left = off[self.row + 1] - self.at
        for j in range(1, FOLLOW):
            raw[j, left <= j] = 0  # not beyond the text
        self.next = sum((raw[j].astype(np.uint32) << np.uint32(8 * j) for j in range(FOLLOW)), np.zeros(len(self.at), np.uint32))

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts and followers, in order, and the number of texts that have them."""
        name = tc.mix64(tc.mix64(self.ctx + np.uint64(1)) ^ (self.next.astype(np.uint64) << np.uint64(32)) ^ self.row.astype(np.uint64))
        order = tc.in_order(name)  # once for each text
        order = order[np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(order)]]
        order = by_context(self.ctx[order], self.next[order], order)
        c, f = self.ctx[order], self.next[order]
        head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (f[1:] != f[:-1])])[: len(c)])
        return c[head], f[head], np.diff(np.append(head, len(c)))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the follower of the same context before it in its text, and whether there is one."""
        order = tc.in_order(tc.mix64(self.ctx ^ (self.row.astype(np.uint64) << np.uint64(48)) ^ (self.row.astype(np.uint64) >> np.uint64(16))))
        same = (self.row[order][1:] == self.row[order][:-1]) & (self.ctx[order][1:] == self.ctx[order][:-1])
        told, has = np.zeros(len(order), np.uint32), np.zeros(len(order), dtype=bool)
        told[order[1:][same]] = self.next[order[:-1][same]]
        has[order[1:][same]] = True
        return told, has

    def others(self, ctx: np.ndarray, follow: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the follower that more other texts have, of the two told for its context, and their number.

        ``follow`` and ``count`` have two rows, for the contexts in order.
        """
        n = len(self.at)
        told, much = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        if not len(ctx) or not n:
            return told, much
        where = np.minimum(tc.places(ctx, self.ctx, 48), len(ctx) - 1)
        some = np.flatnonzero(ctx[where] == self.ctx)
        where = where[some]
        name = lambda f: tc.mix64(tc.mix64(self.ctx[some] ^ (self.row[some].astype(np.uint64) << np.uint64(40))) + f.astype(np.uint64))
        have = np.sort(name(self.next[some]))
        best = np.full(len(some), -1, np.int64)
        for k in range(2):
            mine = name(follow[k][where])
            left = count[k][where] - (have[np.minimum(tc.places(have, mine, 64), len(have) - 1)] == mine)
            better = left > best
            best = np.where(better, left, best)
            told[some[better]] = follow[k][where][better]
        much[some] = np.maximum(best, 0)
        return told, much

    def marks(self, buf: np.ndarray, told: np.ndarray, has: np.ndarray, grade: np.ndarray) -> np.ndarray:
        """For every byte of the stream what a follower says of it: the first bit in which it is wrong (8: none, ``NONE``:
        nothing said) above four bits of its standing: the grade, whether the text's last one was right, and the byte."""
        out = np.full(len(buf), NONE << 4, np.uint8)
        if not len(self.at):
            return out
        right = has & (told == self.next)
        before = np.zeros(len(right), dtype=bool)
        before[1:] = right[:-1] & (self.row[1:] == self.row[:-1])
        standing = (grade.astype(np.int64) & 1) << 3 | before.astype(np.int64) << 2
        alive = has.copy()
        stop = np.append(self.at[1:], len(buf))  # places are in order: the next one's follower takes over
        for j in range(FOLLOW):
            where = self.at + j
            alive &= where < stop
            some = np.flatnonzero(alive)
            c = (told[some] >> np.uint32(8 * j)) & np.uint32(255)
            wrong = (c ^ buf[where[some]]).astype(np.float64)
            bit = np.where(wrong > 0, 7 - np.floor(np.log2(np.maximum(wrong, 1))), 8).astype(np.uint8)
            out[where[some]] = bit << 4 | (standing[some] | j).astype(np.uint8)
            alive[some] = wrong == 0
        return out


def curvature(x: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """``(x * bend) @ x.T`` of a few long rows: half of it, as it is symmetric, in products that read rows once."""
    y, out = x * bend, np.zeros((len(x), len(x)))
    for k in range(len(x)):
        out[k, k:] = out[k:, k] = x[k:] @ y[k]
    return out


class Model:
    """State of one stream."""

    def __init__(self, table_bits: int = 22):
        self.shift = np.uint32(32 - table_bits)
        self.counts = np.zeros((1 << table_bits, 2), np.float32)
        # by bit and gate: the long contexts seen, and three more where a follower is known, which start as those
        self.weights = np.full((8, 6, INPUTS), 0.35, np.float32)
        self.weights[:, :, -1] = 0
        self.started = np.zeros((8, 6), dtype=bool)
        self.curve = np.tile(FLOOR * np.eye(INPUTS), (8, 6, 1, 1))
        self.right = np.full((2, 16, 2, 2), 0.5)  # by follower, standing, first bit or later: wrong and right
        self.right[..., 1] = 4.0
        centre = 1 / (1 + np.exp(-np.linspace(-SPAN, SPAN, STEPS)))
        self.map = np.tile(np.stack([1 - centre, centre], -1) * MAP_PRIOR, (256, 1, 1)).reshape(-1, 2)

    @staticmethod
    def levels(key: np.ndarray, weight: np.ndarray) -> list[tuple]:
        """For each order, its distinct events in sorted keys: first place, length, context hash, byte and weight."""
        byte, levels = (key >> np.uint64(56)).astype(np.uint32), []
        for at, o in enumerate(ORDERS):
            cut = key >> np.uint64(56 - 8 * o)
            first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            mask = np.uint64((1 << (8 * o)) - 1)
            ctx = tc.mix64((cut[first] & mask) * np.uint64(len(ORDERS)) + np.uint64(at)).astype(np.uint32)
            levels.append((first, np.diff(np.append(first, len(key))), ctx, byte[first], np.add.reduceat(weight, first)))
        return levels

    def slots(self, ctx: np.ndarray, byte: np.ndarray, j: int) -> np.ndarray:
        node = (np.uint32(1 << j) | (byte >> np.uint32(8 - j))) * _KNUTH
        return (((ctx ^ node) * _MURMUR) >> self.shift).astype(np.int64)

    def forget(self, key: np.ndarray) -> None:
        """Takes the counts of a block back out."""
        key, times = np.unique(key, return_counts=True)
        flat = self.counts.ravel()
        for _, _, ctx, c, w in self.levels(key, times.astype(np.float32)):
            for j in range(8):
                where = self.slots(ctx, c, j) * 2 + ((c >> np.uint32(7 - j)) & np.uint32(1))
                np.subtract.at(flat, where, w)
        np.maximum(flat, 0, out=flat)

    def code(self, key: np.ndarray) -> np.ndarray:
        """Bits of each byte of a block, given as ``contexts`` keys with the marks of both followers in the low bytes;
        then learns the block."""
        order = key_order(key)
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(head, len(key)))
        key = key[head]
        weight = times.astype(np.float32)
        levels, table = self.levels(key, weight), self.counts.view(np.uint64).ravel()
        said = [(key >> np.uint64(8 * q)).astype(np.uint8) for q in range(2)]
        turn, standing = [(s >> 4).view(np.int8) for s in said], [s & 15 for s in said]
        for t in turn:
            t[t == NONE] = -1
        # events by the long contexts seen, then by the bit up to which a follower is known: gates are ranges
        long, until = np.zeros(len(key), np.int8), np.maximum(*turn)
        for first, spread, ctx, c, _ in levels[-2:]:
            n = table.take(self.slots(ctx, c, 0)).view(np.float32).reshape(-1, 2)
            long += np.repeat(n[:, 0] + n[:, 1] > 0, spread)
        sort = np.argsort(long * np.int8(16) - until, kind="stable")  # of so few bits by counting
        long, until, weight = long[sort], until[sort], weight[sort]
        byte = (key >> np.uint64(56)).astype(np.uint8)[sort]
        source = [np.repeat(np.arange(len(first)), spread)[sort] for first, spread, *_ in levels]
        turn, standing = [t[sort] for t in turn], [s[sort] for s in standing]
        starts = np.searchsorted(long, [0, 1, 2, 3])
        bits, chance = np.zeros(len(key), np.float32), np.ones(len(key), np.float32)
        learn = []
        x = np.empty((INPUTS, len(key)), np.float32)
        x[-1] = 0.3
        dot = np.empty(len(key), np.float32)
        keep = np.exp(-len(order) / MEMORY)
        for j in range(8):
            for at, (_, _, ctx, c, w) in enumerate(levels):
                slot = self.slots(ctx, c, j)
                n = table.take(slot).view(np.float32).reshape(-1, 2)
                np.take(np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)), source[at], out=x[at], mode="clip")
                learn.append((slot * 2 + ((c >> np.uint32(7 - j)) & np.uint32(1)), w))
            one = (byte >> np.uint8(7 - j)) & np.uint8(1)
            bit = one.astype(np.float32)
            active = []
            for q in range(2):
                where = np.flatnonzero(turn[q] >= j)
                hit, cell = turn[q][where] > j, standing[q][where] * 2 + (j > 0)
                odds = np.log(self.right[q, :, :, 1] / self.right[q, :, :, 0]).ravel()[cell]
                x[len(ORDERS) + q] = 0
                x[len(ORDERS) + q, where] = np.where(hit == (bit[where] > 0), odds, -odds)
                active.append((where, hit, cell))
            own, parts = self.weights[j], []
            for g in range(3):
                lo, hi = starts[g], starts[g + 1]
                cut = lo + int(np.searchsorted(-until[lo:hi], -j, "right"))
                if cut > lo and not self.started[j, g + 3]:
                    own[g + 3], self.started[j, g + 3] = own[g], True
                parts += [(g + 3, slice(lo, cut)), (g, slice(cut, hi))]
            for g, part in parts:
                dot[part] = own[g] @ x[:, part]
            np.clip(dot, -12, 12, out=dot)
            p = 1 / (1 + np.exp(-dot))
            place = ((np.clip(dot, -SPAN, SPAN) + SPAN) * np.float32((STEPS - 1) / (2 * SPAN)) + np.float32(0.5)).astype(np.int64)
            cell = (((1 << j) | np.arange(256) >> (8 - j)) * STEPS).take(byte) + place
            refined = (self.map[:, 1] / self.map.sum(1)).astype(np.float32)
            final = (p + refined.take(cell)) * np.float32(0.5)
            chance *= np.abs(1 - bit - final)
            if j % 4 == 3:  # four chances, each over 3e-6, are far from the least of numbers
                bits -= np.log2(chance)
                chance[:] = 1
            # learning: a Newton step for each gate's weights, counts for the maps
            wrong = bit - p
            bend, push = weight * np.maximum(p * (1 - p), wrong * wrong), weight * wrong
            for g, part in parts:
                if part.stop > part.start:
                    own_x = x[:, part]
                    self.curve[j, g] = self.curve[j, g] * keep + curvature(own_x, bend[part])
                    own[g] += np.linalg.solve(self.curve[j, g] + np.eye(INPUTS), own_x @ push[part])
            self.map += np.bincount(cell * 2 + one, weight, 512 * STEPS).reshape(-1, 2)
            for q, (where, hit, cell) in enumerate(active):
                both = np.bincount(cell * 2 + hit, weight[where], 64).reshape(16, 2, 2)
                self.right[q] += both
        flat = self.counts.ravel()
        for where, w in learn:
            np.add.at(flat, where, w)
        back = np.empty(len(key), np.float32)
        back[sort] = bits
        out = np.empty(len(order), np.float32)
        out[order] = np.repeat(back, times)
        return out


def _block(buf: np.ndarray, off: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Keys of the bytes from start to stop; contexts reach back before start but not before a text's own."""
    lo, hi = int(np.searchsorted(off, start, "right")) - 1, int(np.searchsorted(off, stop, "left"))
    base = max(start - 5, int(off[lo]))
    return contexts(buf[base:stop], np.clip(off[lo : hi + 1], base, stop) - base)[start - base :]


def schedule(n: int, block: int) -> list[tuple[int, int]]:
    """Blocks that double in size up to ``block`` bytes."""
    out, start, size = [], 0, min(FIRST_BLOCK, block)
    while start < n:
        out.append((start, min(start + size, n)))
        start, size = out[-1][1], min(size * 2, block)
    return out


_NO_ANSWER = (np.zeros(0, np.uint64), np.zeros((2, 0), np.uint32), np.zeros((2, 0), np.int64))


def score(buf: np.ndarray, off: np.ndarray, told: tuple = _NO_ANSWER, block: int = 1 << 19, table_bits: int = 22, head_bytes: int = 1 << 18) -> np.ndarray:
    """Bits of each text of a stream, in the order given. ``told``: contexts, in order, that several documents of the
    corpus have, with their two most frequent followers and the documents behind each."""
    model, n = Model(table_bits), len(buf)
    pairs = Followers(buf, off)
    follow, has = pairs.own()
    marks = pairs.marks(buf, follow, has, np.zeros(len(has), np.int64)).astype(np.uint16)
    follow, much = pairs.others(*told)
    marks |= pairs.marks(buf, follow, much > 0, much > 1).astype(np.uint16) << np.uint16(8)
    del pairs, follow, has, much
    cost = np.zeros(n + 1)  # of each byte behind the place of the one before it
    code = lambda a, b: model.code(_block(buf, off, a, b) | marks[a:b].astype(np.uint64))
    for start, stop in schedule(n, block):
        cost[start + 1 : stop + 1] = code(start, stop)
    head = min(head_bytes, n // 4)
    for start in range(0, head, block):
        stop = min(start + block, head)
        model.forget(_block(buf, off, start, stop))
        cost[start + 1 : stop + 1] = code(start, stop)
    sums = np.cumsum(cost, out=cost)
    return sums[off[1:]] - sums[off[:-1]]


_BLOBS = "key long, blob binary"
_OUT = "doc_id long, n_bytes long, total_bits double, bits_per_byte double"


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("k", "ascending"), ("i", "ascending")])


def _ask(buckets: int):
    """A stream's pairs of words and what follows them, for the ranges of contexts."""
    edges = np.array([-(-(b << 48) // buckets) for b in range(buckets)], np.uint64)

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        stream = table.column("stream")[0].as_py()
        ctx, follow, n = Followers(*tc.buffers(table.column("t"))).documents()
        cut = np.append(np.searchsorted(ctx, edges), len(ctx))
        full, blobs = np.flatnonzero(np.diff(cut)), []
        for b in full:
            own = slice(cut[b], cut[b + 1])
            many = np.flatnonzero(n[own] > 1)
            blobs.append(tc.squeeze(np.array([stream, cut[b + 1] - cut[b], len(many)], np.int64).tobytes(), tc.planes48(ctx[own]), follow[own].tobytes(), many.astype(np.int32).tobytes(), n[own][many].astype(np.int64).tobytes()))
        return pa.table({"key": pa.array(full, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _follow(table: pa.Table) -> pa.Table:
    """A range of contexts: for each stream those of its own that two documents or more have, with the two followers
    that most documents have; the least of equals."""
    stream, ctx, follow, n = [], [], [], []
    for b in map(tc.unsqueeze, table.column("blob").to_pylist()):
        s, m, many = map(int, np.frombuffer(b, np.int64, 3))
        stream.append(s)
        ctx.append(tc.unplanes48(b[24 : 24 + 6 * m]))
        follow.append(np.frombuffer(b, np.uint32, m, 24 + 6 * m))
        count = np.ones(m, np.int64)
        count[np.frombuffer(b, np.int32, many, 24 + 10 * m)] = np.frombuffer(b, np.int64, many, 24 + 10 * m + 4 * many)
        n.append(count)
    owner = np.repeat(np.arange(len(stream)), [len(c) for c in ctx])
    ctx, follow, n = np.concatenate(ctx), np.concatenate(follow), np.concatenate(n)
    order = by_context(ctx, follow, np.arange(len(ctx)))
    c, f = ctx[order], follow[order]
    head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (f[1:] != f[:-1])]))
    c, f, n = c[head], f[head], np.add.reduceat(n[order], head)
    many = np.flatnonzero(np.concatenate([[False], c[1:] == c[:-1]]))
    if len(many):  # of each context the most frequent first
        some = np.union1d(many, many - 1)
        best = some[np.lexsort((f[some], -n[some], c[some]))]
        f[some], n[some] = f[best], n[best]
    lead = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(lead, len(c)))
    several = np.add.reduceat(n, lead) > 1
    lead, size = lead[several], size[several]
    second = np.minimum(lead + 1, len(c) - 1)
    both = np.stack([f[lead], np.where(size > 1, f[second], 0)]).astype(np.uint32)
    # small numbers that compare alike, whichever of them a document is taken out of
    less = np.where(size > 1, n[second], 0)
    counts = np.stack([np.minimum(less, 3) + np.minimum(n[lead] - less, 3), np.minimum(less, 3)])
    known = c[lead]
    where = np.minimum(np.searchsorted(known, ctx), max(0, len(known) - 1))
    hit = np.flatnonzero(known[where] == ctx) if len(known) else np.zeros(0, np.int64)
    pair = np.unique(owner[hit] * np.int64(len(known) + 1) + where[hit])
    who, what = pair // (len(known) + 1), pair % (len(known) + 1)
    cut = np.append(np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])), len(who)) if len(who) else np.zeros(1, np.int64)
    keys, blobs = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        own = what[a:b]
        keys.append(stream[who[a]])
        blobs.append(tc.squeeze(np.int64(len(own)).tobytes(), tc.planes48(known[own]), both[:, own].tobytes(), counts[:, own].astype(np.uint8).tobytes()))
    return pa.table({"key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _scorer(block: int, table_bits: int):
    @tc.tidy
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ctx, follow, n = [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.uint32)], [np.zeros((2, 0), np.int64)]
        for b in map(tc.unsqueeze, answers.column("blob").to_pylist()):
            m = int(np.frombuffer(b, np.int64, 1)[0])
            ctx.append(tc.unplanes48(b[8 : 8 + 6 * m]))
            follow.append(np.frombuffer(b, np.uint32, 2 * m, 8 + 6 * m).reshape(2, m))
            n.append(np.frombuffer(b, np.uint8, 2 * m, 8 + 14 * m).reshape(2, m).astype(np.int64))
        order = np.argsort(np.concatenate(ctx))
        told = (np.concatenate(ctx)[order], np.concatenate(follow, 1)[:, order], np.concatenate(n, 1)[:, order])
        table = _ordered(texts)
        buf, off = tc.buffers(table.column("t"))
        bits, size = score(buf, off, told, block, table_bits), np.diff(off)
        rate = pa.array(np.divide(bits, size, where=size > 0, out=np.zeros(len(size))), mask=size == 0)
        return pa.table({"doc_id": table.column("i"), "n_bytes": pa.array(size), "total_bits": pa.array(bits), "bits_per_byte": rate})

    return run


def bits_per_byte(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stream_bytes: int = 8 << 20, block: int = 1 << 19, table_bits: int = 22) -> DataFrame:
    """``(doc_id, n_bytes, total_bits, bits_per_byte)`` for every row."""
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    streams = max(1, -(-size // stream_bytes))
    buckets = max(2 * partitions(docs.sparkSession), streams)
    keyed = base.select(row_key("i", "t").alias("k"), "i", F.coalesce("t", F.lit("")).alias("t"))
    texts = keyed.withColumn("stream", F.pmod("k", F.lit(streams))).repartition("stream")
    asked = texts.groupBy("stream").applyInArrow(_ask(buckets), _BLOBS)
    answers = asked.groupBy("key").applyInArrow(tc.tidy(lambda t: _follow(t)), _BLOBS).withColumnRenamed("key", "stream")
    return texts.groupBy("stream").cogroup(answers.groupBy("stream")).applyInArrow(_scorer(block, table_bits), _OUT)
