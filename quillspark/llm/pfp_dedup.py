"""Repeated passages from a suffix array of the corpus by prefix-free parsing.

*Parse.* A Karp-Rabin hash of every ``window`` bytes marks triggers (one in
``modulus``); a phrase runs from one trigger window to the end of the next, so
neighbours overlap by a window, no phrase is a proper prefix of another
suffix of the parse, and equal text has equal phrases wherever it stands.

*Dictionary.* Distinct phrases, known by 48-bit digest, are counted in digest
ranges. Text whose phrases occur once can't be part of a repeat that spans a
phrase, so highly repetitive text is all that the following steps see. Phrases
of over ``min_bytes``, as text without triggers gives, take part with each of
their windows of ``min_bytes`` instead, so that a repeat inside a phrase counts.

*Corpus order.* A suffix of the corpus is a suffix of a dictionary phrase,
followed by a suffix of the parse. Parse suffixes that stay in repeated phrases
are sent, with the bytes before their first phrase, to the range of that
phrase. A task builds the suffix array of the parse it sees, as strings of
phrase ranks, and the suffix array of the dictionary bytes it sees, both by
prefix doubling, and merges them: every byte's suffix is placed by the rank of
its part in the dictionary, then by the rank of the parse behind it.
Neighbours in that order that agree over ``min_bytes``, rounded up to the end
of a phrase, form an interval, whose first occurrence, by document id, key and
place, stays.

The order of phrases in the parse is that of their digests rather than of their
bytes; intervals are the same under any order of the alphabet. So a byte belongs
to a repeat when the text from it, or from one before it, over ``min_bytes`` and
on to the next phrase end, stands somewhere before: repeats begin at their exact
byte, and up to one phrase at their end stays out.

Each batch of documents answers for its own copies: it sends a digest, or a
suffix, once however often it holds it, so a passage that is everywhere puts no
more rows into a task than there are batches. The first occurrence that the range
finds for a suffix goes back to its batch, whose own copies then name it too.

Defined results: null and empty texts have no repeats; repeated rows, with
equal id and text, are one document; a run without triggers (one repeated
byte, a rule of dashes) repeats itself from its second byte on; a very long
text is cut into batches by rows only and is one document; rows without id sort
before others; an id that is no whole number fails the cast; other columns pass
through or are ignored whatever their names; an empty table gives no rows. The
input must give its rows in the same order when it is read again, as files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_dedup
from . import textcore as tc
from .cluster import buckets_for, row_key
from .ngram_jaccard import pack48, unpack48

_ROWS = "kind int, key long, blob binary"
BITS = 48
#: Most documents, and about the most bytes of text, of a batch.
FLUSH_ROWS, FLUSH_BYTES = 1 << 14, 16_000_000
_INSIDE = np.uint64(0x517CC1B727220A95)


def _rows(kind, key, blob) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "blob": pa.array(blob, pa.binary())})


def parse(buf: np.ndarray, off: np.ndarray, window: int, modulus: int, spans: tc.SpanHash | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and 48-bit digest of each phrase, in text order."""
    n = len(buf)
    rows = np.flatnonzero(np.diff(off) > 0)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    spans = spans or tc.SpanHash(buf)
    ends = np.zeros(0, np.int64)
    if n >= window:
        at = np.arange(window, n + 1)
        ends = at[spans(at - window, at) % np.uint64(modulus) == 0]
        row = np.searchsorted(off, ends - 1, "right") - 1
        ends = ends[(ends - window >= off[row]) & (ends < off[row + 1])]
    stop = np.unique(np.concatenate([ends, off[1:][rows]]))
    row = np.searchsorted(off, stop - 1, "right") - 1
    start = np.concatenate([[0], stop[:-1]])
    start = np.where(start <= off[row], off[row], start - window)
    return row, start, stop, spans(start, stop) >> np.uint64(64 - BITS)


def inside(start: np.ndarray, stop: np.ndarray, spans: tc.SpanHash, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, place and digest of every window of ``min_bytes`` that lies in one phrase."""
    room = np.maximum(0, stop - start - min_bytes + 1)
    owner = np.repeat(np.arange(len(start)), room)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
    return owner, at, tc.mix64(spans(at, at + min_bytes) ^ _INSIDE) >> np.uint64(64 - BITS)


def suffix_array(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of given strings of symbols, and of each the number of symbols it shares with the one before.

    ``bounds`` holds the strings' ends in ``symbols``. Prefix doubling: names of
    twice the length are ranks of pairs of names, a shorter string coming first.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the dictionary: symbols in order, as ranks from 1; 0 stands for the end
    _, rank = np.unique(symbols, return_inverse=True)
    width = int(size.max())
    table = np.zeros((n, width), np.int64)
    full = np.arange(width)[None, :] < size[:, None]
    table[full] = rank + 1
    names, step = table, 1
    while names.shape[1] > 1:
        right = np.zeros((n, names.shape[1]), np.int64)
        right[:, : names.shape[1] - 1] = names[:, 1:]
        if names.shape[1] % 2:
            names, right = np.pad(names, ((0, 0), (0, 1))), np.pad(right, ((0, 0), (0, 1)))
        pair = names[:, ::2] * (int(right.max()) + 1) + right[:, ::2]
        _, flat = np.unique(pair, return_inverse=True)
        names, step = flat.reshape(pair.shape) + 1, step * 2
    order = np.argsort(names[:, 0], kind="stable")
    ordered = table[order]
    same = np.zeros((n, width), dtype=bool)
    same[1:] = (ordered[1:] == ordered[:-1]) & (ordered[1:] > 0)
    return order, np.cumprod(same, axis=1).sum(1)


def dictionary_ranks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The suffix array of given byte strings as the rank of each byte's suffix; equal suffixes have equal ranks.

    Prefix doubling over all strings at once: a round compares twice as many bytes, and a string's end sorts first.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes from here to the string's end
    rank, step = buf.astype(np.int64) + 1, 1
    most = int(left.max())
    while True:
        right = np.zeros(n, np.int64)
        if step < n:
            right[: n - step] = np.where(left[: n - step] > step, rank[step:], 0)
        pair = rank * (int(rank.max()) + 2) + right
        _, rank = np.unique(pair, return_inverse=True)
        rank += 1
        step *= 2
        if step >= most:
            return rank


def _parser(window: int, modulus: int, min_bytes: int, buckets: int):
    edges = np.array([-(-(b << BITS) // buckets) for b in range(buckets)], np.uint64)

    @tc.tidy
    def run(batches):
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                off = tc.buffers(batch.column("t"))[1]
                stop = int(np.searchsorted(off, off[start] + FLUSH_BYTES, "right")) - 1
                stop = min(max(stop, start + 1), start + FLUSH_ROWS, batch.num_rows)
                part = batch.slice(start, stop - start)
                start, held = stop, []
                for s in tc.slices(part, "t"):
                    buf, own = tc.buffers(s.column("t"))
                    spans = tc.SpanHash(buf)
                    _, a, b, digest = parse(buf, own, window, modulus, spans)
                    held += [digest, inside(a, b, spans, min_bytes)[2]]
                digest = np.concatenate(held) if held else np.zeros(0, np.uint64)
                if not len(digest):
                    continue
                k = part.column("k").to_numpy()
                flush = tc.signed(tc.mix64(k.view(np.uint64)).sum() + np.uint64(len(k)))
                i, known = part.column("i").fill_null(0).to_numpy(), part.column("i").is_valid().to_numpy(zero_copy_only=False)
                buf, own = tc.buffers(part.column("t"))
                # the texts themselves wait for the answers; they are parsed again rather than sent as phrases
                yield _rows([1], [flush], [tc.squeeze(np.int64(len(k)).tobytes(), k.tobytes(), i.tobytes(), known.astype(np.int8).tobytes(), np.diff(own).astype(np.int64).tobytes(), buf.tobytes())])
                value, count = np.unique(digest, return_counts=True)
                cut = np.append(np.searchsorted(value, edges), len(value))
                full = np.flatnonzero(np.diff(cut))
                lead = np.int64(flush).tobytes()
                yield _rows([0] * len(full), full, [lead + (count[cut[b] : cut[b + 1]] > 1).tobytes() + pack48(value[cut[b] : cut[b + 1]]) for b in full])

    return run


def _dictionary(table: pa.Table) -> pa.Table:
    """A range of digests: for each batch those of its phrases that the corpus has twice or more."""
    flush, values, multi = [], [], []
    for b in table.column("blob").to_pylist():
        n = (len(b) - 8) // 7
        flush.append(np.frombuffer(b, np.int64, 1)[0])
        multi.append(np.frombuffer(b, np.bool_, n, 8))
        values.append(unpack48(b[8 + n :]))
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    value, multi = np.concatenate(values), np.concatenate(multi)
    order = np.argsort(value, kind="stable")
    value, owner, multi = value[order], owner[order], multi[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(first, len(value)))
    keep = np.repeat((count > 1) | np.logical_or.reduceat(multi, first), count)
    value, owner = value[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    who, begin = np.unique(owner, return_index=True)
    end = np.append(begin[1:], len(owner))
    return pa.table({"kind": pa.array([2] * len(who), pa.int32()), "key": pa.array([flush[w] for w in who], pa.int64()), "blob": pa.array([pack48(value[s:e]) for s, e in zip(begin, end)], pa.binary())})


_MARK = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("src", pa.int64()), ("at", pa.int32())])
_MARKS = "k long, id long, s int, e int, src long, at int"
_PACKED = (np.int64, np.int64, np.int8, np.int32, np.int32, np.int64, np.int8, np.int32)
#: Marks of a batch's own also have the key of the document they name.
_OWN = (*_PACKED, np.int64)


def _pick_first(group: np.ndarray, known: np.ndarray, i: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each row the index of the first occurrence in its group, by id (null first), key and place."""
    order = np.lexsort((s, k, i, known, group))
    lead = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    first = np.empty(len(group), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    return first


def _marks(k, i, known, s, e, first) -> list[np.ndarray]:
    """Every row that is not its group's first: key, id, whether it has one, start, end, and id, place and key of the first."""
    away = (k != k[first]) | (s != s[first])
    at = first[away]
    return [k[away], i[away], known[away], s[away], e[away], i[at], known[at], s[at], k[at]]


def _pack(marks: list[np.ndarray], kinds: tuple) -> bytes:
    return np.int64(len(marks[0])).tobytes() + b"".join(m.astype(t).tobytes() for m, t in zip(marks, kinds))


def _unpack(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in kinds]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for part, t in zip(parts, kinds):
            part.append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def _joined(marks: list[np.ndarray], keep: np.ndarray | None = None) -> list[np.ndarray]:
    """Marks in order of document and place, touching ones made one; it keeps the source of its first.

    ``keep``: groups of marks of which only those of one group are joined.
    """
    k, s, e = marks[0], marks[3], marks[4]
    if not len(k):
        return marks
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] > e[:-1])])
    if keep is not None:
        fresh[1:] |= keep[1:] != keep[:-1]
    head = np.flatnonzero(fresh)
    out = [m[head] for m in marks]
    out[4] = np.maximum.reduceat(e, head)
    return out


def _mark_table(k, i, known, s, e, src, src_known, at) -> pa.Table:
    ids = lambda x, has: pa.array(x, mask=has == 0)
    return pa.table([pa.array(k), ids(i, known), pa.array(s), pa.array(e), ids(src, src_known), pa.array(at)], schema=_MARK)


#: A parse suffix: key, id and whether it has one of its document, byte of its first phrase, bytes before it that take
#: part, and the number of its phrases.
_SUFFIX = (np.int64, np.int64, np.int8, np.int32, np.int32, np.int32)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the ranges of this size from these starts."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _suffixes(window: int, modulus: int, min_bytes: int, buckets: int):
    """A batch of documents: its parse suffixes that are repeated phrases over ``min_bytes``, with the bytes before
    them, each distinct one once for the range of its first phrase; further copies in the batch are marked here."""
    edges = np.array([-(-(b << BITS) // buckets) for b in range(buckets)], np.uint64)
    nothing = pa.Table.from_batches([_rows([], [], [])])

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        answers = [unpack48(b) for kind, b in zip(kinds, blobs) if kind == 2]
        if 1 not in kinds or not answers:
            return nothing
        b, flush = tc.unsqueeze(blobs[kinds.index(1)]), table.column("key")[0].as_py()
        del table, blobs
        n = int(np.frombuffer(b, np.int64, 1)[0])
        k, i = np.frombuffer(b, np.int64, n, 8), np.frombuffer(b, np.int64, n, 8 + 8 * n)
        known = np.frombuffer(b, np.int8, n, 8 + 16 * n)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(b, np.int64, n, 8 + 17 * n))])
        buf = np.frombuffer(b, np.uint8, int(off[-1]), 8 + 25 * n)
        repeated = np.unique(np.concatenate(answers))
        known_value = lambda x: repeated[np.minimum(np.searchsorted(repeated, x), len(repeated) - 1)] == x
        held: list[list[np.ndarray]] = [[] for _ in range(8)]
        lo = 0
        while lo < n:  # in slices, as the hashes need eight times the bytes
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + tc.SLICE_BYTES, "right")) - 1)
            own, base = buf[off[lo] : off[hi]], off[lo]
            spans = tc.SpanHash(own)
            row, a, e, digest = parse(own, off[lo : hi + 1] - base, window, modulus, spans)
            good = known_value(digest)
            # the last phrase from here on that is repeated and of this document
            fresh = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            run_id = np.cumsum(~good | fresh)
            last = np.searchsorted(run_id, run_id, "right") - 1
            # bytes before a phrase that are suffixes of the one before it; windows inside a phrase are told by themselves
            before_end = np.concatenate([[0], e[:-1]])[: len(row)]
            prev = np.where(fresh, a, np.maximum(np.concatenate([[0], a[:-1]])[: len(row)] + 1, before_end - min_bytes + 1))
            until = np.minimum(a - (e - a >= min_bytes), e[last] - min_bytes)
            pick = np.flatnonzero(good & (until >= prev))
            # as many phrases as the last of these bytes needs
            big = e + row * np.int64(1 << 40)
            reach = np.searchsorted(big, until[pick] + min_bytes + row[pick] * np.int64(1 << 40), "left")
            index = _ragged(pick, reach - pick + 1)
            owner, at, told = inside(a, e, spans, min_bytes)
            fits = known_value(told)
            owner, at, told = owner[fits], at[fits], told[fits]
            # a window inside a phrase is a suffix of one symbol, with no bytes before it
            one, none = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
            rel = e[index] - np.repeat(a[pick], reach - pick + 1)
            found = (row[pick], a[pick], reach - pick + 1, (a - prev)[pick], e[reach], digest[index], rel), (row[owner], at, -one, none, at + min_bytes, told, one * min_bytes)
            for slot, pair in enumerate(zip(*found)):
                held[slot].append(np.concatenate(pair) + (lo if not slot else base if slot in (1, 4) else pair[0].dtype.type(0)))
            held[7].append(spans(prev[pick], a[pick]))
            held[7].append(none.astype(np.uint64))
            lo = hi
        row, place, size, before, stop, symbols, rel, name = (np.concatenate(x) for x in held)
        if not len(row):
            return nothing
        count = np.abs(size)
        bounds = np.concatenate([[0], np.cumsum(count)])
        name = tc.mix64(name * np.uint64(31) + (size < 0).astype(np.uint64))
        for j in range(int(count.max())):
            more = np.flatnonzero(count > j)
            name[more] = tc.mix64(name[more] * np.uint64(31) + symbols[bounds[more] + j])
        _, group = np.unique(name, return_inverse=True)
        kk, ii, nn, origin = k[row], i[row], known[row], off[row]
        s, e = place - before - origin, stop - origin
        first = _pick_first(group, nn, ii, kk, s)
        order = np.lexsort((s, kk))
        here = _joined(_marks(*(x[order] for x in (kk, ii, nn, s, e)), np.argsort(order)[first[order]]))
        lead = np.unique(first)
        front = symbols[bounds[lead]]
        order = np.argsort(front, kind="stable")
        lead, front = lead[order], front[order]
        cut = np.append(np.searchsorted(front, edges), len(front))
        full, sent = np.flatnonzero(np.diff(cut)), []
        for f in full:
            own = lead[cut[f] : cut[f + 1]]
            numbers = (kk[own], ii[own], nn[own], place[own] - origin[own], before[own], size[own])
            text = buf[_ragged(place[own] - before[own], before[own])].tobytes()
            index = _ragged(bounds[own], count[own])
            sent.append(tc.squeeze(np.array([flush, len(own), len(text), len(index)], np.int64).tobytes(), *(x.astype(t).tobytes() for x, t in zip(numbers, _SUFFIX)), text, pack48(symbols[index]), rel[index].astype(np.int32).tobytes()))
        kinds = [1] * len(sent)
        if len(here[0]):  # these marks pass through the next step with the suffixes
            full, kinds = np.append(full, abs(int(here[0][0])) % buckets), [*kinds, 0]
            sent.append(np.int64(flush).tobytes() + _pack(here, _OWN))
        return pa.Table.from_batches([_rows(kinds, full, sent)])

    return run


def _corpus_order(min_bytes: int):
    """A range of first phrases: the suffixes of the corpus that begin in or just before them, in order, and for each
    batch the bytes whose suffix isn't its interval's first."""

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in range(10)]
        key, through = [], []
        for told, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if not told:
                key.append(int(np.frombuffer(b, np.int64, 1)[0]))
                through.append(b[8:])
                continue
            b = tc.unsqueeze(b)
            flush, n, width, m = map(int, np.frombuffer(b, np.int64, 4))
            at = 32
            for slot, kind in enumerate(_SUFFIX):
                parts[slot].append(np.frombuffer(b, kind, n, at))
                at += n * np.dtype(kind).itemsize
            parts[6].append(np.frombuffer(b, np.uint8, width, at))
            parts[7].append(unpack48(b[at + width : at + width + 6 * m]))
            parts[8].append(np.frombuffer(b, np.int32, m, at + width + 6 * m))
            parts[9].append(np.full(n, flush))
        passed = pa.Table.from_batches([_rows([0] * len(through), key, through)])
        if not parts[0]:
            return passed
        k, i, known, place, before, size, text, symbols, rel, batch = (np.concatenate(p) for p in parts)
        before, rel, place = before.astype(np.int64), rel.astype(np.int64), place.astype(np.int64)
        count = np.abs(size).astype(np.int64)
        # suffixes in order of their document and place
        order = np.lexsort((batch, place, k, i, known))
        lead = np.cumsum(before) - before
        lo = np.cumsum(count) - count
        index = _ragged(lo[order], count[order])
        symbols, rel = symbols[index], rel[index]
        text = text[_ragged(lead[order], before[order])]
        k, i, known, place, before, size, batch, count = (x[order] for x in (k, i, known, place, before, size, batch, count))
        bounds = np.concatenate([[0], np.cumsum(count)])
        head = np.concatenate([[0], np.cumsum(before)])
        n = len(k)
        # the suffix array of the parse; for each depth, suffixes that agree so far have one name
        order, shared = suffix_array(symbols, bounds)
        depth = int(count.max())
        names = np.empty((depth, n), np.int64)
        for m in range(depth):
            names[m, order] = np.cumsum(shared < m + 1)
        # the suffix array of the dictionary: the distinct strings before a first phrase
        if len(text):
            told = tc.SpanHash(text)(head[:-1], head[1:])
            _, sample, which = np.unique(told, return_index=True, return_inverse=True)
            length = before[sample]
            own = np.concatenate([[0], np.cumsum(length)])
            ranks = np.append(dictionary_ranks(text[_ragged(head[sample], length)], own), 0)
        else:
            own, which, ranks = np.zeros(1, np.int64), np.zeros(n, np.int64), np.zeros(1, np.int64)
        # every byte's suffix: its part in the dictionary, then the parse
        who = np.repeat(np.arange(n), before + 1)
        o = np.arange(len(who)) - np.repeat(head[:-1] + np.arange(n), before + 1)
        rest = before[who] - o
        alpha = np.where(rest > 0, ranks[np.where(rest > 0, own[which[who]] + o, 0)], 0)
        big = rel + np.repeat(np.arange(n), count) * np.int64(1 << 40)
        end = np.searchsorted(big, min_bytes - rest + who * np.int64(1 << 40), "left")
        valid = (end < bounds[who + 1]) & ((rest > 0) | (size[who] < 0) | (rel[bounds[who]] < min_bytes))
        who, alpha, rest, end = who[valid], alpha[valid], rest[valid], end[valid]
        deep = end - bounds[who]
        merged = (alpha * np.int64(n + 1) + names[deep, who]) * np.int64(depth + 1) + deep
        _, first, interval = np.unique(merged, return_index=True, return_inverse=True)
        first = first[interval]
        s, e = place[who] - rest, place[who] + rel[end]
        marks = _marks(k[who], i[who], known[who], s, e, first)
        away = who[(k[who] != k[who][first]) | (s != s[first])]
        head = np.concatenate([[True], (away[1:] != away[:-1]) | (marks[3][1:] > marks[3][:-1] + 1)])[: len(away)]
        marks, away = _joined(marks, np.cumsum(head)), batch[away[head]]
        order = np.argsort(away, kind="stable")
        who, begin = np.unique(away[order], return_index=True)
        blobs = [_pack([m[own] for m in marks], _PACKED) for own in np.split(order, begin[1:])] if len(who) else []
        return pa.concat_tables([passed, pa.Table.from_batches([_rows([1] * len(who), who, blobs)])])

    return run


def _settled(table: pa.Table) -> pa.Table:
    """A batch's marks: those of the corpus order, and its own, which name the first occurrence in the corpus."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    told = _unpack([b for kind, b in zip(kinds, blobs) if kind == 1], _PACKED)
    *own, lead = _unpack([b for kind, b in zip(kinds, blobs) if kind == 0], _OWN)
    if len(lead) and len(told[0]):
        _, doc = np.unique(np.concatenate([told[0], lead]), return_inverse=True)
        spot = (doc.astype(np.int64) << 32) | np.concatenate([told[3], own[7]])
        known, asked = spot[: len(told[0])], spot[len(told[0]) :]
        order = np.argsort(known, kind="stable")
        near = order[np.minimum(np.searchsorted(known, asked, sorter=order), len(order) - 1)]
        moved = known[near] == asked
        for c in (5, 6, 7):
            own[c] = np.where(moved, told[c][near], own[c])
    return _mark_table(*(np.concatenate(x) for x in zip(told, own)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, modulus: int = 20, min_bytes: int = 112) -> DataFrame:
    """Byte spans ``(k, id, s, e, src, at)`` of passages that repeat an earlier one; src and at name the first."""
    buckets = buckets_for(docs, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null and t <> ''")
    raw = base.select(row_key("i", "t").alias("k"), "i", "t").mapInArrow(_parser(window, modulus, min_bytes, buckets), _ROWS)
    answers = raw.where("kind = 0").groupBy("key").applyInArrow(tc.tidy(lambda t: _dictionary(t)), _ROWS)
    found = raw.where("kind = 1").union(answers).groupBy("key").applyInArrow(_suffixes(window, modulus, min_bytes, buckets), _ROWS)
    ordered = found.groupBy("key").applyInArrow(_corpus_order(min_bytes), _ROWS)
    marks = ordered.groupBy("key").applyInArrow(tc.tidy(lambda t: _settled(t)), _MARKS)
    return chunk_dedup.runs(marks, min_bytes)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per repeated passage: document, bytes from and to, and the document and byte of the first occurrence."""
    spans = repeated_spans(docs, id_col, text_col, **how)
    return spans.select(F.col("id").alias("doc_id"), F.col("s").alias("start_byte"), F.col("e").alias("end_byte"), F.col("src").alias("first_doc_id"), F.col("at").alias("first_byte"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The documents with every repeated passage cut out but at its first occurrence.

    Spans begin and end at hashed windows of bytes; ends that fall inside a
    UTF-8 character are moved inwards to whole characters when text is cut.
    """
    return chunk_dedup.without_spans(docs, repeated_spans(docs, id_col, text_col, **how), id_col, text_col, chars_col)
