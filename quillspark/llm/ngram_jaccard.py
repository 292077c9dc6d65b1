"""N-gram Jaccard self-join by a grouped prefix join.

Finds all pairs of documents whose sets of word n-grams have a Jaccard
similarity of ``threshold`` or more. Exact but for collisions of 48-bit n-gram
hashes. The steps:

1. *Document frequencies.* Each batch of documents sends its sorted n-gram
   hashes, packed as byte planes, to hash-range buckets. A bucket answers only
   for hashes that two documents or more hold; the rest can't be in any
   overlap. Text is read once and never shuffled.
2. *Prefixes.* With n-grams ordered by rising frequency, two sets can only
   reach the threshold if their prefixes of ``size - ceil(t * size) + 1``
   n-grams share one. N-grams of one document come first in that order, so most
   documents that resemble no other have no prefix left to index.
3. *Groups.* Documents with equal n-gram sets become one class, classes with
   the same size and prefix one group; the prefix index holds groups.
4. *Candidates.* The posting lists of a token are sent to the list's least
   group ("leader"), so that the many lists of one cluster of copies meet in
   few places, where a bit matrix collects each pair of groups once. Pairs
   whose sizes rule the threshold out are dropped.
5. *Verification.* Group pairs are expanded to class pairs, each verified once,
   in one leader's task that holds each class's n-grams once.
6. *Report.* ``near_classes`` tells each document's class of near copies and its
   number of links, as many rows as documents; ``near_pairs`` lists all pairs.

No candidate is capped or dropped. A batch sends an n-gram that many of its
documents hold once, with their number, so the most frequent n-gram puts no
more rows into a bucket than there are batches times ``HOT``; a token that is
in many prefixes costs a row of the bit matrix per group.

Defined results: a null or blank text has no n-grams and pairs with nothing; a
text with fewer than n words has one n-gram of all its words; a row without id
can't be named in a pair and is left out; repeated rows count once; two texts
under one id never pair with each other in ``near_pairs``, and are two rows that
may link to each other in ``near_classes``; an id that is no whole number fails
the cast. Frequencies over 65,535 count as equal: they only order the n-grams,
and any order gives the same pairs. Other columns are ignored whatever their
names. An empty table gives no pairs. The input must give its rows in the
same order when it is read again, as files do; batches that repeat one another
number their documents alike and count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import connected_components, fresh_name, materialise, partitions, row_key

BITS = 48
_M48 = np.uint64((1 << BITS) - 1)
_S16 = np.uint64(16)
#: Most documents, and about the most bytes of text, that a batch may hold.
FLUSH_ROWS, FLUSH_BYTES = 1 << 13, 12_000_000
#: An n-gram of more documents of a batch than this is sent once, with their number, and stands for them all.
HOT, ALL = 64, 0xFFFF
#: Class pairs that one verification task holds at once.
PART_PAIRS = 1 << 17


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of sorted 64-bit values: the slowly changing high bytes compress to almost nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack48(x: np.ndarray) -> bytes:
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return raw.view(np.uint64).ravel()


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Least prefix that two sets of this size and threshold must share an n-gram in."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _rows(kind, key, blob) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "blob": pa.array(blob, pa.binary())})


_ROWS = "kind int, key long, blob binary"


def _tokenise(n: int, buckets: int):
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
                start = stop
                size, held, base = np.zeros(part.num_rows, np.uint32), [], 0
                for s in tc.slices(part, "t"):
                    rows, h = tc.word_ngrams(*tc.buffers(tc.lowered(s.column("t"))), n)
                    rows, h = tc.distinct(rows, h, BITS)
                    size[base : base + s.num_rows] = np.bincount(rows, minlength=s.num_rows)
                    held.append((h << _S16) | (rows + base).astype(np.uint64))
                    base += s.num_rows
                tokens = np.sort(np.concatenate(held))
                if not len(tokens):
                    continue
                k, i = part.column("k").to_numpy(), part.column("i").to_numpy()
                # the order counts: only batches that number the same documents alike share a name
                flush = tc.signed(tc.mix64(tc.mix64(k.view(np.uint64)) + np.arange(len(k), dtype=np.uint64)).sum() + np.uint64(len(k)))
                value = tokens >> _S16
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                count = np.diff(np.append(first, len(value)))
                hot = count > HOT
                many = np.repeat(hot, count)
                common, times = value[first[hot]], count[hot].astype(np.uint32)
                # the documents themselves pass through some bucket on their way to the answers
                yield _rows([1], [abs(flush) % buckets], [np.array([flush, len(k), len(common)], np.int64).tobytes() + k.tobytes() + i.tobytes() + size.tobytes() + pack48(common) + times.tobytes() + (tokens[many] & np.uint64(ALL)).astype(np.uint16).tobytes()])
                tokens, value = tokens[~many], value[~many]
                cut, hcut = np.append(np.searchsorted(value, edges), len(value)), np.append(np.searchsorted(common, edges), len(common))
                full = np.flatnonzero(np.diff(cut) + np.diff(hcut))
                for at in range(0, len(full), 64):
                    some, blobs = full[at : at + 64], []
                    for b in some:
                        x, y = hcut[b], hcut[b + 1]
                        blobs.append(np.array([flush, y - x], np.int64).tobytes() + pack48(common[x:y]) + times[x:y].tobytes() + _planes(tokens[cut[b] : cut[b + 1]]))
                    yield _rows([0] * len(some), some, blobs)

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """One bucket of n-grams: for every batch, its n-grams that two documents or more hold, with their frequency."""
    flushes, parts, weights, through = [], [], [], []
    for kind, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        if kind == 1:
            through.append(b)
            continue
        flush, n = np.frombuffer(b, np.int64, 2)
        hot, cold = unpack48(b[16 : 16 + 6 * n]), _unplanes(b[16 + 10 * n :])
        flushes.append(flush)
        parts.append(np.concatenate([(hot << _S16) | np.uint64(ALL), cold]))
        weights.append(np.concatenate([np.frombuffer(b, np.uint32, n, 16 + 6 * n).astype(np.int64), np.ones(len(cold), np.int64)]))
    passed = pa.Table.from_batches([_rows([1] * len(through), [int(np.frombuffer(b, np.int64, 1)[0]) for b in through], through)])
    if not parts:
        return passed
    flushes, value, weight = np.array(flushes), np.concatenate(parts), np.concatenate(weights)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    del parts, weights
    order = np.argsort(value, kind="stable")
    value, owner, weight = value[order], owner[order], weight[order]
    token = value >> _S16
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    df = np.repeat(np.minimum(np.add.reduceat(weight, first), 65535), np.diff(np.append(first, len(token))))
    keep = df > 1
    value, owner, df = value[keep], owner[keep], df[keep].astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    value, owner, df = value[order], owner[order], df[order]
    who, begin = np.unique(owner, return_index=True)
    end = np.append(begin[1:], len(owner))
    answers = _rows([2] * len(who), flushes[who], [df[s:e].tobytes() + _planes(value[s:e]) for s, e in zip(begin, end)])
    return pa.concat_tables([passed, pa.Table.from_batches([answers])])


def _prefixes(threshold: float):
    """One batch of documents with the answers to its n-grams: its documents that have a prefix to index."""
    schema = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("cls", pa.int64()), ("gid", pa.int64()), ("prefix", pa.binary()), ("tokens", pa.binary())])

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        docs = blobs[kinds.index(1)] if 1 in kinds else b""
        answers = [b for kind, b in zip(kinds, blobs) if kind == 2]
        if not docs or not answers:
            return schema.empty_table()
        _, n, m = map(int, np.frombuffer(docs, np.int64, 3))
        k, i = np.frombuffer(docs, np.int64, n, 24), np.frombuffer(docs, np.int64, n, 24 + 8 * n)
        size = np.frombuffer(docs, np.uint32, n, 24 + 16 * n).astype(np.int64)
        at = 24 + 20 * n
        common, times = unpack48(docs[at : at + 6 * m]), np.frombuffer(docs, np.uint32, m, at + 6 * m).astype(np.int64)
        holders = np.frombuffer(docs, np.uint16, int(times.sum()), at + 10 * m).astype(np.uint64)
        df, value = [], []
        for b in answers:
            m = len(b) // 10
            df.append(np.frombuffer(b, np.uint16, m))
            value.append(_unplanes(b[2 * m :]))
        df, value = np.concatenate(df).astype(np.uint64), np.concatenate(value)
        if kinds.count(1) > 1:  # batches of the same rows in the same order share these answers
            value, at = np.unique(value, return_index=True)
            df = df[at]
        every = (value & np.uint64(ALL)) == ALL
        if every.any():  # n-grams that stand for all their documents of this batch
            where = np.searchsorted(common, value[every] >> _S16)
            c, head = times[where], np.cumsum(times) - times
            index = np.repeat(head[where] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            value = np.concatenate([value[~every], np.repeat(value[every] - np.uint64(ALL), c) | holders[index]])
            df = np.concatenate([df[~every], np.repeat(df[every], c)])
        doc, token = (value & np.uint64(ALL)).astype(np.int64), value >> _S16
        order = np.argsort(token, kind="stable")
        order = order[np.argsort((doc[order].astype(np.uint64) << _S16) | df[order], kind="stable")]
        doc, token = doc[order], token[order]  # by document, then frequency, then hash
        shared = np.bincount(doc, minlength=n)
        begin = np.cumsum(shared) - shared
        index = np.maximum(0, np.minimum(prefix_length(size, threshold) - (size - shared), shared))
        out = {name: [] for name in schema.names}
        for d in np.flatnonzero(index):
            own = token[begin[d] : begin[d] + shared[d]]
            front, whole = own[: index[d]], np.sort(own)
            salt = np.uint64(size[d])
            cls = int(k[d]) if shared[d] < size[d] else tc.signed(tc.mix64(whole * np.uint64(31) + np.uint64(7)).sum() ^ salt)
            gid = tc.signed(tc.mix64(tc.mix64(front) + np.arange(len(front), dtype=np.uint64)).sum() ^ salt)
            for name, v in zip(schema.names, (int(k[d]), int(i[d]), int(size[d]), cls, gid, pack48(front), pack48(whole))):
                out[name].append(v)
        return pa.table(out, schema=schema)

    return run


def _postings(batches):
    """Prefix tokens of each group."""
    for b in batches:
        fronts = [unpack48(x) for x in b.column("prefix").to_pylist()]
        if fronts:
            rep = [len(x) for x in fronts]
            yield pa.record_batch(
                {
                    "token": pa.array(np.concatenate(fronts).astype(np.int64)),
                    "gid": pa.array(np.repeat(b.column("gid").to_numpy(), rep)),
                    "size": pa.array(np.repeat(b.column("size").to_numpy(), rep).astype(np.int32)),
                }
            )


def _leaders(table: pa.Table) -> pa.Table:
    """A bucket of postings: each token's list, addressed to the least group in it."""
    token, gid, size = (table.column(c).to_numpy() for c in ("token", "gid", "size"))
    order = np.lexsort((gid, token))
    token, gid, size = token[order], gid[order], size[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    stop = np.append(first[1:], len(token))
    keep = stop - first > 1
    first, stop = first[keep], stop[keep]
    return pa.table(
        {
            "leader": pa.array(gid[first], pa.int64()),
            "list": pa.array([gid[s:e].tobytes() + size[s:e].tobytes() for s, e in zip(first, stop)], pa.binary()),
        }
    )


def _group_pairs(threshold: float, tile: int = 1024):
    """A leader's posting lists: every pair of groups that share a list and may reach the threshold, once.

    Pairs leave tile by tile, so a cluster of many thousands of copies takes no more memory than its lists.
    """

    @tc.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lists, sizes = None, [], []
        for batch in batches:
            leader = batch.column("leader")[0].as_py()
            for b in batch.column("list").to_pylist():
                m = len(b) // 12
                lists.append(np.frombuffer(b, np.int64, m))
                sizes.append(np.frombuffer(b, np.int32, m, 8 * m))
        every = np.concatenate(lists)
        size_of = np.concatenate(sizes).astype(np.int64)
        order = np.lexsort((every, size_of))  # local numbers rise with the size
        first = np.concatenate([[True], (every[order][1:] != every[order][:-1])])
        ids, size = every[order][first], size_of[order][first]
        back = np.argsort(ids, kind="stable")
        local = [np.sort(back[np.searchsorted(ids, x, sorter=back)]) for x in lists]
        n = len(ids)
        for lo in range(0, n, tile):
            hi = min(n, lo + tile)
            # the partners of a row are at most size / threshold large
            last = int(np.searchsorted(size, size[hi - 1] / threshold + 1e-9, "right"))
            seen = np.zeros((hi - lo, last - lo), dtype=bool)
            for x in local:
                s = np.searchsorted(x, [lo, hi, last])
                if s[0] < s[1]:
                    seen[np.ix_(x[s[0] : s[1]] - lo, x[s[0] : s[2]] - lo)] = True
            r, c = np.nonzero(np.triu(seen, 1))
            fits = size[r + lo] >= threshold * size[c + lo] - 1e-9
            a, b = ids[r[fits] + lo], ids[c[fits] + lo]
            yield pa.record_batch({"ga": pa.array(np.minimum(a, b)), "gb": pa.array(np.maximum(a, b)), "leader": pa.array(np.full(len(a), leader), pa.int64())})

    return run


def _verify(threshold: float, summary: bool):
    """Part of a leader's class pairs, and their classes: the pairs that reach the threshold, with their similarity.

    In a summary each class of a pair is told once: the documents that it is linked with here, and the least class
    of those that such pairs join here. That is as many rows as classes, however many pairs they form.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())] if summary else [("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])

    @tc.tidy
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        at, pair = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        cls, blobs = a[at], table.column("tokens")
        order = np.argsort(cls, kind="stable")
        cls, at = cls[order], at[order]
        sizes, held = b[at], table.column("held").to_numpy()[at]
        sets = [unpack48(blobs[int(i)].as_py()) for i in at]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        vocabulary, flat = np.unique(flat, return_inverse=True)
        begin = np.cumsum(size) - size
        x, y = np.searchsorted(cls, a[pair]), np.searchsorted(cls, b[pair])
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        flag = np.zeros(len(vocabulary), dtype=np.uint8)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
        stop = np.append(first[1:], len(x)) if len(x) else []
        out_a, out_b, out_j = [], [], []
        links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for s, e in zip(first, stop):
            own = flat[begin[x[s]] : begin[x[s]] + size[x[s]]]
            flag[own] = 1
            for lo in range(s, e, 4096):
                who = y[lo : min(e, lo + 4096)]
                length = size[who]
                head = np.cumsum(length) - length
                index = np.repeat(begin[who] - head, length) + np.arange(length.sum())
                both = np.add.reduceat(flag[flat[index]].astype(np.int64), head)
                j = both / (sizes[x[s]] + sizes[who] - both)
                good = j >= threshold
                who = who[good]
                if summary and len(who):
                    links[x[s]] += held[who].sum()
                    links[who] += held[x[s]]  # a class pairs with another once
                    joined = _roots(root, np.append(who, x[s]))
                    root[joined] = joined.min()
                elif len(who):
                    out_a.append(np.full(len(who), cls[x[s]]))
                    out_b.append(cls[who])
                    out_j.append(j[good])
            flag[own] = 0
        if summary:
            told = np.flatnonzero(links)
            return pa.table({"a": cls[told], "b": cls[_roots(root, told)], "links": links[told]}, schema=schema)
        if not out_a:
            return schema.empty_table()
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "jaccard": np.concatenate(out_j)}, schema=schema)

    return run


def _roots(root: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Roots of some nodes of a forest; their paths are shortened."""
    up = root[of]
    while (root[up] != up).any():
        up = root[up]
    root[of] = up
    return up


_INDEXED = "k long, id long, size long, cls long, gid long, prefix binary, tokens binary"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    return base.select(row_key("i", "t").alias("k"), "i", "t")


def _joined_classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, summary: bool) -> tuple[DataFrame, DataFrame]:
    """``(members, found)``: members has ``(cls, id, k)`` of rows that may have a partner, k being the key of id and
    text, where a class holds all documents of one n-gram set; found has ``(a, b, jaccard)`` of all pairs of different
    classes at the threshold or, in a summary, ``(a, b, links)``: documents of other classes that those of class a are
    linked with, over several rows, each with a class b that a is joined with or a itself."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1")
    spark = docs.sparkSession
    parts = partitions(spark)
    raw = _keyed(docs, id_col, text_col).where("t is not null").mapInArrow(_tokenise(n, 2 * parts), _ROWS)
    answers = raw.groupBy("key").applyInArrow(tc.tidy(lambda t: _frequent(t)), _ROWS)
    indexed = materialise(answers.groupBy("key").applyInArrow(_prefixes(threshold), _INDEXED))

    groups = indexed.groupBy("gid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    postings = groups.mapInArrow(tc.tidy(_postings), "token long, gid long, size int")
    lists = postings.groupBy(F.pmod(F.xxhash64("token"), F.lit(2 * parts)).alias("bucket")).applyInArrow(tc.tidy(lambda t: _leaders(t)), "leader long, list binary")
    # a leader's work follows its pairs, not its bytes, so the number of tasks is said here
    found = lists.repartition(2 * parts, "leader").groupBy("leader").applyInArrow(_group_pairs(threshold), "ga long, gb long, leader long")
    found = found.groupBy("ga", "gb").agg(F.min("leader").alias("leader"))

    sets = indexed.groupBy("cls").agg(F.first("size").alias("size"), F.first("gid").alias("gid"), F.first("tokens").alias("tokens"), F.count_distinct("k").alias("held"))
    classes = indexed.select("cls", "gid").distinct()
    side = lambda s: classes.select(F.col("gid").alias("g" + s), F.col("cls").alias(s))
    across = found.join(side("a"), "ga").join(side("b"), "gb").select("a", "b", "leader")
    within = side("a").withColumnRenamed("ga", "leader").join(side("b").withColumnRenamed("gb", "leader"), "leader").where("a < b").select("a", "b", "leader")
    pairs = materialise(across.union(within))
    # a leader with many pairs is split by their first class, so that no task holds more than a part
    load = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(float(PART_PAIRS))).alias("parts"))
    tasks = max(parts, -(-pairs.count() // PART_PAIRS))
    pairs = pairs.join(load, "leader").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    needed = pairs.select("leader", "part", F.col("a").alias("cls")).union(pairs.select("leader", "part", F.col("b").alias("cls"))).distinct()
    shipped = needed.join(sets, "cls").select("leader", "part", F.lit(1).alias("kind"), F.col("cls").alias("a"), F.col("size").alias("b"), "tokens", "held")
    work = shipped.union(pairs.select("leader", "part", F.lit(0).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("tokens"), F.lit(0).cast("long").alias("held")))
    # the work follows the pairs, not the bytes, so the number of tasks is said here
    work = work.repartition(tasks, "leader", "part")
    out = "a long, b long, links long" if summary else "a long, b long, jaccard double"
    return indexed.select("cls", "id", "k"), work.groupBy("leader", "part").applyInArrow(_verify(threshold, summary), out)


def class_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members has ``(cls, id, k)`` of rows that may have a partner, k being the key of id and
    text, where a class holds all documents of one n-gram set; pairs has ``(a, b, jaccard)`` of all pairs of different classes at the threshold.

    This is the join's result without expanding pairs of equal documents, whose number is quadratic.
    """
    return _joined_classes(docs, id_col, text_col, n, threshold, summary=False)


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """``(k, id, root, links)`` of the rows that may have a partner, each once; the links don't count its own class."""
    members, told = _joined_classes(docs, id_col, text_col, n, threshold, summary=True)
    told = materialise(told)
    comp = connected_components(told, "a", "b").withColumnRenamed("node", "cls")
    links = told.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # all rows of a class are copies, so components join classes
    linked = members.distinct().join(comp, "cls", "left").join(links, "cls", "left")
    return linked.select("k", "id", "cls", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every distinct row of id and text: the least id of the row's near copies,
    joined link by link, and the number of other rows that its n-gram set reaches the threshold with.

    The join's result in as many rows as there are documents: every link is found, verified and counted, but a class
    of copies isn't expanded into its pairs. Rows that resemble no other, blank ones too, are a class of their own.
    """
    rows = materialise(_components(docs, id_col, text_col, n, threshold))
    own = rows.groupBy("cls").agg((F.count("*") - 1).alias("more"))
    least = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    known = rows.join(own, "cls").join(least, "root").select("k", "class_id", (F.col("links") + F.col("more")).alias("n_links"))
    every = _keyed(docs, id_col, text_col).select("k", "i").distinct()
    out = every.join(known, "k", "left")
    return out.select(F.col("i").alias("doc_id"), F.coalesce("class_id", "i").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5) -> DataFrame:
    """All pairs ``(doc_a, doc_b, jaccard)``, doc_a < doc_b, of documents at the threshold or above."""
    members, pairs = class_pairs(docs, id_col, text_col, n, threshold)
    members = materialise(members.select("cls", "id").distinct())
    one, two = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.join(one, "a").join(two, "b").select("x", "y", "jaccard")
    within = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    every = across.union(within).where("x <> y")
    return every.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The documents with one of each group of near copies: the one with the least id, then key.

    A group is a connected component of rows, known by id and text, whose
    n-gram sets reach the threshold; two texts under one id are two rows, of
    which either may go or stay. Rows without id or text stay, and of rows that
    repeat both id and text one stays.
    """
    rooted = materialise(_components(docs, id_col, text_col, n, threshold))
    first = rooted.groupBy("root").agg(F.min(F.struct("id", "k")).alias("f"))
    lost = rooted.join(first, "root").where("k <> f.k").select("k")
    row = fresh_name(docs, "row")
    own = docs[id_col].cast("long")
    key = F.xxhash64(own, own.isNull(), docs[text_col], docs[text_col].isNull())  # row_key of the docs' own columns
    kept = docs.join(lost.withColumnRenamed("k", row), key == F.col(row), "left_anti")
    # only ids that occur more than once need their texts compared
    again = docs.groupBy(own.alias(row)).count().where(f"count > 1 and {row} is not null").select(row)
    if again.isEmpty():
        return kept  # no id occurs twice, so neither does a row, and texts move once
    again = materialise(again)
    same = kept[id_col].cast("long") == F.col(row)
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
