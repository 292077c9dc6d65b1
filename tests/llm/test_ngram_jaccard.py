import itertools
import random

import numpy as np
import pytest

from quillspark.llm import ngram_jaccard as nj
from quillspark.llm.cluster import connected_components


def grams(text, n=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, t=0.5):
    sets = {(i, x): grams(x) for i, x in rows if i is not None and x and x.split()}
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(sets), 2):
        if a != b:
            j = len(sets[a, x] & sets[b, y]) / len(sets[a, x] | sets[b, y])
            if j >= t:
                out[min(a, b), max(a, b)] = max(j, out.get((a, b), 0))
    return out


@pytest.fixture(scope="module")
def rows(prose):
    r, out = random.Random(1), []
    for i in range(40):
        base = prose(i, r.randint(5, 150))
        out.append((len(out), base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            w = base.split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
            out.append((len(out), " ".join(w)))
    passage = prose(999, 60)
    for i in range(12):  # a passage that many documents share makes no pair by itself
        out.append((len(out), prose(500 + i, 120) + " " + passage))
    out += [(len(out) + k, x) for k, x in enumerate([None, "", "  \n ", "one", "one", "One two", "one TWO"])]
    out.append((None, out[0][1]))
    out.append(out[0])  # a repeated row
    return out


def test_pairs_equal_brute_force(frame, rows):
    got = {(r[0], r[1]): r[2] for r in nj.near_pairs(frame(rows, "gid")).collect()}
    assert got == brute(rows)


def test_other_thresholds(frame, rows):
    for t in (0.3, 0.8, 1.0):
        got = {(r[0], r[1]) for r in nj.near_pairs(frame(rows[:60]), threshold=t).collect()}
        assert got == set(brute(rows[:60], t))


def test_one_of_each_group_stays(frame, rows):
    kept = nj.drop_near_duplicates(frame(rows, "cls"))
    ids = [r["doc_id"] for r in kept.collect()]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert sorted(i for i in ids if i is not None) == sorted({find(i) for i in root})
    assert ids.count(None) == 1
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "cls"]


def test_texts_under_one_id_go_or_stay_by_themselves(frame, prose):
    a, b, c = (prose(7000 + i, 40) for i in range(3))
    rows = [(3, a + " more"), (7, a), (7, b), (9, b + " more"), (9, c), (9, None), (11, a), (11, ""), (7, b)]
    kept = sorted((r[0], r[1] or "", r[1] is None) for r in nj.drop_near_duplicates(frame(rows)).collect())
    assert kept == sorted([(3, a + " more", False), (7, b, False), (9, c, False), (9, "", True), (11, "", False)])


def test_empty_table(frame):
    assert nj.near_pairs(frame([])).count() == 0
    assert nj.drop_near_duplicates(frame([])).count() == 0


def test_frequent_ngrams_of_one_batch(frame, prose):
    """A passage in over HOT documents of a batch is counted without sending each occurrence."""
    passage = prose(7, 80)
    rows = [(i, passage + " " + prose(2000 + i, 10 if i % 2 else 90)) for i in range(150)]
    got = {(r[0], r[1]) for r in nj.near_pairs(frame(rows)).collect()}
    assert got == set(brute(rows))


@pytest.mark.parametrize("step", [1, -1])
def test_partitions_that_repeat_each_other(frame, prose, step):
    """Batches of the same rows, in the same order or in another, give each document's n-grams once."""
    rows = [(i, prose(3000 + i, 40)) for i in range(30)]
    rows += [(100 + i, " ".join(t.split()[:20] + prose(3100 + i, 20).split())) for i, t in rows]  # J of about 0.3
    rows += [(200 + i, t + " more words") for i, t in rows[:10]]
    rows += [(300, prose(5000, 30)), (301, prose(5000, 30))]
    both = frame(rows + rows[::step])
    sizes = [len(x) for x in both.rdd.glom().collect()]
    assert len(set(sizes)) == 1 and len(rows) % sizes[0] == 0  # whole partitions repeat
    got = {(r[0], r[1]): r[2] for r in nj.near_pairs(both).collect()}
    assert got == brute(rows) and max(got.values()) == 1


def test_long_text(frame, prose):
    long = prose(3, 60_000)
    got = nj.near_pairs(frame([(1, long), (2, long + " end"), (3, prose(4, 50))])).collect()
    assert [(r[0], r[1]) for r in got] == [(1, 2)]


def test_packing_of_hashes():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 999).astype(np.uint64))
    assert (nj.unpack48(nj.pack48(x)) == x).all()
    assert (nj._unplanes(nj._planes(x)) == x).all()


def test_prefix_length_is_safe():
    for size in range(1, 60):
        p = int(nj.prefix_length(np.array([size]), 0.5)[0])
        assert size - p + 1 >= 0.5 * size and 1 <= p <= size


def test_invalid_threshold(frame):
    with pytest.raises(ValueError):
        nj.near_pairs(frame([]), threshold=0)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (20, 21), (30, 30)] + [(i, i + 1) for i in range(100, 160)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3, 9)} == {1} and got[21] == 20 and {got[k] for k in range(100, 161)} == {100} and 30 not in got


def brute_classes(rows, t=0.5):
    """Class and links of every distinct row with an id."""
    every = sorted({(i, x) for i, x in rows if i is not None}, key=repr)
    sets, root, links = {r: grams(r[1]) for r in every}, {r: r for r in every}, dict.fromkeys(every, 0)

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    for a, b in itertools.combinations(every, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for r in every:
        least[find(r)] = min(r[0], least.get(find(r), r[0]))
    return sorted((r[0], least[find(r)], links[r]) for r in every)


def test_classes_equal_brute_force(frame, rows, prose):
    rows = [*rows, (7, prose(8000, 50)), (7, rows[7][1] + " more"), (3, rows[30][1])]  # ids with two texts
    got = nj.near_classes(frame(rows, "cls"))
    assert got.columns == ["doc_id", "class_id", "n_links"] and sorted(map(tuple, got.collect())) == brute_classes(rows)


def test_classes_of_a_large_cluster(frame, prose, monkeypatch):
    """Many different texts of one cluster, verified in several parts, keep every link."""
    monkeypatch.setattr(nj, "PART_PAIRS", 200)
    base = prose(1, 60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for j in range(i % 7):
            w[(i * 11 + j * 5) % 60] = f"other{i}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, nj.near_classes(frame(rows)).collect())) == brute_classes(rows)


def test_clashing_names(frame, rows):
    docs = frame(rows[:30], "row").withColumnRenamed("source", "ROW_").withColumnRenamed("lang", "k")
    kept = nj.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == nj.drop_near_duplicates(frame(rows[:30])).count()
    assert nj.near_classes(frame([])).count() == 0
