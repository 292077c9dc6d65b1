"""Language identification by hierarchical discrimination.

First the language family: one linear support vector machine per family, each
against all the rest and against noise. Then, inside the family that claims the
text, one machine for every two of its languages; the language that wins most
duels, by summed margins if tied, is the answer. Features are relative
frequencies of hashed byte 1- to 4-grams of the lower-cased text, so a text's
score under a machine is the mean of its grams' weights.

A text is rejected when it has no letter, or when every family's machine scores
it below ``-reject_below``: the noise examples, texts with shuffled bytes and
runs of digits and symbols, teach the machines what no language looks like.

The machines are fitted by dual coordinate descent on at most
``train_per_language`` labelled rows for each language (a documented bound: the
rows with the least hash; of rows with equal hashes all). Whole texts are hashed
on the executors; the driver gets their gram frequencies alone. Classification
reads every text whole, in numpy passes over Arrow buffers.

Defined results: null and empty texts are rejected, with a null language;
repeated rows are classified each; a very long text is scored whole; a label
seen nowhere in ``families`` is a family of its own; of families or languages
that tie the first by name is taken; with no labelled rows at all every text is rejected; other
columns pass through or are ignored whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .cluster import fresh_name

DIM_BITS = 14
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance"}
_MURMUR = np.uint32(0x85EBCA6B)


def gram_slots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of every byte's 1- to 4-grams, shape (4, bytes), and which of them lie inside one text."""
    n = len(buf)
    b = buf.astype(np.uint32)
    rest = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes from here to the text's end
    slots, inside = np.empty((4, n), np.int32), np.empty((4, n), dtype=bool)
    h = np.zeros(n, np.uint32)
    for k in range(4):
        h[: n - k] = h[: n - k] * np.uint32(0x01000193) ^ (b[k:] + np.uint32(1))
        x = (h ^ (h >> np.uint32(15))) * _MURMUR
        slots[k] = (x >> np.uint32(32 - DIM_BITS)).astype(np.int32)
        inside[k] = rest > k
    return slots, inside


def features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and relative frequencies of one text's grams."""
    slots, inside = gram_slots(buf, np.array([0, len(buf)]))
    slot, count = np.unique(slots[inside], return_counts=True)
    return slot, (count / max(1, count.sum())).astype(np.float32)


def fit_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: float, cost: float = 4.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights and bias of a linear machine, by dual coordinate descent on the squared hinge loss.

    Examples are slots and values, which ``scale`` multiplies; one more feature of their root mean square norm is the bias.
    """
    rng = np.random.default_rng(seed)
    norm = np.array([float(v @ v) for _, v in x]) * scale * scale
    one = float(np.sqrt(norm.mean() + 1e-12))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * share)
    w, bias, alpha = np.zeros(1 << DIM_BITS, np.float32), 0.0, np.zeros(len(y))
    square = norm + one * one + diagonal
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            slot, value = x[i]
            g = y[i] * (scale * float(value @ w[slot]) + one * bias) - 1 + diagonal[i] * alpha[i]
            step = max(0.0, alpha[i] - g / square[i]) - alpha[i]
            if step:
                w[slot] += np.float32(step * y[i] * scale) * value
                bias += step * y[i] * one
                alpha[i] += step
                most = max(most, abs(step) * square[i])
        if most < 0.02:  # no example's margin moved by more
            break
    return np.append(w.astype(np.float64), bias * one)


class Hierarchy:
    """The fitted machines: columns of ``weights`` are the families', then the duels'.

    Examples are label, slots and values; those of noise have the label "".
    """

    def __init__(self, examples: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = sorted({e[0] for e in examples} - {""})
        family = {x: families.get(x, "only " + x) for x in self.languages}
        self.families = sorted(set(family.values()))
        self.members = [[x for x in self.languages if family[x] == f] for f in self.families]
        marks = np.frombuffer(b"0123456789#$%&*@!?;:/()[]{}<>=+-_.,  \n", np.uint8)
        examples = examples + [("", *features(rng.choice(marks, int(rng.integers(5, 1000))))) for _ in range(80)]
        x = [e[1:] for e in examples]
        # scaled so that a text's features have a norm of about one
        scale = float(1 / np.sqrt(np.mean([float(v @ v) for _, v in x])))
        lab = np.array([e[0] for e in examples])
        fam = np.array([family.get(v, "") for v in lab])
        self.duels = [(f, a, b) for f, m in enumerate(self.members) for a, b in itertools.combinations(m, 2)]
        fitted = [fit_svm(x, np.where(fam == f, 1.0, -1.0), scale) for f in self.families]
        for _, a, b in self.duels:
            pick = np.flatnonzero((lab == a) | (lab == b))
            fitted.append(fit_svm([x[i] for i in pick], np.where(lab[pick] == a, 1.0, -1.0), scale))
        w = np.array(fitted).T
        self.weights, self.bias = np.ascontiguousarray(w[:-1] * scale).astype(np.float32), w[-1]

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each text (rows) under each machine (columns); NaN for empty texts."""
        out = np.full((len(off) - 1, self.weights.shape[1]), np.nan)
        full = np.flatnonzero(np.diff(off) > 0)
        if not len(full):
            return out
        slots, inside = gram_slots(buf, off)
        count = np.add.reduceat(inside.sum(0), off[full])
        slots[~inside] = 1 << DIM_BITS  # a slot of weight 0
        for m in range(self.weights.shape[1]):
            table = np.append(self.weights[:, m], np.float32(0))
            total = table[slots[0]]
            for k in range(1, 4):
                total += table[slots[k]]
            out[full, m] = np.add.reduceat(total.astype(np.float64), off[full]) / count + self.bias[m]
        return out

    def decide(self, scores: np.ndarray, letters: np.ndarray, reject_below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: rejected), of the family, and the family's score."""
        n_f = len(self.families)
        known = letters & ~np.isnan(scores[:, 0])
        fam = np.argmax(np.where(known[:, None], scores[:, :n_f], 0), 1)
        margin = scores[np.arange(len(scores)), fam]
        wins = np.zeros((len(scores), len(self.languages)))
        at = {x: i for i, x in enumerate(self.languages)}
        for d, (f, a, b) in enumerate(self.duels):
            s, own = scores[:, n_f + d], fam == f
            soft = np.tanh(np.nan_to_num(s)) * 0.1
            wins[own, at[a]] += (s[own] > 0) + soft[own]
            wins[own, at[b]] += (s[own] <= 0) - soft[own]
        for f, m in enumerate(self.members):
            for x in m:
                wins[fam == f, at[x]] += 100
        lang = np.argmax(wins, 1)
        lang[~known | ~(margin >= -reject_below)] = -1
        return lang, fam, margin


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[195:245] = True


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, families: dict[str, str], train_per_language: int) -> Hierarchy | None:
    """The machines from the labelled rows with the least hashes."""
    hashed = docs.select(F.col(lang_col).alias("l"), F.xxhash64(F.lit("train"), F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
    ranked = hashed.where("l is not null and t is not null and t <> ''").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    edge = ranked.where(F.col("r") <= train_per_language).groupBy("l").agg(F.max("h").alias("edge"))
    picked = hashed.join(F.broadcast(edge), "l").where("h <= edge and t is not null and t <> ''")
    rows = picked.select("l", "h", "t").mapInArrow(tc.tidy(_examples), "l string, h long, noise boolean, slots binary, shares binary").orderBy("l", "h", "noise", "slots", "shares").collect()
    if not rows:
        return None
    return Hierarchy([("" if r["noise"] else r["l"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows], families)


def _examples(batches):
    """Grams of each text and, for one in eight by hash, of its bytes in random order, which no language looks like."""
    for batch in batches:
        out = []
        texts = tc.lowered(batch.column("t"))
        for l, h, t in zip(batch.column("l").to_pylist(), batch.column("h").to_pylist(), texts.to_pylist()):
            buf = np.frombuffer(t.encode(), np.uint8)
            out.append((l, h, False, *features(buf)))
            if h % 8 == 0:
                out.append((l, h, True, *features(np.random.default_rng(h % (1 << 32)).permutation(buf))))
        if out:
            l, h, noise, slots, shares = zip(*out)
            yield pa.record_batch({"l": pa.array(l), "h": pa.array(h, pa.int64()), "noise": pa.array(noise), "slots": pa.array([x.tobytes() for x in slots], pa.binary()), "shares": pa.array([x.tobytes() for x in shares], pa.binary())})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] = FAMILIES, train_per_language: int = 300, reject_below: float = 0.8, keep_columns: bool = False) -> DataFrame:
    """``(doc_id, family, language, margin, rejected)`` for every row; with ``keep_columns`` the row's own columns and a
    struct of the four, ``found`` or, where that is taken, the first free name with underscores behind it: the last column."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, families, train_per_language))
    base = docs if keep_columns else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    text = base.columns.index(text_col) if keep_columns else 1
    own = list(range(len(base.columns))) if keep_columns else [0]
    found = F.lit(None).cast("struct<family: string, language: string, margin: double, rejected: boolean>")
    if keep_columns:
        schema = base.withColumn(fresh_name(base, "found"), found).schema
    else:
        schema = base.select("doc_id", found.alias("f")).select("doc_id", "f.*").schema

    @tc.tidy
    def run(batches):
        m = model.value
        for batch in batches:
            for part in tc.slices(batch, text, 1_000_000):
                n = part.num_rows
                if m is None:
                    fam = lang = margin = [None] * n
                    gone = np.ones(n, dtype=bool)
                else:
                    buf, off = tc.buffers(tc.lowered(part.column(text)))
                    seen = np.concatenate([[0], np.cumsum(_LETTER[buf])])
                    got, f, s = m.decide(m.scores(buf, off), seen[off[1:]] > seen[off[:-1]], reject_below)
                    gone = got < 0
                    lang = [None if i < 0 else m.languages[i] for i in got]
                    fam = [None if i < 0 else m.families[j] for i, j in zip(got, f)]
                    margin = [None if x != x else float(x) for x in np.round(s, 6)]
                made = [pa.array(fam, pa.string()), pa.array(lang, pa.string()), pa.array(margin, pa.float64()), pa.array(gone)]
                if keep_columns:
                    made = [pa.StructArray.from_arrays(made, ["family", "language", "margin", "rejected"])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *made], names=schema.names)

    return base.mapInArrow(run, schema)
