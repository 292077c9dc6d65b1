"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain - language - source. A token total flows down
it by the weights of each node's children. A child that can't use its share,
because all its documents repeated ``max_epochs`` times hold fewer tokens,
leaves the rest to its siblings by their weights; only what a whole family
can't use goes back to the parent's siblings, and so on up.

Each leaf then takes whole seeded epochs and a token-prefix of the next one:
its documents in the order of a hash of seed, epoch and row, as long as their
running sum stays within what is left. The hash is uniform, so sums over 4096
ranges of it find the range where the prefix ends; only the documents of that
one range are sorted. Elsewhere the decision is a comparison, and texts are
never shuffled.

Defined results: null languages and sources are leaves named ``(none)``;
documents without tokens belong to every whole epoch and to a prefix that
reaches them, but a leaf without tokens or without a budget gives nothing; a
very long text is counted whole and taken or left whole; repeated rows, and
rows whose hashes tie, have the same place in the order and enter or stay out
together; a domain, language or source that the weights don't name has the
weight of ``"*"``, or 0 without one; an empty table gives no rows. Other
columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import fresh_name, materialise, row_key
from .tokens import with_counts

NONE = "(none)"


def _weight(spec, name: str) -> tuple[float, object]:
    """A child's weight and the weights of its own children; equal weights where nothing is said."""
    if spec is None:
        return 1.0, None
    found = spec.get(name, spec.get("*", 0.0))
    return (float(found[0]), found[1]) if isinstance(found, tuple) else (float(found), None)


def budgets(available: Mapping[tuple[str, ...], int], weights, total: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. ``weights`` is ``{child: weight}`` or ``{child: (weight, its children's weights)}``.

    The tree is built and measured once; children are filled in the order in which their space runs out, so the work
    is that of sorting the leaves.
    """
    out: dict[tuple[str, ...], int] = {}
    kids: dict[tuple, set[tuple]] = {}
    for leaf in available:
        for depth in range(len(leaf)):
            kids.setdefault(leaf[:depth], set()).add(leaf[: depth + 1])
    below: dict[tuple, tuple[float, object, int]] = {}

    def room(node: tuple, spec) -> int:
        """Tokens that a node's leaves can give; notes weight, own weights and room of each node below."""
        if node not in kids:
            return available[node] * max_epochs
        rooms = 0
        for kid in kids[node]:
            w, own = _weight(spec, kid[-1])
            below[kid] = (w, own, room(kid, own))
            rooms += below[kid][2] if w > 0 else 0
        return rooms

    def fill(node: tuple, amount: float) -> None:
        if node not in kids:
            out[node] = min(int(amount + 1e-6), available[node] * max_epochs)
            return
        share = dict.fromkeys(kids[node], 0.0)
        open_ = sorted((k for k in share if below[k][0] > 0 and below[k][2] > 0), key=lambda k: (below[k][2] / below[k][0], k))
        left = sum(below[k][0] for k in open_)
        for at, k in enumerate(open_):
            w, _, space = below[k]
            if amount * w >= space * left:  # full; later ones share what it leaves
                share[k] = float(space)
                amount, left = amount - space, left - w
            else:
                left = sum(below[x][0] for x in open_[at:])
                for x in open_[at:]:
                    share[x] = amount * below[x][0] / left
                break
        for k, v in share.items():
            fill(k, v)

    if available:
        room((), weights)
        fill((), float(total))
    return out


#: Leaves, that is sources, up to which their budgets are broadcast; more of them are joined by shuffling.
BROADCAST_LEAVES = 1 << 17


def mix(docs: DataFrame, levels: list[Column], weights, fraction: float = 0.8, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch that holds them: their own columns and two more, the names of
    their ``leaf`` from the root on and the ``epoch``, with underscores behind these names where they are taken.

    ``fraction`` of all tokens, those of weightless leaves too, is the total.
    """
    spark = docs.sparkSession
    names = [f"l{n}" for n in range(len(levels))]
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip(levels, names)]
    # the row's own columns travel in a struct, so that no name of theirs meets one used here
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), *named)
    keyed = base.withColumn("k", row_key("i", "t"))
    lens = materialise(with_counts(keyed.select("k", *names, "t"), "t", vocabulary))
    # one row per leaf; the number of sources, not of documents
    have = {tuple(r[: len(names)]): r[-1] for r in lens.groupBy(*names).agg(F.sum("n_tokens")).toLocalIterator()}
    plan = budgets(have, weights, int(fraction * sum(have.values())), max_epochs)
    send = F.broadcast if len(have) <= BROADCAST_LEAVES else (lambda df: df)

    def table(rows: list, more: str) -> DataFrame:
        return send(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + more).coalesce(1))

    rows = []
    for leaf, tokens in have.items():
        whole = plan.get(leaf, 0) // tokens if tokens else 0
        rows.append((*leaf, int(whole), int(plan.get(leaf, 0) - whole * tokens)))
    place = F.xxhash64(F.lit(seed), F.col("whole"), F.col("k"))
    spot = F.shiftright(place, 52)
    ranged = lens.join(table(rows, ", whole int, rest long"), names).where("rest > 0").withColumn("r", spot)
    sums = ranged.groupBy(*names, "r").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*names).orderBy("r")
    after = sums.withColumn("until", F.sum("n").over(order)).where("until > rest")
    ends = after.groupBy(*names).agg(F.min(F.struct("r", (F.col("until") - F.col("n")).alias("before"))).alias("e"))
    ends = {tuple(r[: len(names)]): (r["e"]["r"], r["e"]["before"]) for r in ends.toLocalIterator()}
    # the places of a leaf without a rest all lie beyond its end
    rows = [(*r, *ends.get(tuple(r[: len(names)]), (-(1 << 20), 0))) for r in rows]
    leaves = table(rows, ", whole int, rest long, last int, before long")
    border = lens.join(leaves, names).withColumn("o", place).where(spot == F.col("last"))
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("o"))  # equal places share one sum
    inside = border.withColumn("u", running).where("before + u <= rest").select(F.col("k").alias("in")).distinct()

    out = keyed.join(leaves, names).withColumn("r", spot)
    clear = out.where("r <> last").withColumn("times", F.col("whole") + (F.col("r") < F.col("last")).cast("int"))
    edge = out.where("r = last").join(inside, F.col("k") == F.col("in"), "left")
    edge = edge.withColumn("times", F.col("whole") + F.col("in").isNotNull().cast("int"))
    chosen = clear.select("own", *names, "times").union(edge.select("own", *names, "times")).where("times > 0")
    leaf, epoch = fresh_name(docs, "leaf"), fresh_name(docs, "epoch")
    return chosen.select(*[F.col("own")[c].alias(c) for c in docs.columns], F.array(*names).alias(leaf), F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias(epoch))
