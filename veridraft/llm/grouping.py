"""Splits that keep related documents together: grouped iterative stratification.

1. Documents that share a sentence are linked (each to the smallest document of the sentence, so a
   sentence of any frequency gives one link for each document) and put into components.
2. Each component gets its size and its count of every label.
3. Components are put into bins by rarest label, size (a power of two) and hash. A cell of label and
   size has LEAST_BINS bins, or one for each 1 / BINS of all rows it holds, so the number of bins
   grows with labels and sizes, not with rows, and a component is alone in its bin where there are few of its kind.
4. Whatever its size, each bin is placed by one rule on the driver: rarest outstanding label first,
   largest bin first, into the split that is furthest behind its share of that label and has room for
   the bin (if none has, into the one that needs the label most). All labels of the bin are deducted.
   Then single bins move while that brings the shares nearer to the wanted ones.

Edge cases: documents without sentences in common are components of their own; null ids are left
out; labels of unknown sentences are ignored; repeated rows count once; an empty table gives an
empty result. Ties are broken by hash, then by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .components import connected_components

BINS, LEAST_BINS = 8192, 128


def document_groups(memberships: DataFrame, item: str, owner: str) -> DataFrame:
    """node, component of every ``owner`` that is linked to another one by a shared ``item``."""
    rows = memberships.select(F.col(item).alias("item"), F.col(owner).alias("owner")).where("item is not null and owner is not null").distinct()
    shared = rows.groupBy("item").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("item", "least")
    links = rows.join(shared, "item").select(F.col("owner").alias("src"), F.col("least").alias("dst"))
    return connected_components(links)


def assign_splits(items: DataFrame, labels: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """items: item, group. labels: item, label. plan: split_name, target_share (a few rows).

    Returns group, split_name; every group stands in exactly one split.
    """
    spark = items.sparkSession
    splits = [(r.split_name, float(r.target_share)) for r in plan.select("split_name", "target_share").where("target_share > 0").orderBy("split_name").collect()]
    whole = sum(s for _, s in splits)
    splits = [(n, s / whole) for n, s in splits]
    if not splits:
        return spark.createDataFrame([], "group string, split_name string")
    sizes = items.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    of_group = items.join(labels, "item").groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = of_group.unionByName(sizes.select("group", F.lit(None).cast("string").alias("label"), "n"))  # label null: all rows
    groups = cut(parts.groupBy("group").agg(F.collect_list(F.struct("label", "n")).alias("vector")))
    totals = {r.label: r.n for r in groups.select(F.explode("vector").alias("v")).groupBy("v.label").agg(F.sum("v.n").alias("n")).collect()}  # as many rows as there are labels: the caller keeps to a taxonomy
    schema = "turn int, size int, slot int, split_name string"
    order = sorted((lab for lab in totals if lab is not None), key=lambda x: (totals[x], str(x)))
    rank = F.create_map(*[F.lit(v) for i, lab in enumerate(order) for v in (lab, i)]) if order else None
    turn = F.array_min(F.transform("vector", lambda v: F.coalesce(rank[v["label"]], F.lit(len(order))))) if order else F.lit(0)
    n = F.element_at(F.filter("vector", lambda v: v["label"].isNull()), 1)["n"]
    celled = groups.select("group", "vector", n.alias("n"), turn.alias("turn"), F.floor(F.log2(n)).cast("int").alias("size"))
    cells = celled.groupBy("turn", "size").agg(F.sum("n").alias("n")).collect()  # at most labels x powers of two
    slots = spark.createDataFrame([(r["turn"], r["size"], max(LEAST_BINS, -(-r["n"] * BINS // totals[None]))) for r in cells], "turn int, size int, slots int")
    binned = celled.join(F.broadcast(slots), ["turn", "size"]).select(
        "group", "vector", "turn", "size", F.pmod(F.xxhash64(F.lit(seed), "group"), F.col("slots")).cast("int").alias("slot")
    )
    held = binned.select("turn", "size", "slot", F.explode("vector").alias("v")).groupBy("turn", "size", "slot", "v.label").agg(F.sum("v.n").alias("n"))
    vectors: dict = {}
    columns = held.toArrow().to_pydict()  # at most BINS + LEAST_BINS x cells bins
    for *key, lab, k in zip(*[columns[c] for c in ("turn", "size", "slot", "label", "n")]):
        vectors.setdefault(tuple(key), {})[lab] = k
    bins = spark.createDataFrame([(*k, s) for k, s in place(vectors, splits).items()], schema)
    return binned.join(F.broadcast(bins), ["turn", "size", "slot"]).select("group", "split_name")


def place(vectors: dict, splits: list) -> dict:
    """vectors: {bin: {label: rows}}, label None for all rows. splits: (name, share). The split of every bin."""
    left: dict = {}
    waiting: dict = {}
    for key in sorted(vectors, key=lambda k: (vectors[k][None], k)):  # the largest is popped first
        for lab, n in vectors[key].items():
            left[lab] = left.get(lab, 0) + n
            waiting.setdefault(lab, []).append(key)
    need = {lab: {n: s * t for n, s in splits} for lab, t in left.items()}
    placed: dict = {}
    while waiting:
        lab = min(waiting, key=lambda x: (left[x], x is None, str(x)))
        while waiting[lab] and waiting[lab][-1] in placed:
            waiting[lab].pop()
        if not waiting[lab]:
            del waiting[lab]
            continue
        key = waiting[lab].pop()
        vector = vectors[key]
        room = [s for s in splits if need[lab][s[0]] >= vector[lab] and need[None][s[0]] >= vector[None]]
        if room:
            split = max(room, key=lambda s: (need[lab][s[0]] / s[1], need[None][s[0]] / s[1], s))[0]
        else:
            split = max(splits, key=lambda s: (need[None][s[0]] > 0, need[lab][s[0]], need[None][s[0]], s[0]))[0]
        placed[key] = split
        for x, n in vector.items():
            need[x][split] -= n
            left[x] -= n
    return settled(vectors, placed, need, [n for n, _ in splits])


def settled(vectors: dict, placed: dict, need: dict, names: list, passes: int = 10) -> dict:
    """``placed`` after moves of single bins that bring the shares of labels, and above all of all rows, nearer to the wanted ones.

    The cost is the sum over labels and splits of the squared missing share; a bin moves where that
    lowers it most, until a pass over all bins moves none.
    """
    total = {lab: 0 for lab in need}
    for vector in vectors.values():
        for lab, n in vector.items():
            total[lab] += n
    scale = {lab: (10.0 if lab is None else 1.0) / max(t, 1) ** 2 for lab, t in total.items()}
    for _ in range(passes):
        moved = False
        for key in sorted(vectors):
            vector, here = vectors[key], placed[key]
            gain = {s: sum(2 * n * scale[x] * (need[x][s] - need[x][here] - n) for x, n in vector.items()) for s in names if s != here}
            best = max(gain, key=lambda s: (gain[s], s), default=None)
            if best is not None and gain[best] > 1e-15:
                placed[key], moved = best, True
                for x, n in vector.items():
                    need[x][here] += n
                    need[x][best] -= n
        if not moved:
            break
    return placed


class GroupedSplit:
    """Assignment of every sentence row to a split so that related documents stay together."""

    def __init__(self, sentences: DataFrame, labels: DataFrame, plan: DataFrame):
        rows = sentences.select("sentence_id", "doc_id").where("sentence_id is not null and doc_id is not null").distinct()
        self.related = cut(document_groups(rows, "sentence_id", "doc_id"))
        joined = rows.join(self.related, rows.doc_id == self.related.node, "left")
        self.rows = cut(joined.select("sentence_id", "doc_id", F.coalesce("component", "doc_id").alias("group_key")))
        items = self.rows.select(F.col("sentence_id").alias("item"), F.col("group_key").alias("group")).distinct()
        self.groups = cut(assign_splits(items, labels.select(F.col("sentence_id").alias("item"), F.col("trope_id").alias("label")).where("label is not null").distinct(), plan))

    def assignment(self) -> DataFrame:
        """sentence_id, doc_id, group_key, split_name."""
        return self.rows.join(self.groups, F.col("group_key") == F.col("group")).select("sentence_id", "doc_id", "group_key", "split_name")
