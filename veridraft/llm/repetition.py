"""Repetition inside single documents, judged by weak supervision.

A word is repeated if it lies in a run of RUN successive words that began at an earlier place of
the document too. Documents of one block of BLOCK sentences are measured within their row, all
runs at once; larger ones (however large) are spread: block offsets come from sums over blocks,
runs are counted by (document, run), covered words by stretches of CELL words. Both ways give the
same numbers. Rules on the measures vote for or against repetition or abstain (documents of under
MIN_WORDS words are voted against); expectation-maximisation over the counts of the vote patterns
(at most 3**4) estimates the accuracy of every rule for either class, and the posterior of its
pattern is the document's probability. Documents more likely repetitive than not are found; that
they meet the definition is checked afterwards.

Edge cases: null and blank texts have no words; rows repeated whole count once; rows without a
document id are left out; a document under RUN words has share 0; equal ordinals are ordered by
sentence id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .winnowing import rolling_hashes
from .wordrows import hashed_words

RUN, BLOCK, CELL = 12, 1024, 8192
MIN_WORDS, SHARE = 40, 0.3


def sentence_words(rows: DataFrame) -> DataFrame:
    """doc_id, ordinal, sentence_id, w (32-bit word hashes in order) of each row that has words."""
    placed = rows.where("doc_id is not null").select("doc_id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "sentence_id", "text")
    return hashed_words(placed, "text", ["doc_id", "ordinal", "sentence_id"], 1).withColumnRenamed("seq", "w")


def blocks_of(rows: DataFrame) -> DataFrame:
    """doc_id, block, w: the words of up to BLOCK sentences, in order. The one shuffle of the words."""
    return (
        rows.groupBy("doc_id", (F.col("ordinal") / BLOCK).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_set(F.struct("ordinal", "sentence_id", "w"))).alias("s"))
        .select("doc_id", "block", F.flatten(F.transform("s", lambda x: x["w"])).alias("w"))
    )


def _runs(values: np.ndarray, offsets: np.ndarray):
    """(document number, place, hash) of every run of RUN words."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) - offsets[row]
    whole = place <= n[row] - RUN
    return row[whole], place[whole], rolling_hashes(values.astype(np.int64), RUN)[whole].view(np.int64)


def measure_whole(docs: DataFrame) -> DataFrame:
    """docs: doc_id, w. Measures of documents that stand in one row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("w")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            n = np.diff(offsets)
            row, place, h = _runs(values, offsets)
            order = np.lexsort((place, h, row))
            r, p, g = row[order], place[order], h[order]
            first = np.ones(len(r), dtype=bool)
            first[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
            mark = np.zeros(len(values) + 1, dtype=np.int64)
            at = offsets[r[~first]] + p[~first]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + RUN, -1)
            covered = np.cumsum(mark)[:-1] > 0
            total = np.add.reduceat(np.concatenate([covered, [0]]).astype(np.int64), offsets[:-1]) * (n > 0)
            runs = np.bincount(row, minlength=len(n))
            distinct = np.bincount(r[first], minlength=len(n))
            most = np.zeros(len(n), dtype=np.int64)
            if len(r):
                starts = np.flatnonzero(first)
                np.maximum.at(most, r[starts], np.diff(np.append(starts, len(r))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, total, runs, distinct, most))],
                names=["doc_id", "n_words", "repeated", "runs", "distinct_runs", "most"],
            )

    return docs.select("doc_id", "w").mapInArrow(run, "doc_id string, n_words bigint, repeated bigint, runs bigint, distinct_runs bigint, most bigint")


def measure_spread(blocks: DataFrame) -> DataFrame:
    """The same measures for documents of several blocks; no step holds a whole document."""
    narrow = blocks.select("doc_id", "block", F.size("w").cast("bigint").alias("n"), F.slice("w", 1, RUN - 1).alias("head"))
    order = Window.partitionBy("doc_id").orderBy("block")
    placed = narrow.select(
        "doc_id",
        "block",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, RUN - 1))), 1, RUN - 1).alias("tail"),
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("start")[i].as_py()
                whole = batch.column("w")[i].values.to_numpy() if batch.column("w")[i].values is not None else np.empty(0, np.int32)
                tail = batch.column("tail")[i].values.to_numpy()
                values = np.concatenate([whole, tail])
                _, place, h = _runs(values, np.array([0, len(values)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc_id")[i].as_py()] * len(place), pa.string()), pa.array(h), pa.array(place + start)], names=["doc_id", "h", "pos"]
                )

    runs = blocks.join(placed, ["doc_id", "block"]).select("doc_id", "start", "w", "tail").mapInArrow(run, "doc_id string, h bigint, pos bigint")
    runs = cut(runs)
    counts = runs.groupBy("doc_id", "h").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("k"))
    again = runs.join(counts.where("k > 1").select("doc_id", "h", "first"), ["doc_id", "h"]).where("pos > first").select("doc_id", "pos")
    cells = again.select("doc_id", "pos", F.explode(F.array_distinct(F.array((F.col("pos") / CELL).cast("bigint"), ((F.col("pos") + RUN - 1) / CELL).cast("bigint")))).alias("cell"))
    places = cells.groupBy("doc_id", "cell").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # at most CELL + RUN places
    low, high = F.col("cell") * CELL, (F.col("cell") + 1) * CELL
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), low.alias("upto"))

    def add(acc, p):
        end = F.least(p + RUN, high)
        return F.struct((acc["n"] + F.greatest(end - F.greatest(p, acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    covered = places.select("doc_id", F.aggregate("at", zero, add)["n"].alias("n")).groupBy("doc_id").agg(F.sum("n").alias("repeated"))
    sizes = narrow.groupBy("doc_id").agg(F.sum("n").alias("n_words"))
    kinds = counts.groupBy("doc_id").agg(F.sum("k").alias("runs"), F.count(F.lit(1)).alias("distinct_runs"), F.max("k").alias("most"))
    joined = sizes.join(kinds, "doc_id", "left").join(covered, "doc_id", "left")
    return joined.select("doc_id", "n_words", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("repeated", "runs", "distinct_runs", "most")])


def measures(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, repeated, runs, distinct_runs, most."""
    worded = sentence_words(rows)
    blocks = cut(blocks_of(worded))
    many = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    large = blocks.join(many, "doc_id", "left_semi")
    whole = blocks.join(many, "doc_id", "left_anti")
    return cut(measure_whole(whole).unionByName(measure_spread(cut(large))))


# Rule: name, measure, votes for from, votes against below.
def _rules():
    n = F.greatest("n_words", F.lit(1))
    runs = F.greatest("runs", F.lit(1))
    return [
        ("repeated share", F.col("repeated") / n, SHARE, SHARE),
        ("few distinct runs", 1 - F.col("distinct_runs") / runs, 0.15, 0.02),
        ("one run again and again", F.col("most") * RUN / n, 0.25, 0.12),
        ("words come back", F.col("repeated").cast("double"), 2.0 * RUN, 1.0 * RUN),
    ]


def with_votes(docs: DataFrame) -> DataFrame:
    """Adds share and votes: a string of +, - and 0 for every rule; documents under MIN_WORDS words have every vote against them."""
    votes = [F.when(F.col("n_words") < MIN_WORDS, "-").when(m >= hi - 1e-12, "+").when(m < lo, "-").otherwise("0") for _, m, hi, lo in _rules()]
    return docs.withColumn("share", F.col("repeated") / F.greatest("n_words", F.lit(1))).withColumn("votes", F.concat(*votes))


def fit_votes(counts: dict, prior: float = 0.05, rounds: int = 200) -> dict:
    """Posterior probability of repetition of each vote pattern, by expectation-maximisation.

    counts: pattern to number of documents. Each rule has its own chances of voting for, against or
    abstaining in either class; the start trusts each rule by 0.8.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    k = len(patterns[0])
    code = np.array([["+-0".index(c) for c in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], dtype=float)
    theta = np.empty((2, k, 3))
    theta[1], theta[0] = [0.7, 0.1, 0.2], [0.05, 0.75, 0.2]
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        log = np.log(np.array([1 - prior, prior]))[None, :] + sum(np.log(theta[:, j, code[:, j]]).T for j in range(k))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.max(np.abs(new - post)) < 1e-9
        post = new
        if done:
            break
        for c, q in ((1, post), (0, 1 - post)):
            for j in range(k):
                mass = np.bincount(code[:, j], weights=weight * q, minlength=3) + 2.0 * np.array([0.7, 0.1, 0.2] if c == 1 else [0.05, 0.75, 0.2])
                theta[c, j] = mass / mass.sum()
        prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.5))
    return dict(zip(patterns, post.tolist()))


def judged(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, share, votes, probability of every document that has words."""
    voted = with_votes(measures(rows))
    counts = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3**4 patterns
    post = fit_votes(counts)
    table = rows.sparkSession.createDataFrame([(p, float(v)) for p, v in post.items()] or [("", 0.0)], "votes string, probability double")
    return voted.join(F.broadcast(table), "votes").select("doc_id", "n_words", "share", "votes", "probability")


def repetitive(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents more likely repetitive than not by the votes of all rules; the definition (MIN_WORDS, SHARE) is checked after."""
    likely = judged(rows).where(F.col("probability") >= least)
    return likely.where((F.col("n_words") >= MIN_WORDS) & (F.col("share") >= SHARE - 1e-12)).select("doc_id", "n_words", "share", "probability")
