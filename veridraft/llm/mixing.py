"""Mixing sources to target shares, by balanced (cube) sampling.

A document of a source is used r times on average, r = wanted tokens / tokens of the source, at
most ``max_repeats``. Every document is taken floor(r) times; the fraction left is a chance that
the cube method rounds to 0 or 1: chances move along directions that keep the number of documents
and the number of tokens of their group, until some chance reaches 0 or 1, again and again. Each
group (a source's bucket of at most about BUCKET documents) leaves at most three documents open;
the open ones of all buckets form groups again, so no task ever holds a whole source, and at the
end at most three documents of a source land by chance.

The total is by default the largest at which every source that has documents can give its share
within its repeats; shares are set against the sources that have documents. A source that is
wanted but has none is reported with nothing.

Edge cases: documents of null or unknown source, and those without tokens (null, empty texts) are
not drawn; spellings of a source are settled (case, blanks at the ends, ``_`` for ``-``); a share
of zero draws nothing; ties are broken by the hash of the id; repeated rows of a document are one
document; empty tables give an empty mix.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .bpe import VOCABULARY, encode

BUCKET = 4000
_OPEN = 1e-9


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def fly(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: at most three chances stay strictly between 0 and 1; sums of chances and of chance times size are kept."""
    p = chance.astype(float).copy()
    order = rng.permutation(len(p))
    hand: list = []
    for unit in order:
        if not _OPEN < p[unit] < 1 - _OPEN:
            p[unit] = round(p[unit])
            continue
        hand.append(unit)
        if len(hand) < 3:
            continue
        i, j, k = hand
        u = np.array([size[k] - size[j], size[i] - size[k], size[j] - size[i]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        _step(p, hand, u, rng)
        hand = [x for x in hand if _OPEN < p[x] < 1 - _OPEN]
    return p


def _step(p: np.ndarray, hand: list, u: np.ndarray, rng: np.random.Generator) -> None:
    """Move the chances of ``hand`` along u or against it to the first bound; the mean stays."""
    q = p[hand]
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
        down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
    q = q + (up * u if rng.random() < down / (up + down) else -down * u)
    p[hand] = np.where(q < _OPEN, 0.0, np.where(q > 1 - _OPEN, 1.0, q))


def land(chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: the token sum is given up, then the count, so every chance ends at 0 or 1."""
    p = chance.astype(float).copy()
    while True:
        hand = [i for i in range(len(p)) if _OPEN < p[i] < 1 - _OPEN]
        if len(hand) < 2:
            break
        _step(p, hand[:2], np.array([1.0, -1.0]), rng)
    for i in hand:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def _flight(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{group['source'].iloc[0]}|{group['bucket'].iloc[0]}".encode()))
        p = fly(group["chance"].to_numpy(), group["n_tokens"].to_numpy(dtype=float), rng)
        return group.assign(chance=land(p, rng) if last else p)

    return run


def balanced_draw(chances: DataFrame, seed: int = 42) -> DataFrame:
    """chances: doc_id, source, n_tokens, chance. Returns doc_id, source of the drawn documents."""
    spark = chances.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chances.schema) + ", bucket int"
    open_rows, drawn, level = chances, [], 0
    while True:
        counts = {r.source: r.n for r in open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            break
        last = max(counts.values()) <= BUCKET
        parts = {s: -(-n // BUCKET) for s, n in counts.items()}
        table = F.broadcast(spark.createDataFrame(list(parts.items()), "source string, parts int"))
        keyed = open_rows.join(table, "source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id"), F.col("parts")).cast("int"))
        moved = cut(keyed.select(*chances.columns, "bucket").groupBy("source", "bucket").applyInPandas(_flight(seed + level, last), schema))
        drawn.append(moved.where(F.col("chance") == 1).select("doc_id", "source"))
        if last:
            break
        open_rows, level = moved.where((F.col("chance") > 0) & (F.col("chance") < 1)).select(*chances.columns), level + 1
    if not drawn:
        return chances.select("doc_id", "source").limit(0)
    out = drawn[0]
    for d in drawn[1:]:
        out = out.unionByName(d)
    return out


class Mixture:
    """A mix of ``documents`` (doc_id, source, text) by ``targets`` (source, target_share, max_repeats)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 42):
        spark = documents.sparkSession
        wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
        self.targets = {r.source: (max(0.0, r.share or 0.0), max(0, r.most or 0)) for r in wanted.where("source is not null").collect()}  # one row for each source
        named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(*self.targets) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        sized = encode(named, vocabulary=vocabulary, lengths_only=True, keep=("source",)).where("n_tokens > 0")
        self.sized = cut(sized.dropDuplicates(["doc_id"]))
        sizes = {r.source: r.t for r in self.sized.groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("t")).collect()}
        self.sizes = sizes
        live = {s: (share, most) for s, (share, most) in self.targets.items() if share > 0 and most > 0 and sizes.get(s)}
        mass = sum(share for share, _ in live.values())
        if total_tokens is None:
            total_tokens = min((most * sizes[s] * mass / share for s, (share, most) in live.items()), default=0)
        self.total = total_tokens
        rates = {s: min(float(most), share / mass * total_tokens / sizes[s]) for s, (share, most) in live.items()}
        near = {s: (round(r) if abs(r - round(r)) < 1e-9 else r) for s, r in rates.items()}
        table = spark.createDataFrame([(s, int(r), float(r - int(r))) for s, r in near.items()], "source string, base int, chance double")
        rated = self.sized.join(F.broadcast(table), "source")
        drawn = balanced_draw(rated.where("chance > 0").select("doc_id", "source", "n_tokens", "chance"), seed)
        extra = drawn.select("doc_id", F.lit(1).alias("extra"))
        self.rows = cut(
            rated.join(extra, "doc_id", "left")
            .select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int").alias("repeats"))
            .where("repeats > 0")
        )

    def shares(self) -> DataFrame:
        """source, documents, tokens, actual_share, target_share, max_repeats of every source of the targets."""
        spark = self.rows.sparkSession
        got = self.rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
        whole = got.agg(F.sum("tokens").alias("all"))
        table = spark.createDataFrame([(s, share, most) for s, (share, most) in self.targets.items()], "source string, target_share double, max_repeats int")
        return (
            table.join(got, "source", "left")
            .crossJoin(whole)  # one row
            .select(
                "source",
                F.coalesce("documents", F.lit(0)).alias("documents"),
                F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.coalesce("repeats", F.lit(0)).alias("most_repeats"),
                F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"),
                "target_share",
                "max_repeats",
            )
        )
