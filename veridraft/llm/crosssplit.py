"""Records held out for evaluation that also stand, word for word or nearly, in the training split.

The word sets of held-out and training texts meet by keys of their rarest words (``prefixes``: two
sets that overlap enough always share one, and no group of a key grows with the table while longer
keys are left) in one sorted pass (``pairing``, with the lossless bit filter of ``wordsets``; a hot
key is cut into blocks); the overlap of the whole word sets decides. The winnowing fingerprints that
the two texts of a pair have in common are its seeds, chained in line and extended by alignment,
which gives the coverage of the held-out record; without one the common words are the seeds. Texts of
the same words in the same order are one class and cover each other wholly. A text whose words stand
in training in another order is also aligned by its common words with one training text of that set.

Edge cases: records without split, or whose texts are null, empty or under eight words, are never
concerned; repeated rows and repeated texts count once (texts are compared as distinct classes);
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, once, small_or_plain
from .pairing import number_of_parts, pairs_by_key
from .prefixes import KEYED, keyed_texts
from .winnowing import _flat, gram_sketch, select_minima
from .wordrows import hashed_words
from .wordsets import MIN_WORDS, OVERLAP, enough, may_overlap

TRAIN, HELD_OUT = "train", ("val", "test")


def chain_and_extend(a: list, b: list, seeds: list) -> int:
    """Words of ``a`` covered by the best chain of collinear seeds, extended word by word.

    seeds: (place in a, place in b). The gaps between chained seeds are filled by exact matches
    to the left and right (greedy alignment without shift).
    """
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    if not seeds:
        return 0
    # The longest increasing run of places in b, over all seeds: of the chains of k + 1 seeds, ends[k] is the least last place in b, tops[k] its seed.
    ends, tops, back = [], [], []
    for i, (_, y) in enumerate(seeds):
        k = bisect_left(ends, y)
        back.append(tops[k - 1] if k else -1)
        ends[k : k + 1], tops[k : k + 1] = [y], [i]
    i = tops[-1]
    chain = []
    while i >= 0:
        chain.append(seeds[i])
        i = back[i]
    covered: set = set()
    for x, y in chain:
        for step in (1, -1):
            i, j = (x, y) if step == 1 else (x - 1, y - 1)
            while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
                covered.add(i)
                i, j = i + step, j + step
    return len(covered)


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds wset, k1, k2 (of the word set) and c1 (of the sequence). Made when read, so the table need not hold them."""
    sets = rows.select("*", once(F.array_sort(F.array_distinct("seq")), "wset"))
    return sets.withColumns({"k1": F.xxhash64("realm", "wset"), "k2": F.xxhash64("wset", "realm"), "c1": F.xxhash64("realm", "seq")})


KEYS = 8  # of a text, as a rule; only the number of parts goes by it


def candidate_pairs(texts: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """texts: c1, realm, train, held, seq. Distinct a, b: a held-out and a training text of one realm that have a key in common and may overlap enough."""

    def sides(columns):
        return (columns[3] & 1).astype(bool), (columns[3] & 2).astype(bool)

    def match(columns, x, y):
        _, c1, image, _ = columns
        near = (c1[x] != c1[y]) & may_overlap(image[x], image[y], overlap)
        return [c1[x[near]], c1[y[near]]]

    total = texts.count()
    parts = number_of_parts(texts, KEYS * total)
    keyed = keyed_texts(texts, gram_sketch(texts, gram=1), total, parts, overlap)
    return pairs_by_key(keyed, KEYED, match, "a bigint, b bigint", parts, sides=sides).distinct()


class CrossSplitOverlap:
    """Cross-split overlaps of ``records`` (realm, rid, split, source, text); realms are kept apart."""

    def __init__(self, records: DataFrame, overlap: float = OVERLAP):
        known = records.where(F.col("split").isin(TRAIN, *HELD_OUT))
        self.rows = with_keys(cut(hashed_words(known, "text", ["realm", "rid", "split", "source"], MIN_WORDS)))
        is_train = F.col("split") == TRAIN
        #: distinct texts by side; c1 is the key of a text, k1 and k2 of its word set
        self.texts = self.rows.groupBy("c1").agg(*[F.first(c).alias(c) for c in ("realm", "k1", "k2", "seq")], F.bool_or(is_train).alias("train"), F.bool_or(~is_train).alias("held"))
        texts = cut(self.texts)
        by_key = candidate_pairs(texts, overlap).withColumn("by_words", F.lit(False))
        sets = texts.groupBy("k1", "k2").agg(F.min(F.when(F.col("train"), F.col("c1"))).alias("b")).where("b is not null")
        by_set = texts.where("held and not train").join(sets, ["k1", "k2"]).select(F.col("c1").alias("a"), "b", F.lit(True).alias("by_words"))
        met_pairs = cut(by_key.unionByName(by_set))
        ends = met_pairs.select(F.col("a").alias("c1")).unionByName(met_pairs.select(F.col("b").alias("c1"))).distinct()
        met = cut(texts.select("c1", "seq", F.array_distinct("seq").alias("wset")).join(small_or_plain(ends), "c1", "left_semi"))
        x, y = met.alias("x"), met.alias("y")
        both = (
            met_pairs.join(x, F.col("a") == F.col("x.c1"))
            .select("a", "b", "by_words", F.col("x.seq").alias("aseq"), F.col("x.wset").alias("aset"))
            .join(y, F.col("b") == F.col("y.c1"))
            .select("a", "b", "by_words", "aseq", "aset", F.col("y.seq").alias("bseq"), F.col("y.wset").alias("bset"))
        )
        self.pairs = cut(both.mapInArrow(_coverage(overlap, gram_sketch(self.rows)), "a bigint, b bigint, coverage double"))
        #: texts that stand on both sides word for word
        self.equal = texts.where("held and train").select("c1")

    def concerned(self) -> DataFrame:
        """realm, rid, split, source, coverage of each held-out record with a training record that overlaps."""
        held = self.rows.where(F.col("split") != TRAIN).select("realm", "rid", "split", "source", "c1")
        covered = self.pairs.select(F.col("a").alias("c1"), "coverage").unionByName(self.equal.select("c1", F.lit(1.0).alias("coverage")))
        best = covered.groupBy("c1").agg(F.max("coverage").alias("coverage"))
        found = held.join(best, "c1").select("realm", "rid", "split", "source", "coverage")
        return found.groupBy("realm", "rid").agg(F.first("split").alias("split"), F.first("source").alias("source"), F.max("coverage").alias("coverage"))


def _common_words(a: list, b: list) -> list:
    """Seeds of two texts without a common fingerprint: the places of each common word."""
    places: dict = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    return [(i, j) for i, w in enumerate(a) for j in places.get(w, ())]


def _common_marks(a: pa.ListArray, b: pa.ListArray, sketch) -> list:
    """Seeds of each pair of texts: the places of each common winnowing fingerprint."""
    seeds: list = [[] for _ in range(len(a))]
    places: dict = {}
    for row, j, h in zip(*(x.tolist() for x in select_minima(*_flat(b), sketch))):
        places.setdefault((row, h), []).append(j)
    for row, i, h in zip(*(x.tolist() for x in select_minima(*_flat(a), sketch))):
        seeds[row].extend((i, j) for j in places.get((row, h), ()))
    return seeds


def _coverage(overlap: float, sketch):
    """A mapInArrow function: the pairs that overlap enough, with the share of a that b covers."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(enough(batch.column("aset"), batch.column("bset"), overlap))
            if not batch.num_rows:
                continue
            seeds = _common_marks(batch.column("aseq"), batch.column("bseq"), sketch)
            a, b, by_words = (batch.column(c).to_pylist() for c in ("aseq", "bseq", "by_words"))
            share = [chain_and_extend(x, y, (not w and z) or _common_words(x, y)) / len(x) for x, y, w, z in zip(a, b, by_words, seeds)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], names=["a", "b", "coverage"])

    return run
