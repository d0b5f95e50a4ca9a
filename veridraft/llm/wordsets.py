"""Texts as sets of word hashes, with an exact overlap test and a lossless cheap filter.

The overlap of two texts is |A and B| / |A or B| over their distinct words. Two sets of overlap
at least t differ in at most (1-t)/(1+t) * (|A|+|B|) words, and two 56-bit images of the sets
differ in no more bits than the sets in words. So ``may_overlap`` rejects no true pair, and costs
one XOR and one population count per candidate, within the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 8
OVERLAP = 0.8


def common_words(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Number of common members of the sets of 32-bit hashes in each row of two list columns."""

    def keyed(lists):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        return (np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(offsets)) << 32) | (values + (1 << 31))

    both = np.sort(np.concatenate([keyed(a), keyed(b)]))
    return np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(a))


def enough(a: pa.ListArray, b: pa.ListArray, t: float = OVERLAP) -> pa.Array:
    """Which rows' sets (32-bit hashes, distinct) overlap by ``t`` or more: |A and B| (1 + t) >= t (|A| + |B|)."""
    low = t - 1e-9
    sizes = np.diff(a.offsets.to_numpy().astype(np.int64)) + np.diff(b.offsets.to_numpy().astype(np.int64))
    return pa.array(common_words(a, b) * (1 + low) >= sizes * low)


def overlapping(df: DataFrame, a: str, b: str, keep: list, t: float = OVERLAP) -> DataFrame:
    """The columns ``keep`` of the rows whose sets ``a`` and ``b`` (array<int>, distinct) overlap by ``t`` or more."""
    inner = [c for c in df.columns if c in keep or c in (a, b)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(enough(batch.column(inner.index(a)), batch.column(inner.index(b)), t)).select(keep)

    return df.select(*inner).mapInArrow(run, df.select(*keep).schema)


def spread_hash(words32: Column) -> Column:
    """A bigint whose top and low 16 bits are those of a 32-bit hash (the two slots of a count sketch)."""
    wide = words32.cast("bigint")
    return F.call_function("shiftleft", wide, F.lit(32)).bitwiseXOR(wide.bitwiseAND(F.lit(0xFFFF)))


def hash_again(words32):
    """numpy twin of :func:`spread_hash`."""
    wide = words32.astype("int64")
    return (wide << 32) ^ (wide & 0xFFFF)


_BITS = (1 << 56) - 1


def images_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Images of non-empty sets given as flattened values: 56 bits of the set and, in the top 8, its size (255: that or more)."""
    bits = np.left_shift(np.int64(1), np.mod(values.astype(np.int64), 56))
    size = np.minimum(np.diff(offsets), 255)
    return np.bitwise_or.reduceat(bits, offsets[:-1]) | np.left_shift(size.astype(np.int64), 56) if len(size) else np.empty(0, dtype=np.int64)


def may_overlap(a: np.ndarray, b: np.ndarray, t: float = OVERLAP) -> np.ndarray:
    """False only for pairs of images whose overlap is surely under ``t``; sets of 255 words and more always may."""
    m, n = (a.view(np.uint64) >> np.uint64(56)).astype(np.int64), (b.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    differ = np.bitwise_count((a ^ b) & _BITS)
    return (differ <= (m + n) * ((1 - t) / (1 + t)) + 1e-6) | (m == 255) | (n == 255)
