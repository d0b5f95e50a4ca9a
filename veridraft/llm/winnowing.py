"""Winnowing: selected minima of a rolling hash over the words of a text.

In every window of WINDOW successive word n-grams the rarest is selected (rarity: power of two of
its count in a count-min sketch over all rows), ties by the hash itself. Two texts that share a
run of GRAM + WINDOW - 1 words select the same gram within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sketch_count
from .bagminhash import _mix

GRAM, WINDOW = 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(values: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` words from each place of the flattened texts on (the last ones wrap; the caller masks them)."""
    v = values.view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(v), dtype=np.uint64)
        for i in range(gram):
            h = h * _BASE + np.roll(v, -i)
        return _mix(h)


def _flat(column: pa.ListArray):
    """Values and offsets of a list column, the values without what lies before the first offset."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def select_minima(values: np.ndarray, offsets: np.ndarray, sketch, gram: int = GRAM, window: int = WINDOW):
    """(row, place, hash) of the selected grams of the flattened texts; texts under ``gram`` words have none."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) - offsets[row]
    whole = place <= n[row] - gram
    h = rolling_hashes(values, gram)
    rarity = np.floor(np.log2(np.maximum(1, sketch_count(sketch, h.view(np.int64))))).astype(np.uint64)
    rank = (rarity << np.uint64(57)) | (h >> np.uint64(7))
    h, rank, row, place, left = h[whole], rank[whole], row[whole], place[whole], (n[row] - gram - place)[whole]
    m = len(h)
    best = np.arange(m)
    for i in range(1, window):
        other = np.minimum(np.arange(m) + i, m - 1)
        better = (left >= i) & (rank[other] < rank[best])
        best = np.where(better, other, best)
    starts = (left >= window - 1) | (place == 0)  # a short text is one window
    chosen = np.unique(best[starts])
    return row[chosen], place[chosen], h[chosen].view(np.int64)


def gram_sketch(rows: DataFrame, col: str = "seq", bits: int = 16, gram: int = GRAM):
    """Count-min sketch of the grams of all rows (see runtime.bucket_counts for layout and bound)."""
    size = 1 << bits

    def run(batches):
        total = np.zeros(2 * size, dtype=np.int64)
        for batch in batches:
            values, offsets = _flat(batch.column(0))
            if not len(values):
                continue
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            h = rolling_hashes(values, gram)[(np.arange(len(values)) - offsets[row]) <= n[row] - gram]
            total[:size] += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=size)
            total[size:] += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["slot", "n"])

    out = np.zeros(2 * size, dtype=np.int64)
    for r in rows.select(col).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out
