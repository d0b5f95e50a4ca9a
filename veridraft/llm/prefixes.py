"""Keys of word sets by their rarest words: two sets of enough overlap have a key in common, always.

The words of a set are put in one order for all texts, the rarest first (counts from a count-min
sketch over all texts, ties by the word's hash). If two sets overlap by t, a set of n words lacks at
most s = n - ceil(t n) words of the other, so the common word of place j (from 0) stands at place
s + j at most in either. A key is a run of first common words: it grows until so few texts are
likely to hold all its words that comparing them costs less than a further key (``FEW``), or until
the longest key of its zone of sizes. That depends on the words and the zone alone, so both sets stop
at the same word. A key's group thus does not grow with the table while longer keys are left.

Longer sets have shorter keys, else there would be too many (``ZONES``). A set from which a partner
may stand in the next zone has the keys of both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..runtime import sketch_count
from .bagminhash import _mix
from .pairing import BLOCK, Packer
from .winnowing import _flat, rolling_hashes
from .wordrows import distinct_sorted
from .wordsets import OVERLAP, images_of

#: Texts likely to hold a key's words, from which on it gets a further word.
FEW = 512
#: Sizes from which on keys have so many words at most. Each begins at over 1 / t of the one before.
ZONES = ((1, 4), (32, 3), (64, 2), (160, 1))
SLICE = 1024  # texts whose keys are made together
_BASE = np.uint64(0x9E3779B97F4A7C15)


def zones_of(n: np.ndarray, t: float = OVERLAP):
    """First and last zone of the partners of ``n`` or more words of sets of ``n`` words."""
    starts = np.array([z for z, _ in ZONES])
    return np.searchsorted(starts, n, "right") - 1, np.searchsorted(starts, np.floor(n / t + 1e-6), "right") - 1


def set_keys(values: np.ndarray, offsets: np.ndarray, sketch, total: int, t: float = OVERLAP, few: float = FEW):
    """(row, key) of the flattened distinct words of non-empty sets."""
    n = np.diff(offsets)
    h = rolling_hashes(values, 1)
    count = np.maximum(1, sketch_count(sketch, h.view(np.int64)))
    order = np.lexsort((h, count, np.repeat(np.arange(len(n)), n)))
    h, share = h[order], np.minimum(1.0, count[order] / max(1, total))
    need = np.ceil(t * n - 1e-6).astype(np.int64)
    lacks = n - need
    first, last = zones_of(n, t)
    # Sets of up to three words only overlap enough with their equals if t is 0.8 or more; larger ones then have four words in common.
    longest = np.array([k if t >= 0.8 else 1 for _, k in ZONES])
    rows, keys = [], []
    for zone in range(len(ZONES)):
        row = np.flatnonzero((first <= zone) & (zone <= last))
        place, key, chance = np.full(len(row), -1), np.zeros(len(row), dtype=np.uint64), np.full(len(row), float(total))
        for j in range(longest[zone]):
            reach = lacks[row] + j - place  # the next word is one of so many
            at = np.repeat(np.arange(len(row)), reach)
            step = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
            row, place = row[at], place[at] + 1 + step
            word = offsets[row] + place
            with np.errstate(over="ignore"):
                key = _mix(key[at] * _BASE + h[word] + np.uint64(zone + 1))
            chance = chance[at] * share[word]
            whole = (chance <= few) | (j + 1 >= np.minimum(longest[zone], need[row]))
            rows.append(row[whole])
            keys.append(key[whole])
            row, place, key, chance = row[~whole], place[~whole], key[~whole], chance[~whole]
    return np.concatenate(rows), np.concatenate(keys)


KEYED = "key bigint, c1 bigint, image bigint, side int"


def keyed_texts(texts: DataFrame, sketch, total: int, parts: int, t: float = OVERLAP) -> DataFrame:
    """Packed rows (KEYED) of texts (c1, realm, train, held, seq): a key (of its realm), the text, the image of its word set,
    and 2 for a training plus 1 for a held-out text. Texts have a word at least."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # 1 MB whatever the data

    def run(batches):
        packer = Packer(["bigint", "bigint", "bigint", "int"], parts)
        for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, whole.num_rows, SLICE)):
            c1, realm, train, held = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            values, offsets = distinct_sorted(*_flat(batch.column(4)))
            values = values.astype(np.int64)
            row, key = set_keys(values, offsets, shared.value, total, t)
            with np.errstate(over="ignore"):
                key = _mix(key + realm[row].view(np.uint64)).view(np.int64)
            yield from packer.add([key, c1[row], images_of(values, offsets)[row], (2 * train + held)[row]])
        yield from packer.flush()

    return texts.select("c1", "realm", "train", "held", "seq").mapInArrow(run, BLOCK)
