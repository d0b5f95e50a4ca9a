"""Words of texts as 32-bit hashes, made in one Arrow pass: consistent form, words, hashes.

Two words of a pair of texts agree by chance once in some 10**7 pairs. A worker remembers the
hashes of words it has met (at most KEPT), so a word costs one look-up.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .canonical import canonical_text

KEPT = 200_000
_WORDS = re.compile(r"[^\W_]+")


#: ASCII bytes to lower-case letters and digits, all else to a blank.
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) - (1 << 31)
        return h


_HASHES = _Hashes()


def words_of(form: str) -> list:
    """The words of a consistent form, in order, as UTF-8: runs of letters and digits, lower case."""
    if form.isascii():
        return form.encode().translate(_PLAIN).split()
    return [w.encode("utf-8", "replace") for w in _WORDS.findall(form.lower())]


def distinct_sorted(values: np.ndarray, offsets: np.ndarray):
    """Values and offsets of the lists as sorted sets."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keyed = np.sort((row << 32) | (values.astype(np.int64) + (1 << 31)))
    fresh = np.ones(len(keyed), dtype=bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[fresh]
    at = np.searchsorted(keyed >> 32, np.arange(len(offsets)))
    return ((keyed & 0xFFFFFFFF) - (1 << 31)).astype(np.int32), at


def hashed_words(df: DataFrame, text: str, keep: list, least: int, as_set: bool = False, form_key: bool = False) -> DataFrame:
    """keep, with ``form_key`` fkey (of the consistent form), and seq: the hashes of the words in order (wset: the sorted set of them).

    Rows of texts that are null or have under ``least`` words are left out.
    """
    kept = df.select(*keep).schema
    name = "wset" if as_set else "seq"
    names = [*keep, *(["fkey"] if form_key else []), name]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + ("fkey bigint, " if form_key else "") + f"{name} array<int>"

    def run(batches):
        hashes = _HASHES.__getitem__
        for batch in batches:
            which, lists, keys = [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                if t is None:
                    continue
                form = canonical_text(t)
                words = words_of(form)
                if len(words) >= least:
                    which.append(i)
                    lists.append(words)
                    if form_key:
                        keys.append(xxhash.xxh64_intdigest(form.encode("utf-8", "replace")) - (1 << 63))
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            values = np.fromiter(map(hashes, itertools.chain.from_iterable(lists)), dtype=np.int32, count=int(offsets[-1]))
            if as_set:
                values, offsets = distinct_sorted(values, offsets)
            out = batch.take(pa.array(which, pa.int32())).columns[: len(keep)]
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(keys, pa.int64())] if form_key else []), listed], names=names)

    return df.select(*keep, text).mapInArrow(run, schema)
