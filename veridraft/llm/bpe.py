"""Encoding of a corpus with a public byte-level BPE vocabulary, by corpus-level merge replay.

1. Texts are cut into words (in the sense of the vocabulary's splitting pattern) once. Blocks of
   documents become lists of places in a dictionary of the block's distinct words.
2. The distinct words of the corpus form one table. For the words of a partition of it an index maps
   each adjacent token pair to the places where it stands, and the merges are applied in rank order
   to all their places at once, touching only the neighbours of merged places. A word is encoded
   once, however often and wherever it stands.
3. The ids go back to the dictionaries of the blocks, and the blocks' documents are put together from
   them as arrays.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: under 1 MB for
50,000 tokens, whatever the data. A word stands once in each dictionary, so the join of step 3 has no
key with more rows than there are blocks (of some BLOCK_DOCUMENTS documents).

Edge cases: null, empty and blank-only texts: null and empty give an empty list of ids, blanks are
encoded as blanks; a text of any length is encoded whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_DOCUMENTS, BLOCK_WORDS, STEP = 4_000, 2_000_000, 500
# White_Space of Unicode.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class_of(kind: str) -> str:
    """Ranges of all characters whose category begins with ``kind``."""
    out, start = [], None
    for o in range(sys.maxunicode + 2):
        inside = o <= sys.maxunicode and unicodedata.category(chr(o))[0] == kind
        if inside and start is None:
            start = o
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{o - 1:08x}")
            start = None
    return "".join(out)


@functools.lru_cache(maxsize=1)
def split_pattern() -> re.Pattern:
    """The public splitting pattern of the vocabulary, with its classes spelled out."""
    letter, number = _class_of("L"), _class_of("N")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def read_ranks(path: str = VOCABULARY) -> dict:
    """Token bytes to id, from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes words by replaying the merges of a vocabulary over a table of them."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.token = {v: k for k, v in ranks.items()}
        self.merged: dict = {}

    def _merge(self, a: int, b: int):
        """Id of the token that a and b make, or None."""
        key = (a, b)
        if key not in self.merged:
            self.merged[key] = self.ranks.get(self.token[a] + self.token[b])
        return self.merged[key]

    def replay(self, words: list) -> list:
        """Ids of each of the words (bytes, none empty)."""
        of_byte, merge = self.of_byte, self._merge
        ids = [of_byte[b] for w in words for b in w]
        n = len(ids)
        first = np.zeros(n + 1, dtype=bool)
        first[np.cumsum([0, *map(len, words)])] = True
        before = [-1 if f else i - 1 for i, f in enumerate(first[:n])]
        after = [-1 if f else i + 1 for i, f in enumerate(first[1:])]
        places: dict = {}  # pair -> left places
        for i in range(n):
            j = after[i]
            if j >= 0:
                places.setdefault((ids[i], ids[j]), []).append(i)
        queue = [(r, p) for p in places if (r := merge(*p)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, pair = heapq.heappop(queue)
            a, b = pair
            for i in sorted(places.pop(pair, ())):
                j = after[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue  # an overlapping merge has taken one of the two
                ids[i], ids[j] = rank, -1
                k = after[j]
                after[i] = k
                if k >= 0:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left >= 0 and right >= 0:
                        new = (ids[left], ids[right])
                        at = places.get(new)
                        if at is None:
                            places[new] = [left]
                            r = merge(*new)
                            if r is not None:
                                heapq.heappush(queue, (r, new))
                        else:
                            at.append(left)
        out, at = [], 0
        for w in words:
            out.append(tuple(t for t in ids[at : at + len(w)] if t >= 0))
            at += len(w)
        return out


class _Places(dict):
    """The place of each word in a dictionary that grows as words are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def coded(df: DataFrame, names: list, text: str) -> DataFrame:
    """block, ``names`` and codes of every row, and a row of block and words (its dictionary) for each block."""
    kept = df.select(*names).schema
    schema = "block bigint, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "codes array<int>, words array<binary>"

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        split = split_pattern().findall
        places, block = _Places(), 0
        documents = words_met = 0

        def dictionary(like):
            words = pa.array([[w.encode("utf-8", "replace") for w in places]], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([base + block]), *[pa.nulls(1, c.type) for c in like], pa.nulls(1, pa.list_(pa.int32())), words], names=["block", *names, "codes", "words"])

        like = None
        for batch in batches:
            like = batch.columns[: len(names)]
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                lists = [split(t) if t else [] for t in part.column(len(names)).to_pylist()]
                sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
                total = int(sizes.sum())
                flat = np.fromiter(map(places.__getitem__, itertools.chain.from_iterable(lists)), dtype=np.int32, count=total)
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lists), base + block)), *part.columns[: len(names)], codes, pa.nulls(len(lists), pa.list_(pa.binary()))], names=["block", *names, "codes", "words"]
                )
                documents, words_met = documents + len(lists), words_met + total
                if documents >= BLOCK_DOCUMENTS or words_met >= BLOCK_WORDS:
                    yield dictionary(like)
                    places, block, documents, words_met = _Places(), block + 1, 0, 0
        if documents:
            yield dictionary(like)

    return cut(df.select(*names, text).mapInArrow(run, schema))


def word_ids(words: DataFrame, held) -> DataFrame:
    """words: word (distinct). word, ids: the merges of the vocabulary (a broadcast) replayed over the words of a partition."""

    def run(batches):
        replay = MergeReplay(held.value).replay
        for batch in batches:
            ids = replay([w.as_py() for w in batch.column(0)])
            n = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))], names=["word", "ids"])

    return words.mapInArrow(run, "word binary, ids array<int>")


def _lists(column) -> tuple:
    """Flat values and offsets of a list column of a table."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(chunk, pa.ChunkedArray):
        chunk = pa.concat_arrays(chunk.chunks)
    offsets = chunk.offsets.to_numpy().astype(np.int64)
    return chunk.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def put_together(codes: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Token ids of documents (flat, and where each begins) from codes (flat, documents begin at ``at``) and the ids of each code."""
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return flat, ends[at]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False, keep: tuple = ()) -> DataFrame:
    """key and ids (array of int) of every row; with ``lengths_only`` key and n_tokens (int) instead. ``keep``: further columns to pass on."""
    held = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    names = [key, *keep]
    blocks = coded(df, names, text)
    entries = blocks.where("words is not null").select("block", F.posexplode("words").alias("place", "word"))
    encoded = entries.join(word_ids(entries.select("word").distinct(), held), "word").select(F.col("block").alias("of_block"), "place", "ids")
    documents = blocks.where("words is null").select("block", *names, "codes")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
        codes, at = _lists(docs.column("codes"))
        ids, begin = _lists(dictionary.column("ids"))
        place = dictionary.column("place").to_numpy()
        starts, sizes = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        starts[place], sizes[place] = begin[:-1], np.diff(begin)
        if lengths_only:
            ends = np.concatenate([[0], np.cumsum(sizes[codes])])[at]
            return pa.table([*[docs.column(n) for n in names], pa.array(np.diff(ends).astype(np.int32))], names=[*names, "n_tokens"])
        flat, ends = put_together(codes, at, ids, starts, sizes)
        return pa.table([*[docs.column(n) for n in names], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=[*names, "ids"])

    return documents.groupBy("block").cogroup(encoded.groupBy("of_block")).applyInArrow(run, f"{kinds}, " + ("n_tokens int" if lengths_only else "ids array<int>"))
