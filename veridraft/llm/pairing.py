"""Pairs of rows that share a key, found in one pass over a single shuffle of packed rows.

The Python stage that makes the rows packs them, as arrays of numbers, into a block for each
partition (by key, about PART rows to a partition), so the shuffle moves a few blocks instead of
millions of rows. A partition is sorted in numpy: keys that stand alone fall out at once, and a
group of up to ``bound`` rows is paired with a cheap match test. A larger group is never held:
whenever a task holds HELD rows it lets the rows of such groups go as they are, and those to come;
they are cut into blocks of about ``bound`` rows, and every two blocks meet in a group of their
own, so any number of tasks share a hot key and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

BOUND, PART, HELD, CHUNK, PACKED = 4096, 1 << 20, 1 << 22, 1 << 17, 1 << 18
BLOCK_ROWS = 1 << 13  # some 250 KB: larger arrays fragment the heap of the JVM that moves them


STEP = 1 << 20  # pairs looked at together


def _pairs(key: np.ndarray, ident: np.ndarray):
    """(left, right) index arrays, step by step, of all pairs of rows with one key; rows repeated by ident count once."""
    order = np.lexsort((ident, key))
    k, d = key[order], ident[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    order = order[fresh]
    k = key[order]
    at, step = np.arange(len(order)), 1
    while True:
        at = at[at + step < len(order)]
        at = at[k[at] == k[at + step]]
        if not len(at):
            return
        yield order[at], order[at + step]
        step += 1


def _across(key: np.ndarray, first: np.ndarray, second: np.ndarray):
    """(left, right) index arrays of all pairs of a ``first`` and a ``second`` row with one key (sorted); a row of both sides meets itself too."""
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.empty(0, dtype=np.int64)
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    if not len(left) or not len(right):
        return
    count = np.bincount(group[right], minlength=int(group[-1]) + 1)
    start = np.cumsum(count) - count
    left = left[count[group[left]] > 0]
    reps = count[group[left]]
    ends = np.cumsum(reps)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
        r = reps[a:b]
        within = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
        yield np.repeat(left[a:b], r), right[np.repeat(start[group[left[a:b]]], r) + within]
        a = b


_NUMPY = {"int": np.dtype(np.int32), "bigint": np.dtype(np.int64)}
_ARROW = {"int": pa.int32(), "bigint": pa.int64()}
BLOCK = "part int, data binary"


def number_of_parts(df: DataFrame, rows: int) -> int:
    """Partitions for about ``rows`` rows: as many as the session's shuffles have, more where they would hold over PART rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))


class Packer:
    """Gathers rows (key and further columns, as arrays) and gives them out as blocks by partition of the key."""

    def __init__(self, kinds: list, parts: int):
        self.kinds, self.parts, self.waiting, self.size = [_NUMPY[k] for k in kinds], parts, [], 0

    def add(self, columns: list):
        self.waiting.append([np.asarray(c, dtype=t) for c, t in zip(columns, self.kinds)])
        self.size += len(columns[0])
        if self.size >= PACKED:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.waiting)]
        self.waiting, self.size = [], 0
        with np.errstate(over="ignore"):
            part = ((columns[0].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")
        columns, part = [c[order] for c in columns], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        data = [b"".join(c[i : min(i + BLOCK_ROWS, b)].tobytes() for c in columns) for a, b in zip(edges, edges[1:]) for i in range(a, b, BLOCK_ROWS)]
        where = [part[a] for a, b in zip(edges, edges[1:]) for _ in range(a, b, BLOCK_ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _unpacked(data: bytes, kinds: list) -> list:
    n = len(data) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, dtype=k, count=n, offset=at))
        at += n * k.itemsize
    return out


def _pass(names: list, kinds: list, out: list, out_kinds: list, match: Callable, bound: int, sides: Callable | None):
    """A mapInArrow function: blocks of rows (key, identity, further columns), all of a key in one partition, to pairs, and to the rows of groups over ``bound``."""
    layout = [_NUMPY[k] for k in kinds]
    types = [_ARROW[k] for k in [*out_kinds, *kinds]]

    def result(pairs: list, hot: list):
        n = sum(len(p[0]) for p in pairs)
        m = sum(len(h[0]) for h in hot)
        columns = []
        for i, t in enumerate(types[: len(out)]):
            values = np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
            columns.append(pa.concat_arrays([pa.array(values).cast(t), pa.nulls(m, t)]))
        for i, t in enumerate(types[len(out) :]):
            values = np.concatenate([h[i] for h in hot]) if hot else np.empty(0, dtype=np.int64)
            columns.append(pa.concat_arrays([pa.nulls(n, t), pa.array(values).cast(t)]))
        return pa.RecordBatch.from_arrays(columns, names=[*out, *[f"hot_{c}" for c in names]])

    def large_keys(key: np.ndarray) -> np.ndarray:
        keys, n = np.unique(key, return_counts=True)
        return keys[n > bound]

    def run(batches):
        parts: list = []
        held, limit, gone = 0, HELD, np.empty(0, dtype=np.int64)
        for columns in (_unpacked(d.as_buffer(), layout) for batch in batches for d in batch.column("data")):
            if len(gone) and (hot := np.isin(columns[0], gone)).any():
                yield result([], [[c[hot] for c in columns]])
                columns = [c[~hot] for c in columns]
            parts.append(columns)
            held += len(columns[0])
            if held > limit:
                columns = [np.concatenate(c) for c in zip(*parts)]
                gone = np.union1d(gone, large_keys(columns[0]))
                hot = np.isin(columns[0], gone)
                for a in range(0, int(hot.sum()), CHUNK):
                    some = np.flatnonzero(hot)[a : a + CHUNK]
                    yield result([], [[c[some] for c in columns]])
                parts = [[c[~hot] for c in columns]]
                held = len(parts[0][0])
                limit = max(limit, 2 * held)
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*parts)]
        del parts
        order = np.argsort(columns[0])
        key = columns[0][order]
        same = key[1:] == key[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        columns = [c[order] for c in columns]
        edges = _edges(columns[0])
        a = 0
        while a < len(edges) - 1:  # whole groups, some CHUNK rows together
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK)) - 1)
            hot: list = []
            yield result(_groups([c[edges[a] : edges[b]] for c in columns], match, bound, hot, sides), hot)
            a = b

    return run


def _groups(columns: list, match: Callable, bound: int, hot: list, sides: Callable | None) -> list:
    """Pairs of the whole groups in ``columns``; groups over ``bound`` go to ``hot``, those without a row of each side nowhere."""
    edges = _edges(columns[0])
    if sides is not None and len(edges) > 1:
        met = np.logical_and.reduce([np.logical_or.reduceat(s, edges[:-1]) for s in sides(columns)]) & (np.diff(edges) > 1)
        keep = np.repeat(met, np.diff(edges))
        columns = [c[keep] for c in columns]
        edges = _edges(columns[0])
    large = np.diff(edges) > bound
    if large.any():
        keep = ~np.repeat(large, np.diff(edges))
        hot.append([c[~keep] for c in columns])
        columns = [c[keep] for c in columns]
    if not len(columns[0]):
        return []
    found = _pairs(columns[0], columns[1]) if sides is None else _across(columns[0], *sides(columns))
    return [out for left, right in found if len((out := match(columns, left, right))[0])]


def _edges(key: np.ndarray) -> np.ndarray:
    """Where the groups of sorted keys begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, dtype=np.int64)


def _spec(text: str) -> tuple:
    """Names and types of ``name type, ...``."""
    pairs = [part.split() for part in text.split(",")]
    return [n for n, _ in pairs], [k for _, k in pairs]


def pairs_by_key(blocks: DataFrame, rows: str, match: Callable, out: str, parts: int, bound: int = BOUND, sides: Callable | None = None) -> DataFrame:
    """Pairs of rows with one key.

    blocks: BLOCK rows of a :class:`Packer` with ``parts`` partitions; rows: the packed columns
    (``name type, ...``): key, identity and further ones. ``match`` gets the columns and the places
    of the left and right rows of pairs and returns the columns ``out`` (``name type, ...``) of those
    that match. ``sides``: gives from the columns which rows are of the first and which of the second
    side; then only pairs across are looked at. Returns ``out``, each row at least once.
    """
    (names, kinds), (out_names, out_kinds) = _spec(rows), _spec(out)
    schema = out + "".join(f", hot_{n} {k}" for n, k in zip(names, kinds))
    told = cut(blocks.repartitionById(parts, F.col("part")).mapInArrow(_pass(names, kinds, out_names, out_kinds, match, bound, sides), schema))
    hot = told.where(f"hot_{names[0]} is not null").select(*[F.col(f"hot_{c}").alias(c) for c in names]).distinct()
    sizes = hot.groupBy(names[0]).agg(F.ceil(F.count(F.lit(1)) / bound).cast("int").alias("_s"))
    halves = hot.join(sizes, names[0]).withColumn("_b", F.pmod(F.xxhash64(F.lit(11), *names[1:]), F.col("_s")).cast("int"))
    met = halves.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    again = met.select(F.xxhash64(names[0], F.least("_b", "_o"), F.greatest("_b", "_o")).alias("_k"), *names[1:])
    wide = ["bigint", *kinds[1:]]

    def pack(batches):
        packer = Packer(wide, parts)
        for batch in batches:
            yield from packer.add([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield from packer.flush()

    # Two blocks of about ``bound`` rows each: far below the bound of this pass.
    met_schema = schema.replace(f"hot_{names[0]} {kinds[0]}", "hot__k bigint")
    second = again.mapInArrow(pack, BLOCK).repartitionById(parts, F.col("part")).mapInArrow(_pass(["_k", *names[1:]], wide, out_names, out_kinds, match, 64 * bound, sides), met_schema)
    return told.where(f"hot_{names[0]} is null").select(*out_names).unionByName(second.select(*out_names))
