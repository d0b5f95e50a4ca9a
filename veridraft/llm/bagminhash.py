"""BagMinHash signatures of weighted word sets, vectorised.

Each (word, component) owns a Poisson process over the weight axis [0, 2**DEPTH). Its earliest
point below the word's discrete weight w is the word's value; the signature component is the
smallest value over the words of the text, so two texts agree in a component with probability
equal to their weighted Jaccard overlap. The process is hierarchical: the earliest point of a
dyadic interval falls into one half by a fair coin, the other half waits for an extra exponential
time, and only the intervals on the way to w are split. Values depend on (word, interval,
component) alone, hence agree for all weights and all machines.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5  # weights are 1 .. 2**DEPTH


def _mix(z):
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _random(words, node, components):
    """Uniform 64-bit values, one row per word, for one interval number per word."""
    with np.errstate(over="ignore"):
        seed = _mix(words.view(np.uint64) + (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return _mix(seed[:, None] + np.arange(1, components + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))


def _exponential(r, rate):
    u = ((r >> np.uint64(12)).astype(np.float64) + 0.5) * (1.0 / (1 << 52))
    return -np.log(u) / rate


def word_values(words: np.ndarray, weights: np.ndarray, components: int) -> np.ndarray:
    """Earliest point below the weight, for every word and component (float64)."""
    n = len(words)
    lo = np.zeros(n, dtype=np.int64)
    width = np.full(n, 1 << DEPTH, dtype=np.int64)
    node = np.ones(n, dtype=np.int64)
    t = _exponential(_random(words, node, components), float(1 << DEPTH))
    best = np.full((n, components), np.inf)
    live = np.arange(n)
    for _ in range(DEPTH + 1):
        full = weights[live] == lo[live] + width[live]
        if full.any():
            i = live[full]
            best[i] = np.minimum(best[i], t[i])
            live = live[~full]
        if not len(live):
            break
        half = width[live] // 2
        r = _random(words[live], node[live] + (1 << (DEPTH + 2)), components)
        coin = (r & np.uint64(1)).astype(bool)
        late = t[live] + _exponential(r, half[:, None].astype(np.float64))
        left = np.where(coin, t[live], late)
        right = np.where(coin, late, t[live])
        go_right = weights[live] > lo[live] + half
        i = live[go_right]
        best[i] = np.minimum(best[i], left[go_right])
        t[live] = np.where(go_right[:, None], right, left)
        lo[live] += np.where(go_right, half, 0)
        node[live] = node[live] * 2 + go_right
        width[live] = half
    return best


class Signer:
    """Signatures of batches of word sets; keeps the values of words seen lately."""

    def __init__(self, weight_of, components: int, keep: int = 60_000):
        self.weight_of, self.components, self.keep = weight_of, components, keep
        self._forget(keep)

    def _forget(self, room: int) -> None:
        self.words = np.empty(0, dtype=np.int64)  # sorted
        self.place = np.empty(0, dtype=np.int64)  # row in values of each of the sorted words
        self.values = np.empty((room, self.components))

    def _rows(self, wanted: np.ndarray) -> np.ndarray:
        """Rows in ``values`` of sorted distinct words."""
        new = np.setdiff1d(wanted, self.words, assume_unique=True)
        if len(self.words) + len(new) > len(self.values):
            self._forget(max(self.keep, len(wanted)))
            new = wanted
        if len(new):
            rows = np.arange(len(self.words), len(self.words) + len(new))
            self.values[rows] = word_values(new, self.weight_of(new), self.components)
            words, place = np.concatenate([self.words, new]), np.concatenate([self.place, rows])
            order = np.argsort(words)
            self.words, self.place = words[order], place[order]
        return self.place[np.searchsorted(self.words, wanted)]

    def sign(self, values: np.ndarray, offsets: np.ndarray, chunk: int = 500) -> np.ndarray:
        """values, offsets: flattened non-empty sets; one signature row for each set."""
        uniq, inverse = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True)
        rows = self._rows(uniq)[inverse]
        at = offsets - offsets[0]
        out = np.empty((len(at) - 1, self.components))
        for a in range(0, len(out), chunk):
            b = min(a + chunk, len(out))
            out[a:b] = np.minimum.reduceat(self.values[rows[at[a] : at[b]]], at[a:b] - at[a], axis=0)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 key of every band of ``rows`` components."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
        for i in range(rows):
            key = _mix(key + bits[:, :, i])
    return key.view(np.int64)
