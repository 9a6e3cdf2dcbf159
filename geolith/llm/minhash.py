"""DartMinHash (Christiani 2020): weighted minwise signatures from hashed darts.

For every element there is a fixed random set of darts in the plane of weight and
rank, one per unit of area on average, which any document can regenerate from
the element's hash. A document with total weight W reads, of each of its
elements, the darts below that element's weight and below the rank t / W: about
t darts in all, whatever the number of elements. Each dart belongs to one of k
coordinates, and each coordinate keeps its dart of least rank. Where one is
left empty the rank limit is doubled. Two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

from math import exp, factorial, log

import numpy as np

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Rank cells of less than a unit: all darts of most long documents lie here.
_EDGES = np.array([0, *(2.0**-i for i in range(6, -1, -1))])
#: Elements that throw their darts together.
TOGETHER = 1 << 17
_MOST = 18  # a cell of area 1 holds more darts with probability 1e-16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(area: float) -> np.ndarray:
    return np.cumsum([exp(-area) * area**n / factorial(n) for n in range(_MOST)])


def signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, docs: int, k: int, seed: int = 1) -> np.ndarray:
    """k coordinates (unsigned 64 bits) for each of ``docs`` documents.

    ``elements`` (unsigned 64 bits) are distinct within a document, ``owner`` is
    the document of each, in rising order. A document without elements has zeros.
    """
    out = np.zeros((docs, k), np.uint64)
    cell = np.zeros(len(elements), np.uint64)
    share = np.ones(len(elements))
    if weights is not None:  # one cell of weight for each unit begun
        n = np.ceil(weights).astype(np.int64)
        cell = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        share = np.minimum(1, np.repeat(weights, n) - cell)
        elements, owner = np.repeat(elements, n), np.repeat(owner, n)
    base = mix(elements + mix(cell + np.uint64(seed) * _STEP))
    total = np.bincount(owner, share, docs)
    t = k * log(k) + 2 * k
    limit = np.divide(t, total, out=np.zeros(docs), where=total > 0)
    todo, best = total > 0, np.full(docs * k, np.inf)
    while todo.any():
        on = np.flatnonzero(todo[owner])
        for lo in range(0, len(on), TOGETHER):
            some = on[lo : lo + TOGETHER]
            _throw(base[some], share[some], owner[some], limit, k, out, best)
        todo &= (out == 0).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out


def _throw(base: np.ndarray, share: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int, out: np.ndarray, best: np.ndarray) -> None:
    """Darts below a document's limit into ``out``, where their rank is less than ``best``."""
    most = limit[owner]
    found = []
    for c in range(len(_EDGES) - 1):
        lo, hi = _EDGES[c], _EDGES[c + 1]
        on = np.flatnonzero(most > lo)
        found.append(_darts(base, on, np.full(len(on), c), lo, hi - lo, _poisson(hi - lo)))
    n = np.ceil(np.maximum(most - 1, 0)).astype(np.int64)
    on = np.repeat(np.arange(len(base)), n)
    unit = np.arange(len(on)) - np.repeat(np.cumsum(n) - n, n)
    found.append(_darts(base, on, unit + len(_EDGES), 1.0 + unit, 1.0, _poisson(1.0)))
    dart, rank, at = (np.concatenate(x) for x in zip(*found))
    inside = (rank < most[at]) & (_unit(mix(dart ^ _M2)) < share[at])
    dart, rank, at = dart[inside], rank[inside], owner[at[inside]]
    slot = at * k + (mix(dart ^ _M1) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-rank, kind="stable")
    order = order[rank[order] < best[slot[order]]]
    best[slot[order]] = rank[order]
    out.reshape(-1)[slot[order]] = dart[order] | np.uint64(1)  # of several, the last stays: the least rank


def _darts(base: np.ndarray, on: np.ndarray, cells: np.ndarray, lo, width: float, cdf: np.ndarray) -> tuple:
    h = mix(base[on] + mix(cells.astype(np.uint64) * _STEP + np.uint64(77)))
    n = np.searchsorted(cdf, _unit(h), side="right")
    some = np.flatnonzero(n)
    n = n[some]
    each = np.repeat(some, n)
    nth = (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    dart = mix(h[each] + (nth + np.uint64(1)) * _STEP)
    low = lo[each] if isinstance(lo, np.ndarray) else lo
    return dart, low + width * _unit(mix(dart + _STEP)), on[each]


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of ``rows`` coordinates, signed 64 bits."""
    n = sig.shape[1] // rows
    h = np.broadcast_to(mix(np.arange(1, n + 1).astype(np.uint64) * _STEP), (len(sig), n)).copy()
    for r in range(rows):
        h = mix(h * _M1 + sig[:, r : n * rows : rows])
    return h.view(np.int64)


def planes(sig: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of the coordinates as bit planes: for each 64 coordinates one word (signed 64 bits) per bit."""
    n, k = sig.shape
    low = mix(sig)
    out = np.zeros((n, -(-k // 64) * bits), np.uint64)
    for c in range(k):
        for b in range(bits):
            out[:, c // 64 * bits + b] |= (low[:, c] >> np.uint64(b) & np.uint64(1)) << np.uint64(c % 64)
    return out.view(np.int64)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _M1)]), dtype=np.uint64)


#: Stands for a byte in a word's hash; the inverse of _M1 modulo 2**64.
_BYTES, _INVERSE = mix(np.arange(1, 257).astype(np.uint64) * _STEP), np.uint64(pow(int(_M1), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, owner_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand in a row as bytes, and how many each has; a word is a run of bytes without ASCII blanks.

    A word's hash is the sum of its bytes' random values times rising powers,
    taken as a difference of running sums.
    """
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[owner_ends] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    stop = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        up = _powers(len(data))[: len(data)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inside, _BYTES[data] * up, np.uint64(0)), dtype=np.uint64)])
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE)]), dtype=np.uint64)
        found = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], owner_ends])))
    return found, counts


class Shingler:
    """Hashes of runs of words."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.by_place = mix(np.arange(1, size + 1).astype(np.uint64) * _STEP) | np.uint64(1)

    def words(self, texts) -> list[np.ndarray]:
        """The hashes of the words of each text of an Arrow array of strings without nulls."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        found, counts = word_hashes(data, offsets[1:] - offsets[0])
        return np.split(found, np.cumsum(counts)[:-1]) if len(counts) else []

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Of every run of ``size`` words; fewer words are one shingle, none are none. With repetitions."""
        if not len(words):
            return words
        n = max(1, len(words) - self.size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(words))):
            h += words[k : k + n] * self.by_place[k]
        return mix(h + np.uint64(min(self.size, len(words))))
