"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

What decides a packing is how many pieces there are of each length, a table of
at most ``capacity`` counts whatever the corpus. The plan is made on it: from the
longest length down, the gap that a piece leaves is looked up in an index of the
single lengths and of the sums of two and of three, and the fillings that are still
there are used up as often as the counts allow. What has no exact filling is
packed best-fit. Every step uses a pattern as often as it can, so a plan has a
few thousand patterns at most, and the pieces find their places in it by their
rank within their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.bpe import encoder
from geolith.llm.common import TEXTS, let_go, numbered, small_batches, written
from geolith.llm.tokens import END, vocabulary_path

CAPACITY = 1024


class Sums:
    """Index of the sums of two and three of the lengths that occur; of one, ``have`` itself is the index.

    ``pairs[s]`` lists the pairs with sum s, the greater length first and falling;
    ``firsts[s]`` lists the greatest lengths of the triples with sum s, each of
    which goes with the pairs of what it leaves.
    """

    def __init__(self, have: np.ndarray) -> None:
        capacity = len(have) - 1
        lengths = np.flatnonzero(have)[::-1]
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        on = (a >= b) & (a + b <= capacity)
        a, b = a[on], b[on]
        order = np.argsort(a + b, kind="stable")
        ends = np.cumsum(np.bincount(a + b, minlength=capacity + 1))
        self.pairs = [p.tolist() for p in np.split(np.stack([a, b], axis=1)[order], ends[:-1])]
        least = np.array([min((p[0] for p in some), default=capacity + 1) for some in self.pairs])
        self.firsts = [[x for x in lengths.tolist() if x < s and least[s - x] <= x] for s in range(capacity + 1)]

    def fillings(self, gap: int, have: np.ndarray, most: int) -> Iterator[tuple[int, ...]]:
        """What fills a gap exactly: one length, then pairs, then triples (up to ``most`` lengths), as long as they are there."""
        if have[gap]:
            yield (gap,)
        for x, y in self.pairs[gap] if most > 1 else ():
            if have[x] and have[y]:
                yield x, y
        for x in self.firsts[gap] if most > 2 else ():
            if have[x]:
                for y, z in self.pairs[gap - x]:
                    if y <= x and have[x] and have[y] and have[z]:
                        yield x, y, z


def plan_packing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many such sequences), from the counts by length.

    ``counts[n]`` is the number of pieces of length n, 0 < n <= capacity. Pieces of
    more than half a sequence go first, as each needs one of its own: exact
    fillings, then the best fit of what is left. Then the others do. As pairs and
    triples for the first may use up what would have filled others' gaps, plans
    are made with up to one, two and three lengths for them, and the shortest is taken.
    """
    index = Sums(np.array(counts, np.int64))
    return min((_plan(index, counts, capacity, most) for most in (3, 2, 1)), key=lambda plan: sum(times for _, times in plan))


def _plan(index: Sums, counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.array(counts, np.int64)
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> None:
        """Take the pattern as often as the counts allow."""
        need = Counter(parts)
        times = min(int(have[n]) // k for n, k in need.items())
        if times > 0:
            for n, k in need.items():
                have[n] -= times * k
            plan.append((parts, times))

    half = capacity // 2

    def exactly(n: int) -> int:
        """Use up pieces of length ``n`` with exact fillings; how many are left."""
        if have[n] and n == capacity:
            use((n,))
        elif have[n]:
            for rest in index.fillings(capacity - n, have, most if n > half else 3):
                use((n, *rest))
                if not have[n]:
                    break
        return int(have[n])

    for n in [n for n in range(capacity, half, -1) if exactly(n)]:
        while have[n]:
            parts, gap, free = [n], capacity - n, have[: half + 1].copy()
            while gap and len(some := np.flatnonzero(free[: gap + 1])):
                parts.append(int(some[-1]))
                free[some[-1]] -= 1
                gap -= parts[-1]
            use(tuple(parts))
    rest = []
    for n in range(half, 0, -1):
        if left := exactly(n):
            rest.append((n, left))
            have[n] = 0
    _best_fit(rest, capacity, plan)
    return plan


def _best_fit(rest: list[tuple[int, int]], capacity: int, plan: list) -> None:
    """Pieces of falling length into the fullest open sequence that takes them; equal sequences are handled together."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n, left in rest:
        while left:
            gap = next((g for g in range(n, capacity + 1) if open_by_gap.get(g)), None)
            if gap is None:
                parts, times, each = (), left, capacity // n
                full, odd = divmod(left, each)
                if full:
                    open_by_gap.setdefault(capacity - n * each, []).append(((n,) * each, full))
                if odd:
                    open_by_gap.setdefault(capacity - n * odd, []).append(((n,) * odd, 1))
                left = 0
                continue
            parts, times = open_by_gap[gap].pop()
            each = min(gap // n, max(1, left // times))
            used = min(times, left // each)
            if times > used:
                open_by_gap[gap].append((parts, times - used))
            open_by_gap.setdefault(gap - n * each, []).append((parts + (n,) * each, used))
            left -= used * each
    plan.extend(x for g in sorted(open_by_gap) for x in open_by_gap[g])


def places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the ranks at which its uses begin, with the sequence and offset that they stand for."""
    used, out, first = np.zeros(capacity + 1, np.int64), {}, 0
    for parts, times in plan:
        offset = 0
        for n in parts:
            out.setdefault(n, []).append((used[n], first, offset))
            used[n] += times
            offset += n
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in out.items()}


def pieces_of(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Document, number, start and length of the pieces of documents with so many ids: only a first piece may be shorter than the capacity."""
    pieces = -(-counts // capacity)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = (counts - 1) % capacity + 1
    start = np.where(number > 0, head[owner] + (number - 1) * capacity, 0)
    length = np.where(number > 0, capacity, head[owner])
    return owner, number.astype(np.int32), start, length


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if wanted, ``ids``.

    ``ids`` is binary, little-endian unsigned, of two bytes an id where the
    vocabulary has at most 65,536 ids, else four; ``ids_crc32`` is of the ids as
    unsigned 32-bit integers, whatever their width. Only narrow rows are sorted for
    the places; the ids stay in the table that the texts were encoded to, and join
    the places at the end.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are
    documents of their own, also those with a null doc_id. An empty table gives
    an empty result. Columns besides doc_id and text are not read.
    """
    path = vocabulary or vocabulary_path()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            for lo, hi, flat, counts in tok.batches(batch.column("text"), end):
                owner, piece, start, length = pieces_of(counts, capacity)
                at = np.concatenate([[0], np.cumsum(length)])
                data, wide = flat.tobytes(), flat.astype("<u4").tobytes()
                w = flat.dtype.itemsize
                crc = [crc32(wide[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                owner = pa.array(lo + owner)
                columns = [batch.column("uid").take(owner), batch.column("doc_id").take(owner), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([data[w * a : w * b] for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        let_go()

    shape = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    names = [f.split()[0] for f in shape.split(", ")]
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, TEXTS):
        encoded = written(texts.mapInArrow(tokenise, shape), "encoded")  # the range sort samples its input
    narrow = [n for n in names if n != "ids"]
    table, offsets = numbered(encoded.select(*narrow), ["length", "doc_id", "piece", "uid"], "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in table.groupBy("length").count().collect():  # at most `capacity` rows
        counts[n] = k
    where = places(plan_packing(counts, capacity), capacity)
    below = np.concatenate([[0], np.cumsum(counts)])  # below[n]: pieces shorter than n
    first = np.array(offsets, np.int64)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, idx, n = (batch.column(c).to_numpy() for c in ("_pid", "_idx", "length"))
            rank = first[pid] + idx - below[n]
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                on = n == length
                begin, seq, off = where[int(length)]
                at = np.searchsorted(begin, rank[on], side="right") - 1
                sequence[on], offset[on] = seq[at] + rank[on] - begin[at], off[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in narrow), pa.array(sequence), pa.array(offset)], names=[*narrow, "sequence_id", "offset"])

    placed = table.mapInArrow(put, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not ids:
        return placed.select(*out)
    content = encoded.select(F.col("uid").alias("_u"), F.col("piece").alias("_p"), "ids")
    return placed.join(content, (F.col("uid") == F.col("_u")) & (F.col("piece") == F.col("_p"))).select(*out, "ids")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
