"""Embedding near-dedup: inverted lists, product-quantised residuals, exact cosine rerank.

Equal vectors are one representative. Each representative stands in the lists of
its nearest coarse centroids, so the candidates of a list are all pairs in it, and
a pair is counted in the first list that both stand in. The centroids are random
directions, not fitted ones: the chance that a pair shares no list then depends on
its cosine alone, whatever the other vectors are, so a dense group isn't split.
The number of lists of a vector is the least at which that chance is below
``MISS`` at the threshold; closer pairs share a list more often. In a list the
residual to the centroid is coded by product quantisation; a table of the partial
products of a query and the codewords gives the asymmetric estimate q . x'. As
q . x is at most that plus the length of the coding error of x, which is kept, no
candidate that reaches the threshold is dismissed. Those left are compared
exactly, in double precision; where they are many, all products of a tile are
taken at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import written
from geolith.llm.graph import components

COSINE = 0.95
#: Vectors that the codebooks are fitted on, by hash order; every vector is indexed.
SAMPLE = 20_000
#: The accepted chance that a pair at the threshold shares no list, and the pairs it is simulated with.
MISS, TRIALS = 0.001, 20_000
#: Lists are made fewer until so many probes are enough.
MOST = 10
#: Mean rows of a list are LEAST times the probes; a task compares two blocks, in tiles.
LEAST, PARTS, CODES, BLOCK, TILE = 256, 8, 64, 4096, 512
#: From this share of candidates on, a tile is compared by one product of matrices.
DENSE = 1 / 32


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice of rows."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 1024] @ c.T - half, axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.empty(0, np.int64)


def directions(dim: int, k: int, seed: int = 7) -> np.ndarray:
    """``k`` independent directions, uniform on the sphere."""
    c = np.random.default_rng(seed).normal(size=(k, dim))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def nearest_lists(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest directions, nearest first."""
    near = x @ c.T
    some = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def sufficient_probes(dim: int, k: int, cosine: float, seed: int = 11) -> int:
    """The least number of lists per vector at which a pair at ``cosine`` shares none with a chance of at most ``MISS``.

    Simulated with pairs and directions of their own: as directions are uniform,
    the chance is the same for every pair. If it takes more than ``MOST`` of ``k``
    lists, more than ``MOST``.
    """
    most = min(MOST, k)
    if most == 1:
        return 1
    g, c = np.random.default_rng(seed), directions(dim, k, seed + 1)
    shared = np.zeros(most + 1, np.int64)  # pairs by the number of probes at which they first share a list
    for lo in range(0, TRIALS, 1024):
        x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in g.normal(size=(2, min(1024, TRIALS - lo), dim)))
        z -= (x * z).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = nearest_lists(x, c, most), nearest_lists(y, c, most)
        at = np.full(len(a), most)
        for p in range(most):
            for q in range(most):
                at = np.minimum(at, np.where(a[:, p] == b[:, q], max(p, q), most))
        shared += np.bincount(at, minlength=most + 1)
    missed = TRIALS - np.cumsum(shared[:most])
    enough = np.flatnonzero(missed <= MISS * TRIALS)
    return int(enough[0]) + 1 if len(enough) else MOST + 1


def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids of equal length and the codebooks (parts, codes, width) of the residuals."""
    dim = sample.shape[1]
    coarse = directions(dim, lists)
    at = nearest(sample, coarse)
    coarse *= max(0.01, np.einsum("ij,ij->i", sample, coarse[at]).mean())
    rest = sample - coarse[at]
    width = -(-dim // PARTS)
    padded = np.pad(rest, ((0, 0), (0, width * PARTS - dim)))
    books = np.stack([_filled(kmeans(padded[:, p * width : (p + 1) * width], CODES)) for p in range(PARTS)])
    return coarse, books


def _filled(book: np.ndarray) -> np.ndarray:
    return np.pad(book, ((0, CODES - len(book)), (0, 0)), mode="edge")


def pq_code(rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals and the lengths of the coding errors."""
    parts, _, width = books.shape
    padded = np.pad(rest, ((0, 0), (0, width * parts - rest.shape[1])))
    codes = np.stack([nearest(padded[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
    coded = np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
    return codes, np.sqrt(((padded - coded) ** 2).sum(1))


def estimates(queries: np.ndarray, centroid: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Asymmetric estimates of all products of the coded vectors (rows) with ``queries`` (columns), by table lookup in single precision."""
    parts, _, width = books.shape
    padded = np.pad(queries, ((0, 0), (0, width * parts - queries.shape[1])))
    out = np.repeat((queries @ centroid).astype(np.float32)[None, :], len(codes), axis=0)
    for p in range(parts):
        table = np.ascontiguousarray((books[p] @ padded[:, p * width : (p + 1) * width].T).astype(np.float32))
        for lo in range(0, len(codes), 512):
            out[lo : lo + 512] += table[codes[lo : lo + 512, p]]
    return out


#: More than the rounding of an estimate in single precision; so no pair is dismissed for it.
ROUNDING = 1e-4


def _sooner(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Whether the rows of ``a`` and ``b``, sorted list numbers, share a list before ``at``."""
    out = np.zeros((len(a), len(b)), bool)
    for x in a.T:
        for y in b.T:
            if (x < at).any() and (y < at).any():
                out |= np.where(x < at, x, -1)[:, None] == y
    return out


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges with the components of the given links, one less than its nodes for each."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if root(x) != x]


def _stars(on: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges with the components of the links ``on`` between the nodes ``a`` and ``b``, found from many links at once."""
    out, left = [], on.any(axis=1)
    while left.any():
        rows = np.zeros(len(a), bool)
        rows[np.argmax(left)] = True
        while True:
            cols = on[rows].any(axis=0)
            more = on[:, cols].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        nodes = np.concatenate([a[rows], b[cols]])
        low = nodes.min()
        out += [(x, int(low)) for x in nodes[nodes != low].tolist()]
        left &= ~rows
    return out


def link_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id, embedding``): ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine of at least ``cosine`` that are
    found: a pair is missed with a chance of ``MISS`` at most, and none is where all
    vectors fit one list. ``component_id`` is the least vec_id that links lead to.

    Vectors that are null, empty, zero or have null or non-finite components link
    with nothing and are their own component. Vectors of different lengths never
    link. Rows that repeat a vec_id are vectors of their own. An empty table gives
    an empty result. Other columns, labels among them, are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size("_v") > 0) & F.forall("_v", finite) & F.exists("_v", lambda x: x != 0), F.lit(False))
    v = v.withColumns({"_v": F.when(good, F.col("_v")), "_row": F.monotonically_increasing_id()})
    v = written(v, "vectors")
    groups = v.where("_v IS NOT NULL").groupBy("_v").agg(F.min("_row").alias("rep"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    groups = written(groups, "groups")
    sizes = [r[0] for r in groups.select(F.size("_v")).distinct().collect()]  # as a rule one

    found = None
    for dim in sorted(sizes):
        some = _compare(groups.where(F.size("_v") == dim), cosine, sample)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "links")
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = written(found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n")), "counts")

    labelled = groups.join(counts, F.col("rep") == F.col("_a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("_v", "low", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("_root"))
    labelled = written(labelled, "labelled")
    roots = written(labelled.groupBy("_root").agg(F.min("low").alias("component_id")).withColumnRenamed("_root", "_r"), "roots")
    by_vector = labelled.join(roots, F.col("_root") == F.col("_r")).select(F.col("_v").alias("_w"), "n_links", "component_id")
    out = v.join(written(by_vector, "by_vector"), F.col("_v") == F.col("_w"), "left")
    own = F.when(F.col("_w").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _compare(groups: DataFrame, cosine: float, sample: int) -> DataFrame:
    """``a, b, n``: with null ``b``, n links of a; else a and b are in one component."""
    rows = groups.count()
    drawn = groups.orderBy(F.xxhash64("_v"), "rep").limit(sample).select("_v").toArrow().column(0)
    drawn = np.array(drawn.combine_chunks().flatten()).reshape(len(drawn), -1)
    drawn = drawn / np.abs(drawn).max(axis=1, keepdims=True)
    count = max(1, min(rows // LEAST, 4 * isqrt(rows))) if drawn.shape[1] > 1 else 1
    while (probes := sufficient_probes(drawn.shape[1], count, cosine)) > MOST:
        count //= 2
    coarse, books = fit(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), count)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                x = np.stack(part["_v"].to_numpy())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                lists = nearest_lists(x, coarse, probes)
                lists.sort(axis=1)
                for p in range(probes):
                    codes, error = pq_code(x - coarse[lists[:, p]], books)
                    yield pd.DataFrame(
                        {"rep": part["rep"], "copies": part["copies"], "list": lists[:, p].astype(np.int32), "lists": list(lists.astype(np.int32)), "code": [c.tobytes() for c in codes], "error": error, "unit": [r.tobytes() for r in x]}
                    )

    spread = groups.select("rep", "copies", "_v").mapInPandas(assign, "rep long, copies long, list int, lists array<int>, code binary, error double, unit binary")
    spread = written(spread, "lists")
    parts = [1] * len(coarse)
    for r in spread.groupBy("list").count().collect():  # at most as many rows as lists
        parts[r[0]] = -(-r[1] // BLOCK)
    blocks = F.get(F.lit(parts), F.col("list"))
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    laid = spread.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    laid = laid.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at, i, j = (int(k) for k in key)
        unit = np.frombuffer(b"".join(frame["unit"]), np.float64).reshape(len(frame), -1)
        codes = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1)
        error, lists, rep, copies = frame["error"].to_numpy(), np.stack(frame["lists"]), frame["rep"].to_numpy(), frame["copies"].to_numpy()
        one = np.flatnonzero(frame["_own"] == i)
        two = np.flatnonzero(frame["_own"] == j)
        bound, n, edges, dense = cosine - ROUNDING, np.zeros(len(frame)), [], False
        width = books.shape[2]
        padded, products = np.pad(unit, ((0, 0), (0, width * len(books) - unit.shape[1]))), unit @ coarse[at]
        tables = [(padded[:, k * width : (k + 1) * width] @ books[k].T).astype(np.float32) for k in range(len(books))]
        for lo in range(0, len(one), TILE):
            p, q = one[lo : lo + TILE], two[lo if i == j else 0 :]
            upper = np.arange(len(p))[:, None] < np.arange(len(q)) if i == j else True
            if not dense:
                near = (estimates(unit[p], coarse[at], codes[q], books) >= (bound - error[q])[:, None]).T & upper
                x, y = np.nonzero(near)
                if len(x):  # the other way round, for those that are left
                    back = products[q[y]] + sum(tables[k][q[y], codes[p[x], k]] for k in range(len(tables)))
                    near[x, y] = back >= bound - error[p[x]]
                dense = near.mean() > DENSE
            if dense:
                on = (unit[p] @ unit[q].T >= cosine) & upper
                dense = on.mean() > DENSE
                on &= ~_sooner(lists[p], lists[q], at)
                n[p] += on @ copies[q].astype(float)
                n[q] += copies[p].astype(float) @ on
                if on.mean() > DENSE:
                    edges += _stars(on, rep[p], rep[q])
                else:
                    a, b = np.nonzero(on)
                    edges += zip(rep[p][a].tolist(), rep[q][b].tolist())
                continue
            a, b = np.nonzero(near)
            a, b = p[a], q[b]
            # Of the lists that both stand in, the first counts.
            shared = np.full(len(a), len(coarse))
            for k in range(lists.shape[1]):
                shared = np.minimum(shared, np.where((lists[b] == lists[a, k, None]).any(axis=1), lists[a, k], len(coarse)))
            exact = np.einsum("ij,ij->i", unit[a], unit[b])
            on = (shared == at) & (exact >= cosine)
            a, b = a[on], b[on]
            n += np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
            edges += zip(rep[a].tolist(), rep[b].tolist())
        linked = np.flatnonzero(n)
        edges = _forest(edges)
        return pd.DataFrame(
            {"a": [*rep[linked], *(e[0] for e in edges)], "b": pd.array([None] * len(linked) + [e[1] for e in edges], dtype="Int64"), "n": [*n[linked].astype(np.int64), *(0 for _ in edges)]}
        )

    return laid.groupBy("list", "_i", "_j").applyInPandas(compare, "a long, b long, n long")


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
