"""Filters and joins by place, as plain range predicates before any exact test."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith import functions as G

#: Bytes up to which a side may be broadcast as it is dealt to cells: the larger of Catalyst's estimate and ROW
#: bytes for each of its counted rows, times the most copies that a row can have.
SMALL, ROW = 64 << 20, 256
#: The level of boxes too wide for any grid.
TOP = 2000
#: Bytes of a file for which one more task is worth its start, tasks for each core, and bytes a task of a scan takes.
CRUMB, PER_CORE, SCAN = 4 << 10, 3, 128 << 20


def inside_envelope(box: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether a box lies in the envelope, its border included; false for null boxes."""
    return F.coalesce((box["xmin"] >= xmin) & (box["ymin"] >= ymin) & (box["xmax"] <= xmax) & (box["ymax"] <= ymax), F.lit(False))


def locate_in_envelope(df: DataFrame, geom: str, envelope: tuple[float, float, float, float], box: str | None = None) -> DataFrame:
    """The rows whose geometry has its bounding box in the envelope.

    With ``box``, a stored column of boxes, the filter is native and reaches the scan.
    """
    if box is not None:
        return df.where(inside_envelope(F.col(box), *envelope))
    return df.withColumn("__box", G.box2d(geom)).where(inside_envelope(F.col("__box"), *envelope)).drop("__box")


def _size(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame) -> DataFrame:
    """A stored table with its rows dealt evenly to tasks, some for each core.

    A row group is read by one task, and a file of a few MB can hold a million rows:
    functions of rows that follow would run in that task alone. Tables that fill all
    tasks by themselves stay as they are, and those of a few rows.
    """
    size, tasks = _size(df), PER_CORE * max(8, df.sparkSession.sparkContext.defaultParallelism)
    n = min(size // CRUMB, tasks)
    return df.repartition(n) if n > 1 and size < tasks * SCAN else df


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def _measures(*boxed: tuple[DataFrame, str]) -> list[tuple[float, float, int, list[int]]]:
    """For each table and its column of boxes, in one job: largest coordinate, span, rows and the levels (powers of two of the widths), of which there are some two thousand at most."""
    narrow = [df.select(F.lit(k).alias("side"), F.col(box).alias("b")) for k, (df, box) in enumerate(boxed)]
    b = F.col("b")
    size = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    fits = size < 2.0**1000
    far = F.greatest(*(F.abs(b[n]) for n in ("xmin", "ymin", "xmax", "ymax")))
    span = F.greatest(F.max(F.when(fits, b["xmax"])) - F.min(F.when(fits, b["xmin"])), F.max(F.when(fits, b["ymax"])) - F.min(F.when(fits, b["ymin"])))
    level = F.when(~fits, TOP).when(size > 0, F.ceil(F.log2(size)).cast("int")).otherwise(-TOP)
    found = reduce(DataFrame.unionByName, narrow).groupBy("side").agg(F.max(F.when(fits, far)), span, F.count("*"), F.collect_set(level)).collect()
    of = {r[0]: r for r in found}
    return [(of[k][1] or 0.0, of[k][2] or 0.0, of[k][3], of[k][4]) if k in of else (0.0, 0.0, 0, []) for k in range(len(boxed))]


def spatial_pairs(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate=G.st_intersects, cell: float | None = None) -> DataFrame:
    """Inner join of all pairs for which ``predicate(left, right)`` holds; it has to imply that the boxes meet.

    A grid has cells of every power of two. A box stands in the cells as wide as
    itself, four at most, and in those of each wider level that the other side has;
    a pair is met at the level of its wider box, in the one cell that holds the
    lower corner of what the boxes share. So no box is dealt to many cells, and all
    is a hash join by cell, with the right side broadcast if all copies of its rows
    have at most SMALL bytes. The narrowest cells (``cell``; by default such that spread points stand
    alone) bound how many points share one.
    """
    a = left.withColumn("__a", G.box2d(left_geom)).where("__a IS NOT NULL")
    b = right.withColumn("__b", G.box2d(right_geom)).where("__b IS NOT NULL")
    far, spans, rows, levels = zip(*_measures((a, "__a"), (b, "__b")))
    narrow = cell or max(spans) / max(1.0, max(rows) ** 0.5) or 1.0
    base = max(ceil(log2(narrow)), ceil(log2(max(*far, 1e-300))) - 50, -1000)
    levels = [sorted({max(base, n) for n in some}) for some in levels]

    def side(df: DataFrame, box: str, own: str, others: list[int], level: str, x: str, y: str) -> DataFrame:
        c = F.col(box)
        size = F.greatest(c["xmax"] - c["xmin"], c["ymax"] - c["ymin"])
        df = df.withColumn(own, F.when(~(size < 2.0**1000), TOP).when(size > 0, F.greatest(F.lit(base), F.ceil(F.log2(size)).cast("int"))).otherwise(base))
        wider = F.filter(F.lit(others or [TOP]), lambda n: n > F.col(own))
        df = df.withColumn(level, F.explode(F.concat(F.array(own), wider)))
        for name, low, high in ((x, "xmin", "xmax"), (y, "ymin", "ymax")):
            at = lambda v: _cell(c[v], F.col(level))
            df = df.withColumn(name, F.explode(F.sequence(at(low), at(high))))
        return df

    a, b = side(a, "__a", "__i", levels[1], "__l", "__x", "__y"), side(b, "__b", "__j", levels[0], "__m", "__u", "__v")
    copies = 4 * (1 + len(levels[0]))  # four cells at its own level, and at each one of the other side
    if copies * max(_size(right), ROW * rows[1]) <= SMALL:
        b = F.broadcast(b)
    corner = lambda v: _cell(F.greatest(F.col("__a")[v], F.col("__b")[v]), F.col("__l"))
    own = (corner("xmin") == F.col("__x")) & (corner("ymin") == F.col("__y")) & (F.greatest("__i", "__j") == F.col("__l"))
    same = (F.col("__l") == F.col("__m")) & (F.col("__x") == F.col("__u")) & (F.col("__y") == F.col("__v"))
    met = a.join(b, same & boxes_meet(F.col("__a"), F.col("__b")) & own)
    return met.where(predicate(F.col(left_geom), F.col(right_geom))).drop("__a", "__b", "__i", "__j", "__l", "__m", "__x", "__y", "__u", "__v")


def _cell(v: Column, level: Column) -> Column:
    """The number of the cell of a level that holds a coordinate; the widest level is one cell."""
    return F.when(level >= TOP, F.lit(0).cast("long")).otherwise(F.floor(v / F.pow(F.lit(2.0), level)).cast("long"))


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, how: str = "inner", key: str | None = None, predicate=G.st_intersects, cell: float | None = None) -> DataFrame:
    """Join by a spatial predicate: inner, left, left_semi or left_anti; the last three need ``key``, unique in ``left``.

    Spark takes no Python predicate in the condition of an outer, semi or anti
    join, so these join by the keys of the inner join's pairs.
    """
    if how == "inner":
        return spatial_pairs(left, right, left_geom, right_geom, predicate, cell)
    slim = left.select(F.col(key).alias("__key"), F.col(left_geom).alias("__geom"))
    pairs = spatial_pairs(slim, right, "__geom", right_geom, predicate, cell).drop("__geom")
    if how in ("left_semi", "left_anti"):
        keys = pairs.select("__key").distinct()
        return left.join(keys, left[key] == keys["__key"], how)
    if how == "left":
        return left.join(pairs, left[key] == pairs["__key"], "left").drop("__key")
    raise ValueError(f"no spatial join: {how}")
