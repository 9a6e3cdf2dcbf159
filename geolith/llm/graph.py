"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import written


def _near(sided: DataFrame) -> DataFrame:
    """Each node with its least neighbour, itself included."""
    return sided.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).select(F.col("a").alias("k"), "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a lesser neighbour has one only, and that has none: then it is the root."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); root is the least node of its component.

    A step moves one row per edge and side, whatever a node's degree: least
    neighbours are combined map-side, and the joins are of the kind that adaptive
    execution can split where a node has very many edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    while not _settled(edges):
        sided = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(_near(sided), "near")
        large = sided.join(near, F.col("a") == F.col("k")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.unionByName(near.where("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "large")
        near = written(_near(large), "near")
        small = large.join(near, F.col("a") == F.col("k")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = written(small.unionByName(near.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
