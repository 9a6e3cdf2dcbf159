"""Extents over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith import functions as G


def windowed_extent(df: DataFrame, geom: str, time: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``window, n, extent``: for streams and tables alike, by min and max with a watermark."""
    boxed = df.withWatermark(time, late).withColumn("__box", G.box2d(geom))
    return boxed.groupBy(F.window(time, window, slide) if slide else F.window(time, window)).agg(F.count("*").alias("n"), G.st_extent_of("__box").alias("extent"))
