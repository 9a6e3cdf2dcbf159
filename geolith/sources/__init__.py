"""Geometry columns from Python shapes and from payloads without a tag."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from geolith.geo import codec
from geolith.geo.model import LINESTRING, POINT, POLYGON, Dialect, Geometry, GeometryError

#: A geometry, a payload, or plain coordinates: a point (x, y), a line [(x, y), ...], an area [[(x, y), ...], ...] of rings.
Shape = Geometry | bytes | Sequence | None


def shape(value: Sequence) -> Geometry:
    """The geometry of plain coordinates: what they stand for is seen by how deep they are nested."""
    depth, inner = 0, value
    while isinstance(inner, Sequence) and not isinstance(inner, str) and len(inner):
        depth, inner = depth + 1, inner[0]
    point = lambda p: (float(p[0]), float(p[1]))
    if depth == 1 and len(value) == 2:
        return Geometry(POINT, (point(value),))
    if depth == 2 and all(len(p) == 2 for p in value):
        return Geometry(LINESTRING, tuple(map(point, value)))
    if depth == 3 and all(len(p) == 2 for ring in value for p in ring):
        return Geometry(POLYGON, tuple(tuple(map(point, ring)) for ring in value))
    raise GeometryError("coordinates of no point, line or area")


def encode(shapes: Iterable[Shape], dialect: Dialect = Dialect.EWKB) -> list[bytes | None]:
    """Tagged values: geometries and coordinates are encoded, payloads are checked and tagged, None stays null."""
    out = []
    for s in shapes:
        if isinstance(s, (bytes, bytearray)):
            out.append(codec.tag_wkb(s, dialect))
        else:
            out.append(codec.encode(s if s is None or isinstance(s, Geometry) else shape(s), dialect))
    return out


def decode(values: Iterable[bytes | None]) -> list[Geometry | None]:
    return [codec.decode(v) for v in values]


def from_shapes(spark: SparkSession, shapes: Sequence[Shape], dialect: Dialect = Dialect.EWKB, name: str = "geom") -> DataFrame:
    """A table of one geometry column."""
    return spark.createDataFrame([(v,) for v in encode(shapes, dialect)], f"{name} binary")
