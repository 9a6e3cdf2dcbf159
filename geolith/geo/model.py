"""Geometries in two dimensions, and the tag that says how one is stored."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class GeometryError(ValueError):
    """A value that is no geometry, or an operation that a geometry doesn't have."""


class Dialect(IntEnum):
    """The first byte of a stored geometry. Fixed values."""

    WKB = 1
    EWKB = 2
    GEOPACKAGE = 3
    MYSQL = 4
    SPATIALITE = 5

    @classmethod
    def of(cls, tag: int) -> "Dialect":
        try:
            return cls(tag)
        except ValueError:
            raise GeometryError(f"no dialect has the tag {tag}") from None


POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINESTRING: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINESTRING: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}

XY = tuple[float, float]


@dataclass(frozen=True)
class Geometry:
    """``parts`` by kind: a point has none or one (x, y); a line its vertices; a polygon its
    rings; the multiple kinds a list of what their single kind has; a collection geometries."""

    kind: int
    parts: tuple
    srid: int | None = None

    @property
    def empty(self) -> bool:
        return next(self.vertices(), None) is None

    def vertices(self):
        """All vertices, in order."""
        if self.kind in (POINT, LINESTRING):
            yield from self.parts
        elif self.kind == MULTIPOINT:
            yield from (p for part in self.parts for p in part)
        elif self.kind in (POLYGON, MULTILINESTRING):
            yield from (p for part in self.parts for p in part)
        elif self.kind == MULTIPOLYGON:
            yield from (p for polygon in self.parts for ring in polygon for p in ring)
        else:
            for g in self.parts:
                yield from g.vertices()

    def bounds(self) -> tuple[float, float, float, float] | None:
        got = list(self.vertices())
        if not got:
            return None
        xs, ys = zip(*got)
        return min(xs), min(ys), max(xs), max(ys)

    def simple(self):
        """The points, lines and polygons it is made of, as (points, lines, polygons)."""
        if self.kind == COLLECTION:
            found = [g.simple() for g in self.parts]
            return tuple([x for f in found for x in f[i]] for i in range(3))
        points = list(self.parts) if self.kind == POINT else [p for part in self.parts for p in part] if self.kind == MULTIPOINT else []
        lines = [self.parts] if self.kind == LINESTRING else list(self.parts) if self.kind == MULTILINESTRING else []
        polygons = [self.parts] if self.kind == POLYGON else list(self.parts) if self.kind == MULTIPOLYGON else []
        return points, [x for x in lines if x], [x for x in polygons if x and x[0]]

    def map(self, f) -> "Geometry":
        """The geometry with ``f`` applied to all vertices; without SRID."""

        def go(parts, depth):
            return tuple(f(*p) for p in parts) if depth == 0 else tuple(go(p, depth - 1) for p in parts)

        if self.kind == COLLECTION:
            return Geometry(COLLECTION, tuple(g.map(f) for g in self.parts))
        depth = {POINT: 0, LINESTRING: 0, POLYGON: 1, MULTIPOINT: 1, MULTILINESTRING: 1, MULTIPOLYGON: 2}[self.kind]
        return Geometry(self.kind, go(self.parts, depth))

    def with_srid(self, srid: int | None) -> "Geometry":
        return Geometry(self.kind, self.parts, srid)
