"""Tagged bytes to geometries and back, in five dialects.

After the tag byte follow: standard well-known binary; the same with an SRID
flag and number; a GeoPackage header ("GP", version, flags, SRID, optional
envelope) with well-known binary; MySQL's SRID with well-known binary; or a
SpatiaLite blob (start, byte order, SRID, envelope, marker, body, end). Both byte
orders are read, little-endian is written. A third and fourth coordinate are
read over.
"""

from __future__ import annotations

import struct
from math import isnan, nan

from geolith.geo.model import COLLECTION, LINESTRING, MULTILINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Dialect, Geometry, GeometryError

_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000
_SINGLE = {MULTIPOINT: POINT, MULTILINESTRING: LINESTRING, MULTIPOLYGON: POLYGON}


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        try:
            got = struct.unpack_from(form, self.data, self.at)
        except struct.error:
            raise GeometryError("the geometry's bytes end too early") from None
        self.at += struct.calcsize(form)
        return got

    def points(self, order: str, n: int, dims: int) -> tuple:
        if n * dims * 8 > len(self.data) - self.at:
            raise GeometryError("the geometry's bytes end too early")
        flat = self.take(f"{order}{n * dims}d")
        return tuple(zip(flat[0::dims], flat[1::dims]))

    def geometry(self) -> Geometry:
        (mark,) = self.take("B")
        if mark not in (0, 1):
            raise GeometryError(f"no byte order: {mark}")
        order = "><"[mark]
        (code,) = self.take(order + "I")
        srid = self.take(order + "i")[0] if code & _SRID else None
        iso = (code & 0x1FFFFFFF) // 1000
        dims = 2 + (bool(code & _Z) or iso in (1, 3)) + (bool(code & _M) or iso in (2, 3))
        return Geometry(kind := (code & 0x1FFFFFFF) % 1000, self.body(kind, order, dims), srid)

    def body(self, kind: int, order: str, dims: int) -> tuple:
        if kind == POINT:
            p = self.points(order, 1, dims)
            return () if isnan(p[0][0]) and isnan(p[0][1]) else p
        if kind not in range(1, 8):
            raise GeometryError(f"no geometry type: {kind}")
        (n,) = self.take(order + "I")
        if kind == LINESTRING:
            return self.points(order, n, dims)
        if n > len(self.data) - self.at:
            raise GeometryError("the geometry's bytes end too early")
        if kind == POLYGON:
            return tuple(self.points(order, self.take(order + "I")[0], dims) for _ in range(n))
        inner = [self.geometry() for _ in range(n)]
        if kind == COLLECTION:
            return tuple(inner)
        if any(g.kind != _SINGLE[kind] for g in inner):
            raise GeometryError("a part of another type")
        return tuple(g.parts for g in inner)


def read_wkb(data: bytes) -> Geometry:
    return _Reader(bytes(data)).geometry()


def _points(ps) -> bytes:
    return struct.pack(f"<{2 * len(ps)}d", *(c for p in ps for c in p))


def write_wkb(g: Geometry, with_srid: bool = False) -> bytes:
    """Well-known binary; ``with_srid`` puts an SRID that is set into it."""
    head = struct.pack("<BI", 1, g.kind)
    if with_srid and g.srid is not None:
        head = struct.pack("<BIi", 1, g.kind | _SRID, g.srid)
    if g.kind == POINT:
        return head + _points(g.parts or ((nan, nan),))
    if g.kind == LINESTRING:
        return head + struct.pack("<I", len(g.parts)) + _points(g.parts)
    if g.kind == POLYGON:
        return head + struct.pack("<I", len(g.parts)) + b"".join(struct.pack("<I", len(r)) + _points(r) for r in g.parts)
    inner = g.parts if g.kind == COLLECTION else [Geometry(_SINGLE[g.kind], p) for p in g.parts]
    return head + struct.pack("<I", len(g.parts)) + b"".join(write_wkb(p) for p in inner)


def decode(value: bytes | None) -> Geometry | None:
    """The geometry of a tagged value; null stays null."""
    if value is None:
        return None
    value = bytes(value)
    if not value:
        raise GeometryError("a geometry of no bytes")
    dialect, data = Dialect.of(value[0]), value[1:]
    if dialect in (Dialect.WKB, Dialect.EWKB):
        return read_wkb(data)
    if dialect == Dialect.MYSQL:
        r = _Reader(data)
        (srid,) = r.take("<i")
        return r.geometry().with_srid(srid or None)
    if dialect == Dialect.GEOPACKAGE:
        r = _Reader(data)
        magic, _, flags = r.take("2sBB")
        if magic != b"GP" or (flags >> 1 & 7) > 4:
            raise GeometryError("no GeoPackage header")
        (srid,) = r.take("><"[flags & 1] + "i")
        r.at += (0, 32, 48, 48, 64)[flags >> 1 & 7]
        return r.geometry().with_srid(srid if srid > 0 else None)
    return _read_spatialite(data)


def _read_spatialite(data: bytes) -> Geometry:
    r = _Reader(data)
    start, mark = r.take("BB")
    if start != 0 or mark not in (0, 1) or data[-1] != 0xFE:
        raise GeometryError("no SpatiaLite blob")
    order = "><"[mark]
    (srid,) = r.take(order + "i")
    r.take(order + "4d")
    if r.take("B")[0] != 0x7C:
        raise GeometryError("no SpatiaLite blob")

    def body() -> Geometry:
        (kind,) = r.take(order + "I")
        dims = 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3))
        kind %= 1000
        if kind in (POINT, LINESTRING, POLYGON):
            return Geometry(kind, r.body(kind, order, dims))
        if kind not in range(1, 8):
            raise GeometryError(f"no geometry type: {kind}")
        inner = []
        for _ in range(r.take(order + "I")[0]):
            if r.take("B")[0] != 0x69:
                raise GeometryError("no SpatiaLite blob")
            inner.append(body())
        return Geometry(kind, tuple(inner) if kind == COLLECTION else tuple(g.parts for g in inner))

    return body().with_srid(srid or None)


def _write_spatialite(g: Geometry) -> bytes:
    def body(x: Geometry) -> bytes:
        if x.kind in (POINT, LINESTRING, POLYGON):
            return write_wkb(Geometry(x.kind, x.parts))[1:]
        inner = x.parts if x.kind == COLLECTION else [Geometry(_SINGLE[x.kind], p) for p in x.parts]
        return struct.pack("<II", x.kind, len(x.parts)) + b"".join(b"\x69" + body(p) for p in inner)

    box = g.bounds() or (nan,) * 4
    return struct.pack("<BBi4dB", 0, 1, g.srid or 0, *box, 0x7C) + body(g) + b"\xfe"


def encode(g: Geometry | None, dialect: Dialect = Dialect.EWKB) -> bytes | None:
    """A geometry as a tagged value; null stays null."""
    if g is None:
        return None
    tag = bytes([dialect])
    if dialect == Dialect.WKB:
        return tag + write_wkb(g)
    if dialect == Dialect.EWKB:
        return tag + write_wkb(g, True)
    if dialect == Dialect.GEOPACKAGE:
        return tag + struct.pack("<2sBBi", b"GP", 0, 1 | 16 * g.empty, g.srid or 0) + write_wkb(g)
    if dialect == Dialect.MYSQL:
        return tag + struct.pack("<i", g.srid or 0) + write_wkb(g)
    return tag + _write_spatialite(g)


def tag_wkb(payload: bytes | None, dialect: Dialect = Dialect.EWKB) -> bytes | None:
    """A payload in its dialect with the tag before it, once it proves to be a geometry."""
    if payload is None:
        return None
    value = bytes([dialect]) + bytes(payload)
    decode(value)
    return value
