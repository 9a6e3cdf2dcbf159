"""Geometry functions as DataFrame columns and as SQL names.

A geometry column is binary: a tag byte and the geometry in that dialect. Null
geometries give null. Numbers and SRIDs may be columns, but not null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.geo import codec, columns, text

BOX = T.StructType([T.StructField(n, T.DoubleType(), False) for n in ("xmin", "ymin", "xmax", "ymax")])
MAX = columns.MAX


def _udf(kernel, kind: T.DataType, n: int | None = 1):
    """The kernel as a vectorised function of ``n`` columns, or of any number."""
    if n == 1:
        def f(a: pa.Array) -> pa.Array:
            return kernel(a)
    elif n == 2:
        def f(a: pa.Array, b: pa.Array) -> pa.Array:
            return kernel(a, b)
    elif n == 3:
        def f(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return kernel(a, b, c)
    else:
        def f(*a: pa.Array) -> pa.Array:
            return kernel(*a)
    f.__name__ = kernel.__name__
    return F.arrow_udf(f, kind)


#: SQL name: (kernel, type, number of arguments; none: several).
SCALARS = {
    "ST_GeomFromText": _udf(columns.from_text, T.BinaryType(), None),
    "ST_GeomFromWKB": _udf(columns.from_wkb, T.BinaryType(), None),
    "ST_MakeEnvelope": _udf(columns.make_envelope, T.BinaryType(), None),
    "ST_AsText": _udf(columns.as_text, T.StringType()),
    "ST_AsEWKT": _udf(columns.as_ewkt, T.StringType()),
    "ST_AsGeoJSON": _udf(columns.as_geojson, T.StringType()),
    "ST_GeometryType": _udf(columns.geometry_type, T.StringType()),
    "ST_SRID": _udf(columns.srid, T.IntegerType()),
    "Box2D": _udf(columns.box2d, BOX),
    "ST_Intersects": _udf(columns.intersects, T.BooleanType(), 2),
    "ST_Covers": _udf(columns.covers, T.BooleanType(), 2),
    "ST_CoveredBy": _udf(columns.covered_by, T.BooleanType(), 2),
    "ST_Equals": _udf(columns.equals, T.BooleanType(), 2),
    "ST_Boundary": _udf(columns.boundary, T.BinaryType()),
    "ST_Buffer": _udf(columns.buffer, T.BinaryType(), 3),
    "ST_Split": _udf(columns.split, T.BinaryType(), 2),
    "ST_Translate": _udf(columns.translate, T.BinaryType(), 3),
    "ST_AsMVTGeom": _udf(columns.as_mvt_geom, T.BinaryType(), 2),
}

#: SQL functions that fix the types of numbers; Python functions get them as they come.
_TYPED = {
    "ST_MakeEnvelope": "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, srid BIGINT DEFAULT NULL",
    "ST_Buffer": "g BINARY, width DOUBLE, quadsegs INT",
    "ST_Translate": "g BINARY, dx DOUBLE, dy DOUBLE",
}


def _all(cols) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c) for c in cols]


def _call(name: str, *cols) -> Column:
    return SCALARS[name](*_all(cols))


def geometry(wkt: str, srid: int | None = None) -> Column:
    """A constant geometry, made once on the driver."""
    return F.lit(codec.encode(text.from_wkt(wkt).with_srid(srid)))


def st_geom_from_text(wkt, srid=None) -> Column:
    return _call("ST_GeomFromText", wkt, *([] if srid is None else [srid]))


def st_geom_from_wkb(wkb, srid=None) -> Column:
    return _call("ST_GeomFromWKB", wkb, *([] if srid is None else [srid]))


def st_make_envelope(xmin, ymin, xmax, ymax, srid=None) -> Column:
    corners = [c.cast("double") for c in _all([xmin, ymin, xmax, ymax])]
    return SCALARS["ST_MakeEnvelope"](*corners, *([] if srid is None else _all([srid])))


def st_as_text(g) -> Column:
    return _call("ST_AsText", g)


def st_as_ewkt(g) -> Column:
    return _call("ST_AsEWKT", g)


def st_as_geojson(g) -> Column:
    return _call("ST_AsGeoJSON", g)


def st_geometry_type(g) -> Column:
    return _call("ST_GeometryType", g)


def st_srid(g) -> Column:
    return _call("ST_SRID", g)


def box2d(g) -> Column:
    return _call("Box2D", g)


def st_intersects(a, b) -> Column:
    return _call("ST_Intersects", a, b)


def st_covers(a, b) -> Column:
    return _call("ST_Covers", a, b)


def st_covered_by(a, b) -> Column:
    return _call("ST_CoveredBy", a, b)


def st_equals(a, b) -> Column:
    return _call("ST_Equals", a, b)


def st_boundary(g) -> Column:
    return _call("ST_Boundary", g)


def st_buffer(g, width, quadsegs) -> Column:
    g, width, quadsegs = _all([g, width, quadsegs])
    return SCALARS["ST_Buffer"](g, width.cast("double"), quadsegs.cast("int"))


def st_split(a, b) -> Column:
    return _call("ST_Split", a, b)


def st_translate(g, dx, dy) -> Column:
    g, dx, dy = _all([g, dx, dy])
    return SCALARS["ST_Translate"](g, dx.cast("double"), dy.cast("double"))


def st_as_mvt_geom(g, box) -> Column:
    return _call("ST_AsMVTGeom", g, box)


def st_extent_of(box, null_on_empty: bool = False) -> Column:
    """The box around a column of boxes, by min and max alone: combined map-side, usable over windows, cubes and streams.

    Over nothing it is the sentinel box, or null with ``null_on_empty``.
    """
    (box,) = _all([box])
    ends = {"xmin": (F.min, MAX), "ymin": (F.min, MAX), "xmax": (F.max, -MAX), "ymax": (F.max, -MAX)}
    found = F.struct(*(F.coalesce(f(box[n]), F.lit(none)).alias(n) for n, (f, none) in ends.items()))
    return F.when(F.min(box["xmin"]).isNotNull(), found) if null_on_empty else found


def st_extent(g, null_on_empty: bool = False) -> Column:
    """The box around a column of geometries."""
    return st_extent_of(box2d(g), null_on_empty)


def register_all(spark: SparkSession) -> None:
    """Make all functions SQL names of the session; names don't mind case.

    ``st_extent`` in SQL sees the geometries of a group in one task; for groups
    beyond that use ``st_extent`` above, or min and max of ``Box2D`` in SQL.
    """
    for name, udf in SCALARS.items():
        if name in _TYPED:
            inner = f"_geolith_{name.lower()}"
            spark.udf.register(inner, udf)
            params = _TYPED[name]
            args = [p.split()[0] for p in params.split(", ")]
            kind = "BINARY"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {inner}({', '.join(args)})")
        else:
            spark.udf.register(name, udf)

    def extent(g: pa.Array) -> pa.Scalar:
        return columns.extent(g)

    spark.udf.register("st_extent", F.arrow_udf(extent, BOX))
