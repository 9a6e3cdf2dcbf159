"""Values of all functions, through SQL."""

from __future__ import annotations

import numpy as np
import pytest

from geolith import functions as G
from geolith.geo import codec, text
from geolith.geo.model import Dialect, Geometry, GeometryError
from geolith.sources import encode, from_shapes

WKB = "0101000000cb49287d21c451c0f0bf95ecd8244540"
P = "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))"
SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"

GOLDEN = [
    ("ST_AsText(ST_GeomFromText('POINT(-71.064544 42.28787)'))", "POINT(-71.064544 42.28787)"),
    ("ST_AsEWKT(ST_GeomFromText('POINT(-71.064544 42.28787)', 4269))", "SRID=4269;POINT(-71.064544 42.28787)"),
    (f"ST_AsText(ST_GeomFromWKB(X'{WKB}'))", "POINT(-71.064544 42.28787)"),
    (f"st_asewkt(st_geomfromwkb(X'{WKB}', 4269))", "SRID=4269;POINT(-71.064544 42.28787)"),
    ("ST_AsGeoJSON(ST_GeomFromText('POINT(-71.064544 42.28787)'))", '{"type": "Point", "coordinates": [-71.064544,42.28787]}'),
    ("ST_AsEWKT(ST_MakeEnvelope(10, 10, 11, 11))", "POLYGON((10 10,10 11,11 11,11 10,10 10))"),
    ("ST_AsEWKT(ST_MakeEnvelope(10, 10, 11, 11, 4236))", "SRID=4236;POLYGON((10 10,10 11,11 11,11 10,10 10))"),
    ("ST_GeometryType(ST_GeomFromText('POINT(1 1)'))", "ST_Point"),
    ("ST_SRID(ST_GeomFromText('POINT(1 1)', 4269))", 4269),
    ("ST_SRID(ST_GeomFromText('POINT(1 1)'))", None),
    ("Box2D(ST_GeomFromText('LINESTRING(1 2, 3 4, 5 6)'))", (1.0, 2.0, 5.0, 6.0)),
    ("ST_Intersects(ST_GeomFromText('POINT(1 1)'), ST_GeomFromText('LINESTRING ( 1 1, 0 2 )'))", True),
    ("ST_Covers(ST_GeomFromText('LINESTRING ( 1 1, 0 2 )'), ST_GeomFromText('POINT(1 1)'))", True),
    ("ST_CoveredBy(ST_GeomFromText('POINT(1 1)'), ST_GeomFromText('LINESTRING ( 1 1, 0 2 )'))", True),
    ("ST_Equals(ST_GeomFromText('LINESTRING(0 0, 10 10)'), ST_GeomFromText('LINESTRING(0 0, 5 5, 10 10)'))", True),
    ("ST_AsText(ST_Boundary(ST_GeomFromText('POLYGON((1 1,0 0, -1 1, 1 1))')))", "LINESTRING(1 1,0 0,-1 1,1 1)"),
    (
        "ST_AsText(ST_Buffer(ST_GeomFromText('POINT(100 90)'), 50.0, 2::Integer))",
        "POLYGON((150 90,135.35533905932738 54.64466094067263,100 40,64.64466094067262 54.64466094067262,50 90,64.64466094067262 125.35533905932738,99.99999999999999 140,135.35533905932738 125.35533905932738,150 90))",
    ),
    ("ST_AsText(ST_Split(ST_GeomFromText('LINESTRING ( 0 0, 1 1, 2 2 )'), ST_GeomFromText('POINT(1 1)')))", "GEOMETRYCOLLECTION EMPTY"),
    ("ST_AsText(ST_Translate(ST_GeomFromText('POINT(-71.064544 42.28787)'), 1.0, 2.0))", "POINT(-70.064544 44.28787)"),
    ("ST_AsText(ST_AsMVTGeom(ST_GeomFromText('POLYGON ((0 0, 10 0, 10 5, 0 -5, 0 0))'), Box2D(ST_GeomFromText('LINESTRING(0 0, 4096 4096)'))))", "POLYGON((0 4096,10 4096,10 4091,0 4101,0 4096))"),
    (f"ST_Covers(ST_GeomFromText('{P}'), ST_GeomFromText('POINT(3 3)'))", False),
    (f"ST_Intersects(ST_GeomFromText('{P}'), ST_GeomFromText('POINT(3 3)'))", False),
    (f"ST_Covers(ST_GeomFromText('{SQUARE}'), ST_GeomFromText('POINT(0 2)'))", True),
    (f"ST_Equals(ST_GeomFromText('{SQUARE}'), ST_GeomFromText('POLYGON((0 0,0 4,4 4,4 0,0 0))'))", True),
    (f"ST_Covers(ST_GeomFromText('{P}'), ST_GeomFromText('POLYGON((1 1,5 1,5 5,1 5,1 1))'))", False),
    (f"ST_Covers(ST_GeomFromText('{P}'), ST_GeomFromText('POLYGON((5 1,9 1,9 9,5 9,5 1))'))", True),
    ("ST_Covers(ST_GeomFromText('MULTIPOLYGON(((0 0,2 0,2 4,0 4,0 0)),((2 0,4 0,4 4,2 4,2 0)))'), ST_GeomFromText('POLYGON((1 1,3 1,3 3,1 3,1 1))'))", True),
    ("ST_Intersects(ST_GeomFromText('POINT EMPTY'), ST_GeomFromText('POINT(1 1)'))", False),
    ("ST_Intersects(CAST(NULL AS BINARY), ST_GeomFromText('POINT(1 1)'))", None),
    ("ST_AsText(ST_Boundary(ST_GeomFromText('LINESTRING(0 0,1 1,2 0)')))", "MULTIPOINT(0 0,2 0)"),
    ("ST_AsText(ST_Boundary(ST_GeomFromText('LINESTRING(0 0,1 1,2 0,0 0)')))", "MULTIPOINT EMPTY"),
    ("ST_AsText(ST_Boundary(ST_GeomFromText('MULTIPOINT(0 0,1 1)')))", "GEOMETRYCOLLECTION EMPTY"),
    ("ST_AsText(ST_Boundary(ST_GeomFromText('MULTILINESTRING((0 0,1 1),(1 1,2 2))')))", "MULTIPOINT(0 0,2 2)"),
    ("ST_AsText(ST_Buffer(ST_GeomFromText('POINT(0 0)'), -1, 1))", "POLYGON EMPTY"),
    (f"ST_GeometryType(ST_Split(ST_GeomFromText('{P}'), ST_GeomFromText('LINESTRING(5 -1,5 11)')))", "ST_GeometryCollection"),
]


@pytest.fixture(scope="module")
def sql(spark):
    G.register_all(spark)
    return lambda q: spark.sql(q).collect()


def test_golden(sql):
    row = sql("SELECT " + ", ".join(f"{q} AS c{k}" for k, (q, _) in enumerate(GOLDEN)))[0]
    for k, (q, want) in enumerate(GOLDEN):
        got = row[k]
        assert (tuple(got) if isinstance(want, tuple) else got) == want, q


def lines(n):
    return [Geometry(2, tuple((float(i + d), float(i + 1 + d)) for d in (0, 2, 4))) for i in range(n)]


def test_table(spark, sql):
    table = from_shapes(spark, lines(3)).union(from_shapes(spark, lines(3)))
    table.createOrReplaceTempView("geom_table")
    assert [r[0] for r in sql("SELECT ST_Intersects(geom, ST_GeomFromText('POINT(0 1)')) FROM geom_table")] == [True, False, False] * 2


def test_extent(spark, sql):
    shapes = encode(lines(4))
    frame = spark.createDataFrame([(g, n) for g, n in zip(shapes, "aabb")] + [(None, "c")], "geom binary, name string")
    frame.createOrReplaceTempView("named")
    top = float(G.MAX)
    want = {"a": (0, 1, 5, 6), "b": (2, 3, 7, 8), "c": (top, top, -top, -top)}
    assert {r.name: tuple(r.e) for r in sql("SELECT name, ST_Extent(geom) AS e FROM named GROUP BY name")} == want
    got = frame.groupBy("name").agg(G.st_extent("geom").alias("e"), G.st_extent("geom", null_on_empty=True).alias("n")).collect()
    assert {r.name: tuple(r.e) for r in got} == want
    assert [r.n for r in got if r.name == "c"] == [None]


def test_buffers_and_splits():
    from geolith.geo.build import buffer, split

    def same(g, wkt):
        return {frozenset(r) for r in g.parts} == {frozenset(r) for r in text.from_wkt(wkt).parts}

    assert same(buffer(text.from_wkt("LINESTRING(0 0,10 0)"), 1, 1), "POLYGON((10 1,11 0,10 -1,0 -1,-1 0,0 1,10 1))")
    assert same(buffer(text.from_wkt(SQUARE), 1, 1), "POLYGON((-1 0,-1 4,0 5,4 5,5 4,5 0,4 -1,0 -1,-1 0))")
    assert same(buffer(text.from_wkt(SQUARE), -1, 8), "POLYGON((1 1,1 3,3 3,3 1,1 1))")
    assert buffer(text.from_wkt(SQUARE), -3, 8).empty
    assert len(split(text.from_wkt(SQUARE), text.from_wkt("LINESTRING(2 -1,2 11)")).parts) == 2
    pieces = split(text.from_wkt(P), text.from_wkt("LINESTRING(5 -1,5 11)"))
    assert sorted(len(g.parts) for g in pieces.parts) == [1, 1, 2]
    ring = buffer(text.from_wkt("LINESTRING(0 0,10 0,10 10,0 10,0 0)"), 1, 4)
    assert len(ring.parts) == 2


def test_dialects_round_trip():
    texts = ["POINT(0 1)", "POINT EMPTY", "LINESTRING(0 1,1 2)", P, "MULTIPOINT(0 1,1 2)", "MULTILINESTRING((0 1,1 2),(3 4,5 6))", f"MULTIPOLYGON({P[7:]},((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))"]
    for wkt in texts:
        g = text.from_wkt(wkt)
        for dialect in Dialect:
            assert codec.decode(codec.encode(g, dialect)) == g
            if dialect != Dialect.WKB:
                assert codec.decode(codec.encode(g.with_srid(4326), dialect)) == g.with_srid(4326)
        assert text.to_wkt(g) == wkt
    big = bytes([2]) + bytes.fromhex("0000000001") + __import__("struct").pack(">2d", 1, 2)
    assert text.to_wkt(codec.decode(big)) == "POINT(1 2)"
    for bad in (b"", b"\x09abc", bytes.fromhex(f"02{WKB}")[:-3], b"\x02\x05"):
        with pytest.raises(GeometryError):
            codec.decode(bad)
    for bad in ("POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "POLYGON((0 0,1 1,2 2,3 3))", "POINT(1 2) x"):
        with pytest.raises(GeometryError):
            text.from_wkt(bad)


def test_numbers():
    assert [text.number(x) for x in (10.0, 1e7, 1e-5, 1e22, -0.1, 99.99999999999999)] == ["10", "10000000", "0.00001", "10000000000000000000000", "-0.1", "99.99999999999999"]


def test_relations_against_jts(spark):
    """Random geometries on a small grid, which touch often."""
    import random

    from geolith.geo import relate

    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    r = random.Random(5)
    pt = lambda: f"{r.randint(0, 4)} {r.randint(0, 4)}"

    def shape():
        kind = r.randint(0, 3)
        if kind == 0:
            return f"POINT({pt()})"
        if kind == 1:
            return f"LINESTRING({pt()},{pt()},{pt()})"
        x, y, w, h = r.randint(0, 3), r.randint(0, 3), r.randint(1, 4), r.randint(1, 4)
        if kind == 2:
            return f"POLYGON(({x} {y},{x + w} {y},{x} {y + h},{x} {y}))"
        return f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"

    for _ in range(250):
        s, t = shape(), shape()
        a, b, ja, jb = text.from_wkt(s), text.from_wkt(t), reader.read(s), reader.read(t)
        assert relate.intersects(a, b) == ja.intersects(jb), (s, t)
        assert relate.covers(a, b) == ja.covers(jb), (s, t)
        assert relate.equals(a, b) == ja.equalsTopo(jb), (s, t)


def test_joins(spark):
    from geolith.operators import locate_in_envelope, spatial_join

    shapes = [text.from_wkt("LINESTRING(0 0,1 1)"), None, text.from_wkt("LINESTRING(0 0,-1 -1)")]
    table = from_shapes(spark, shapes)
    counts = [locate_in_envelope(table, "geom", e).count() for e in ((0, 0, 0.5, 0.5), (0, 0, 1, 1), (-1, -1, 1, 1), (-2, -2, 2, 2))]
    assert counts == [0, 1, 2, 2]
    a = spark.createDataFrame([(k, v) for k, v in enumerate(encode([text.from_wkt(f"POINT({k % 10} {k // 10})") for k in range(60)]))], "id long, p binary")
    b = spark.createDataFrame([(k, v) for k, v in enumerate(encode([text.from_wkt(f"POLYGON(({k} {k},{k + 3} {k},{k + 3} {k + 3},{k} {k + 3},{k} {k}))") for k in range(5)]))], "k long, q binary")
    want = {(i, k) for i in range(60) for k in range(5) if k <= i % 10 <= k + 3 and k <= i // 10 <= k + 3}
    for cell in (None, 2.0):
        assert {(r.id, r.k) for r in spatial_join(a, b, "p", "q", cell=cell).collect()} == want
        assert spatial_join(a, b, "p", "q", cell=cell).count() == len(want)
        assert {r.id for r in spatial_join(a, b, "p", "q", "left_anti", "id", cell=cell).collect()} == set(range(60)) - {i for i, _ in want}
        assert {r.id for r in spatial_join(a, b, "p", "q", "left_semi", "id", cell=cell).collect()} == {i for i, _ in want}
        assert spatial_join(a, b, "p", "q", "left", "id", cell=cell).count() == len(want) + 60 - len({i for i, _ in want})


def test_kernels_for_rows_alike_equal_those_for_one(spark):
    """Rows of one layout are handled at once; with others between them the results are those of single rows."""
    import pyarrow as pa

    from geolith.geo import build, codec, columns
    from geolith.geo.model import Dialect, Geometry
    from geolith.geo.text import from_wkt

    texts = ["POINT(1 2)", "POINT(-3 4.5)", "POINT EMPTY", "LINESTRING(0 0,1 1,2 5)", "LINESTRING EMPTY", "POLYGON((0 0,0 1,1 1,0 0))", "POLYGON((0 0,0 9,9 9,9 0,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT(1 2,3 4)", "GEOMETRYCOLLECTION(POINT(1 2))"]
    shapes = [from_wkt(t).with_srid(s) for t in texts for s in (None, 4326, -7)]
    for dialect in Dialect:
        values = [codec.encode(g, dialect) for g in shapes] + [None]
        array, read = pa.array(values, pa.binary()), [codec.decode(v) for v in values[:-1]]
        assert columns.geometry_type(array).to_pylist()[:-1] == [columns.geometry_type(array.slice(k, 1)).to_pylist()[0] for k in range(len(read))]
        assert columns.srid(array).to_pylist() == [g.srid for g in read] + [None]
        by = pa.array(np.arange(len(values), dtype=float))
        assert columns.translate(array, by, by).to_pylist() == [codec.encode(build.translate(g, k, k)) for k, g in enumerate(read)] + [None]
        box = {"xmin": 1.0, "ymin": 2.0, "xmax": 4097.0, "ymax": 4098.0}
        tiles = columns.as_mvt_geom(array, pa.array([box] * len(read) + [box], columns.BOX)).to_pylist()
        assert tiles == [codec.encode(build.to_tile(g, tuple(box.values()))) for g in read] + [None]
    payloads = [codec.write_wkb(g, True) for g in shapes]
    for given in (None, 9):
        got = columns.from_wkb(pa.array(payloads, pa.binary()), *([] if given is None else [pa.array([given] * len(payloads))])).to_pylist()
        assert got == [codec.encode(g if given is None else g.with_srid(given)) for g in shapes]
    got = columns.make_envelope(*(pa.array([v, v + 1], pa.float64()) for v in (0, 1, 5, 6)), pa.array([None, 3])).to_pylist()
    rings = [((x, x + 1), (x, x + 6), (x + 5, x + 6), (x + 5, x + 1), (x, x + 1)) for x in (0.0, 1.0)]
    assert got == [codec.encode(Geometry(3, (rings[0],)), Dialect.WKB), codec.encode(Geometry(3, (rings[1],), 3))]


def test_plain_coordinates():
    from geolith.geo.text import to_wkt
    from geolith.sources import decode, encode

    got = decode(encode([(1, 2), [(0, 0), (1, 1)], [[(0, 0), (0, 1), (1, 1), (0, 0)]], None]))
    assert [g and to_wkt(g) for g in got] == ["POINT(1 2)", "LINESTRING(0 0,1 1)", "POLYGON((0 0,0 1,1 1,0 0))", None]
    for bad in ((1, 2, 3), [(1, 2, 3)], "POINT(1 2)", []):
        with pytest.raises(GeometryError):
            encode([bad])
    with pytest.raises(GeometryError):
        __import__("geolith.geo.text", fromlist=["x"]).from_wkt("POINT Z (1 2 3)")


def test_join_of_mixed_sizes(spark, monkeypatch):
    """Boxes of all sizes, one of them huge, against all pairs; and no nested loop in the plan."""
    from pyspark.sql import functions as F

    from geolith import operators
    from geolith.operators import spatial_pairs

    g = np.random.default_rng(3)

    def boxes(n, first):
        at, size = g.uniform(-1000, 1000, (n, 2)), 2.0 ** g.uniform(-12, 8, (n, 2)) * (g.random((n, 1)) < 0.7)
        at[0], size[0] = (-5000, -5000), (10_000, 10_000)
        at[1], size[1] = (-1e18, -1e18), (2e18, 2e18)
        return [(first + k, *a, *(a + s)) for k, (a, s) in enumerate(zip(at.tolist(), size))]

    one, two = boxes(400, 0), boxes(300, 1000)
    make = lambda rows, name: spark.createDataFrame([tuple(map(float, r)) for r in rows], f"{name} double, x0 double, y0 double, x1 double, y1 double").select(name, G.st_make_envelope("x0", "y0", "x1", "y1").alias(f"{name}_g"))
    want = {(a[0], b[0]) for a in one for b in two if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    for small in (True, False):
        monkeypatch.setattr(operators, "SMALL", 1 << 60 if small else 0)
        right = make(two, "b") if small else make(two, "b").repartition(3)
        met = spatial_pairs(make(one, "a"), right, "a_g", "b_g", predicate=lambda p, q: F.lit(True))
        got = [tuple(map(int, r)) for r in met.select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_buffers_against_jts(spark):
    """Random lines and areas: what differs is no more than arcs of other corners allow, and joins have no notches."""
    from geolith.geo import build
    from geolith.geo.text import from_wkt, to_wkt

    jvm = spark.sparkContext._jvm
    reader = jvm.org.locationtech.jts.io.WKTReader()
    g = np.random.default_rng(4)
    walk = lambda n: "LINESTRING(" + ",".join(f"{x} {y}" for x, y in np.cumsum(g.uniform(-2, 3, (n, 2)), axis=0).round(3).tolist()) + ")"
    cases = [("LINESTRING(0 0,10 3,20 0)", 2.0), *((walk(n), w) for n in (2, 5, 30, 150) for w in (0.3, 2.0)), ("MULTILINESTRING((0 0,10 0,10 10,0 10,0 0),(5 -3,5 13),(2 2,2 2))", 1.0), ("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((5 0,9 0,9 4,5 4,5 0)))", 0.7), ("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((5 0,9 0,9 4,5 4,5 0)))", -0.5), (P, -1.0), ("LINESTRING(1000000 1000000,1000000.001 1000000,1000000.001 1000000.002)", 0.0005), ("POLYGON((0 0,0 9,9 9,5 4,9 0,0 0),(1 1,2 1,2 2,1 1))", 0.7), ("POLYGON((0 0,0 9,9 9,9 0,0 0))", -1.5), ("MULTIPOINT(0 0,1 1,9 9)", 1.0)]
    for wkt, width in cases:
        own = reader.read(to_wkt(build.buffer(from_wkt(wkt), width, 8)))
        other = reader.read(wkt).buffer(width, 8)
        assert own.isValid() and own.symDifference(other).getArea() <= 0.012 * abs(width) * other.getLength(), wkt


def test_extents_of_a_stream(spark, tmp_path):
    """A stream that ends when its files are read: rows in time count, rows behind the watermark don't."""
    from datetime import datetime, timedelta

    from geolith.streaming import windowed_extent

    start, files = datetime(2024, 1, 1), str(tmp_path / "in")
    schema = "ts timestamp, x double, y double"
    batches = [[(0, 1.0, 2.0), (5, 3.0, 4.0)], [(70, 5.0, 6.0)], [(75, 7.0, 1.0)], [(6, 99.0, 99.0)], [(200, 0.0, 0.0)]]
    for rows in batches:
        spark.createDataFrame([(start + timedelta(minutes=m), x, y) for m, x, y in rows], schema).coalesce(1).write.mode("append").parquet(files)
        __import__("time").sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(files)
    extents = windowed_extent(stream.withColumn("g", G.st_make_envelope("x", "y", "x", "y")), "g", "ts", "1 hour")
    query = extents.writeStream.format("memory").queryName("stream_extents").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start.hour, r.n, r.xmin, r.ymin, r.xmax, r.ymax) for r in spark.sql("SELECT window.start, n, extent.* FROM stream_extents").collect()}
    assert got == {(0, 2, 1.0, 2.0, 3.0, 4.0), (1, 2, 5.0, 1.0, 7.0, 6.0)}


def test_noding_equals_all_pairs():
    """Segments on a small grid, which share ends and overlap, nearly straight ones, and random floats."""
    from itertools import pairwise

    from geolith.geo.build import noded
    from geolith.geo.relate import cut_by

    g = np.random.default_rng(6)
    near_line = lambda n: [((0.0, 0.0), (float(k + 1), (k + 1) * 0.1 + e)) for k, e in enumerate(g.choice([0.0, 1e-17, -1e-16], n).tolist())]
    tables = [g.integers(0, 5, (60, 4)).astype(float).tolist(), g.uniform(-1, 1, (60, 4)).tolist(), (g.integers(0, 4, (60, 4)) / 10 + 1e6).tolist()]
    for edges in [[((a, b), (c, d)) for a, b, c, d in t] for t in tables] + [near_line(30)]:
        want = set()
        for e in edges:
            want.update((min(p, q), max(p, q)) for p, q in pairwise(cut_by(*e, edges)))
        assert noded(edges) == {(p, q) for p, q in want if p != q}
