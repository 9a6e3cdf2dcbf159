"""Geometries are made from the tables' numbers, so that SQL can tell the results without any geometry."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith import functions as G
from geolith import sources
from geolith.geo.codec import encode, write_wkb
from geolith.geo.model import Dialect, Geometry
from geolith.operators import dealt, locate_in_envelope, spatial_join
from geolith.streaming import windowed_extent

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _wkt(*cols) -> Column:
    """``POINT(x y)`` from two columns."""
    return F.concat(F.lit("POINT("), F.col(cols[0]).cast("string"), F.lit(" "), F.col(cols[1]).cast("string"), F.lit(")"))


def _customers(spark, sf_dir: str, srid: int | None = None) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.withColumn("g", G.st_geom_from_text(_wkt("c_custkey", "c_nationkey"), *([] if srid is None else [F.lit(srid)])))


def _balances(spark, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.withColumn("g", G.st_geom_from_text(F.concat(F.lit("POINT("), F.col("c_acctbal").cast("string"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(")"))))


def _flat(box: str) -> list[Column]:
    return [F.col(box)[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]


_POINT = "'POINT(' || c_custkey || ' ' || c_nationkey || ')'"
ENVELOPE = (0.0, 5.0, 5000.0, 15.0)
_IN = "(c_custkey BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15)"


def _envelope(corners=ENVELOPE) -> Column:
    x0, y0, x1, y1 = corners
    return F.lit(encode(Geometry(3, (((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)),)), Dialect.WKB))


@_query(f"SELECT c_custkey, {_POINT} AS wkt FROM customer")
def as_text(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_as_text("g").alias("wkt"))


@_query(f"SELECT c_custkey, {_POINT} AS wkt, 4269 AS srid FROM customer")
def geom_from_text(spark, sf_dir):
    return _customers(spark, sf_dir, 4269).select("c_custkey", G.st_as_text("g").alias("wkt"), G.st_srid("g").alias("srid"))


@_query(f"SELECT c_custkey, 'SRID=4269;' || {_POINT} AS wkt FROM customer")
def geom_from_wkb(spark, sf_dir):
    raw = F.expr("substring(g, 2)")
    return _customers(spark, sf_dir).select("c_custkey", G.st_as_ewkt(G.st_geom_from_wkb(raw, F.lit(4269))).alias("wkt"))


@_query(
    "SELECT n_nationkey, 'SRID=4326;POLYGON((' || x || ' ' || y || ',' || x || ' ' || (y+1) || ',' || (x+1) || ' ' || (y+1) || ',' || (x+1) || ' ' || y || ',' || x || ' ' || y || '))' AS wkt"
    " FROM (SELECT n_nationkey, n_nationkey AS x, n_regionkey AS y FROM nation)"
)
def as_ewkt(spark, sf_dir):
    x, y = F.col("n_nationkey"), F.col("n_regionkey")
    return _table(spark, sf_dir, "nation").select("n_nationkey", G.st_as_ewkt(G.st_make_envelope(x, y, x + 1, y + 1, F.lit(4326))).alias("wkt"))


@_query("SELECT s_suppkey, 1 AS tag, CAST(s_nationkey AS DOUBLE) AS xmin, CAST(s_suppkey AS DOUBLE) AS ymin, CAST(s_nationkey + 2 AS DOUBLE) AS xmax, CAST(s_suppkey + 3 AS DOUBLE) AS ymax FROM supplier")
def make_envelope(spark, sf_dir):
    x, y = F.col("s_nationkey"), F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").withColumn("g", G.st_make_envelope(x, y, x + 2, y + 3)).withColumn("b", G.box2d("g"))
    return s.select("s_suppkey", F.expr("ascii(substring(g, 1, 1))").cast("int").alias("tag"), *_flat("b"))


@_query("""SELECT c_custkey, '{"type": "Point", "coordinates": [' || c_custkey || ',' || c_nationkey || ']}' AS json FROM customer""")
def as_geojson(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_as_geojson("g").alias("json"))


@_query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ST_Point' WHEN 1 THEN 'ST_LineString' ELSE 'ST_Polygon' END AS kind FROM customer")
def geometry_type(spark, sf_dir):
    k = F.col("c_custkey") % 3
    wkt = F.when(k == 0, "POINT(1 2)").when(k == 1, "LINESTRING(1 2,3 4)").otherwise("POLYGON((0 0,1 0,1 1,0 0))")
    return _table(spark, sf_dir, "customer").select("c_custkey", G.st_geometry_type(G.st_geom_from_text(wkt)).alias("kind"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 4269 END AS srid FROM customer")
def srid(spark, sf_dir):
    even, odd = G.geometry("POINT(1 1)", 4269), G.geometry("POINT(1 1)")
    return _table(spark, sf_dir, "customer").select("c_custkey", G.st_srid(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd)).alias("srid"))


def _segments(spark, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("LINESTRING("), F.col("c_custkey").cast("string"), F.lit(" 0, "), F.col("c_nationkey").cast("string"), F.lit(" 7)"))
    return _table(spark, sf_dir, "customer").withColumn("g", G.st_geom_from_text(line))


@_query("SELECT c_custkey, CAST(least(c_custkey, c_nationkey) AS DOUBLE) AS xmin, CAST(0 AS DOUBLE) AS ymin, CAST(greatest(c_custkey, c_nationkey) AS DOUBLE) AS xmax, CAST(7 AS DOUBLE) AS ymax FROM customer")
def box2d(spark, sf_dir):
    return _segments(spark, sf_dir).withColumn("b", G.box2d("g")).select("c_custkey", *_flat("b"))


_EXTENT = "min(c_acctbal) AS xmin, CAST(min(c_custkey) AS DOUBLE) AS ymin, max(c_acctbal) AS xmax, CAST(max(c_custkey) AS DOUBLE) AS ymax"


@_query(f"SELECT c_nationkey, {_EXTENT} FROM customer GROUP BY c_nationkey")
def extent(spark, sf_dir):
    return _balances(spark, sf_dir).groupBy("c_nationkey").agg(G.st_extent("g").alias("e")).select("c_nationkey", *_flat("e"))


@_query(f"SELECT c_nationkey, {_EXTENT} FROM customer GROUP BY c_nationkey")
def extent_sql(spark, sf_dir):
    G.register_all(spark)
    _balances(spark, sf_dir).createOrReplaceTempView("geolith_balances")
    return spark.sql("SELECT c_nationkey, e.* FROM (SELECT c_nationkey, ST_Extent(g) AS e FROM geolith_balances GROUP BY c_nationkey)")


@_query(f"SELECT c_nationkey, c_mktsegment, {_EXTENT} FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def extent_cube(spark, sf_dir):
    c = _balances(spark, sf_dir).select("c_nationkey", "c_mktsegment", G.box2d("g").alias("b"))
    return c.cube("c_nationkey", "c_mktsegment").agg(G.st_extent_of("b").alias("e")).select("c_nationkey", "c_mktsegment", *_flat("e"))


@_query("SELECT c_custkey, max(c_acctbal) OVER w AS xmax, CAST(min(c_custkey) OVER w AS DOUBLE) AS ymin FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def extent_window(spark, sf_dir):
    c = _balances(spark, sf_dir).withColumn("b", G.box2d("g"))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-3, 0)
    return c.select("c_custkey", F.max("b.xmax").over(w).alias("xmax"), F.min("b.ymin").over(w).alias("ymin"))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, min(value) AS xmin, CAST(max(user_id) AS DOUBLE) AS ymax FROM events GROUP BY 1")
def extent_by_day(spark, sf_dir):
    point = F.concat(F.lit("POINT("), F.col("value").cast("string"), F.lit(" "), F.col("user_id").cast("string"), F.lit(")"))
    e = _table(spark, sf_dir, "events").withColumn("g", G.st_geom_from_text(point))
    return windowed_extent(e, "g", "ts", "1 day").select(F.col("window.start").alias("day"), "n", F.col("extent.xmin").alias("xmin"), F.col("extent.ymax").alias("ymax"))


@_query("SELECT c_custkey, 'POINT(' || (c_custkey + 3) || ' ' || (c_nationkey - 2) || ')' AS wkt FROM customer")
def translate(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_as_text(G.st_translate("g", 3, -2)).alias("wkt"))


@_query("SELECT c_custkey, 'POINT(' || c_custkey || ' ' || (4096 - c_nationkey) || ')' AS wkt FROM customer")
def as_mvt_geom(spark, sf_dir):
    box = G.box2d(G.geometry("LINESTRING(0 0,4096 4096)"))
    return _customers(spark, sf_dir).select("c_custkey", G.st_as_text(G.st_as_mvt_geom("g", box)).alias("wkt"))


@_query(f"SELECT c_custkey, {_IN} AS hit FROM customer")
def intersects(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_intersects("g", _envelope()).alias("hit"))


@_query(f"SELECT c_custkey, {_IN} AS hit FROM customer")
def covers(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_covers(_envelope(), "g").alias("hit"))


@_query(f"SELECT c_custkey, {_IN} AS hit FROM customer")
def covered_by(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", G.st_covered_by("g", _envelope()).alias("hit"))


@_query("SELECT c_custkey, c_custkey % 7 = 3 AS hit FROM customer")
def equals(spark, sf_dir):
    end = F.concat(F.lit("LINESTRING(0 0,"), (F.col("c_custkey") % 7).cast("string"), F.lit(" 3)"))
    return _table(spark, sf_dir, "customer").select("c_custkey", G.st_equals(G.st_geom_from_text(end), G.geometry("LINESTRING(3 3,1 1,0 0)")).alias("hit"))


@_query(
    "SELECT n_nationkey, 'LINESTRING(' || x || ' ' || y || ',' || x || ' ' || (y+1) || ',' || (x+1) || ' ' || (y+1) || ',' || (x+1) || ' ' || y || ',' || x || ' ' || y || ')' AS wkt"
    " FROM (SELECT n_nationkey, n_nationkey AS x, n_regionkey AS y FROM nation)"
)
def boundary(spark, sf_dir):
    x, y = F.col("n_nationkey"), F.col("n_regionkey")
    return _table(spark, sf_dir, "nation").select("n_nationkey", G.st_as_text(G.st_boundary(G.st_make_envelope(x, y, x + 1, y + 1))).alias("wkt"))


@_query("SELECT c_custkey, CAST(c_custkey - 50 AS DOUBLE) AS xmin, CAST(c_nationkey - 50 AS DOUBLE) AS ymin, CAST(c_custkey + 50 AS DOUBLE) AS xmax, CAST(c_nationkey + 50 AS DOUBLE) AS ymax FROM customer")
def buffer(spark, sf_dir):
    b = _customers(spark, sf_dir).withColumn("b", G.box2d(G.st_buffer("g", 50, 2)))
    return b.select("c_custkey", *(F.round(c, 6).alias(n) for c, n in zip(_flat("b"), ("xmin", "ymin", "xmax", "ymax"))))


@_query("SELECT s_suppkey, CAST(s_nationkey - 2 AS DOUBLE) AS xmin, CAST(-2 AS DOUBLE) AS ymin, CAST(s_nationkey + 12 AS DOUBLE) AS xmax, CAST(2 AS DOUBLE) AS ymax FROM supplier")
def buffer_line(spark, sf_dir):
    x = F.col("s_nationkey")
    line = F.concat(F.lit("LINESTRING("), x.cast("string"), F.lit(" 0,"), (x + 10).cast("string"), F.lit(" 0)"))
    s = _table(spark, sf_dir, "supplier").withColumn("b", G.box2d(G.st_buffer(G.st_geom_from_text(line), 2, 2)))
    return s.select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in zip(_flat("b"), ("xmin", "ymin", "xmax", "ymax"))))


@_query("SELECT s_suppkey, 'GEOMETRYCOLLECTION' AS kind, 3 AS rings, CAST(s_nationkey AS DOUBLE) AS xmin, CAST(s_nationkey + 10 AS DOUBLE) AS xmax FROM supplier")
def split(spark, sf_dir):
    x = F.col("s_nationkey")
    cuts = F.concat(F.lit("MULTILINESTRING(("), (x + 2).cast("string"), F.lit(" -1,"), (x + 2).cast("string"), F.lit(" 11),("), (x + 5).cast("string"), F.lit(" -1,"), (x + 5).cast("string"), F.lit(" 11))"))
    s = _table(spark, sf_dir, "supplier").withColumn("g", G.st_split(G.st_make_envelope(x, F.lit(0), x + 10, F.lit(10)), G.st_geom_from_text(cuts)))
    g = F.when(F.col("g").isNotNull(), F.col("g"))  # else Spark chains the split to each of its two readers and runs it twice
    s = s.withColumns({"t": G.st_as_text(g), "b": G.box2d(g)})
    return s.select("s_suppkey", F.substring_index("t", "(", 1).alias("kind"), F.regexp_count("t", F.lit("POLYGON")).alias("rings"), F.col("b.xmin").alias("xmin"), F.col("b.xmax").alias("xmax"))


@_query("SELECT c_custkey FROM customer WHERE least(c_custkey, c_nationkey) >= 3 AND greatest(c_custkey, c_nationkey) <= 900")
def envelope_lookup(spark, sf_dir):
    return locate_in_envelope(_segments(spark, sf_dir), "g", (3, 0, 900, 7)).select("c_custkey")


def _nation_boxes(spark, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select("n_nationkey", G.st_make_envelope(n * 40, n - 3, n * 40 + 200, n + 3).alias("box"))


_NEAR = "c_custkey BETWEEN n_nationkey * 40 AND n_nationkey * 40 + 200 AND c_nationkey BETWEEN n_nationkey - 3 AND n_nationkey + 3"


@_query(f"SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON {_NEAR} GROUP BY n_nationkey")
def spatial_join_broadcast(spark, sf_dir):
    met = spatial_join(_customers(spark, sf_dir), _nation_boxes(spark, sf_dir), "g", "box")
    return met.groupBy("n_nationkey").agg(F.count("*").alias("n"))


@_query(f"SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON {_NEAR} GROUP BY n_nationkey")
def spatial_join_grid(spark, sf_dir):
    met = spatial_join(_customers(spark, sf_dir), _nation_boxes(spark, sf_dir), "g", "box", cell=100.0)
    return met.groupBy("n_nationkey").agg(F.count("*").alias("n"))


@_query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE {_NEAR})")
def spatial_semi_join(spark, sf_dir):
    return spatial_join(_customers(spark, sf_dir), _nation_boxes(spark, sf_dir), "g", "box", "left_semi", "c_custkey").select("c_custkey")


@_query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE {_NEAR})")
def spatial_anti_join(spark, sf_dir):
    return spatial_join(_customers(spark, sf_dir), _nation_boxes(spark, sf_dir), "g", "box", "left_anti", "c_custkey").select("c_custkey")


@_query(f"SELECT c_custkey, n_nationkey FROM customer LEFT JOIN nation ON {_NEAR}")
def spatial_left_join(spark, sf_dir):
    return spatial_join(_customers(spark, sf_dir), _nation_boxes(spark, sf_dir), "g", "box", "left", "c_custkey").select("c_custkey", "n_nationkey")


@_query(f"SELECT c_custkey, c_acctbal FROM customer WHERE {_IN} ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def filter_sort_limit(spark, sf_dir):
    hit = _customers(spark, sf_dir).where(G.st_covers(_envelope(), "g"))
    return hit.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@_query(f"SELECT c_custkey FROM customer WHERE {_IN} INTERSECT SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 300")
def set_operations(spark, sf_dir):
    c = _customers(spark, sf_dir)
    one = c.where(G.st_intersects("g", _envelope())).select("c_custkey")
    return one.intersect(c.where(G.st_intersects("g", _envelope((100.0, 0.0, 300.0, 100.0)))).select("c_custkey"))


@_query(f"SELECT c_custkey FROM customer WHERE {_IN} UNION SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 300")
def set_union(spark, sf_dir):
    c = _customers(spark, sf_dir)
    one = c.where(G.st_intersects("g", _envelope())).select("c_custkey")
    return one.union(c.where(G.st_intersects("g", _envelope((100.0, 0.0, 300.0, 100.0)))).select("c_custkey")).distinct()


@_query(f"SELECT c_custkey FROM customer WHERE {_IN} EXCEPT SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 300")
def set_except(spark, sf_dir):
    c = _customers(spark, sf_dir)
    one = c.where(G.st_intersects("g", _envelope())).select("c_custkey")
    return one.exceptAll(c.where(G.st_intersects("g", _envelope((100.0, 0.0, 300.0, 100.0)))).select("c_custkey"))


@_query(f"SELECT c_nationkey, c_mktsegment, {_EXTENT} FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def extent_rollup(spark, sf_dir):
    c = _balances(spark, sf_dir).select("c_nationkey", "c_mktsegment", G.box2d("g").alias("b"))
    return c.rollup("c_nationkey", "c_mktsegment").agg(G.st_extent_of("b").alias("e")).select("c_nationkey", "c_mktsegment", *_flat("e"))


@_query(f"SELECT c_nationkey, c_mktsegment, {_EXTENT} FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment))")
def extent_grouping_sets(spark, sf_dir):
    c = _balances(spark, sf_dir).select("c_nationkey", "c_mktsegment", G.box2d("g").alias("b"))
    keys = [F.col("c_nationkey"), F.col("c_mktsegment")]
    return c.groupingSets([[k] for k in keys], *keys).agg(G.st_extent_of("b").alias("e")).select(*keys, *_flat("e"))


@_query("SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS xmax, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS DOUBLE) AS ymin FROM customer")
def extent_window_whole(spark, sf_dir):
    """Windows over a whole partition and up to the current row."""
    c = _balances(spark, sf_dir).withColumn("b", G.box2d("g"))
    w = Window.partitionBy("c_nationkey")
    return c.select("c_custkey", F.max("b.xmax").over(w).alias("xmax"), F.min("b.ymin").over(w.orderBy(F.desc("c_custkey"))).alias("ymin"))


#: Types of geometries by the remainder of a key, as text around the coordinates x and y. Fixed values.
_MULTI = (
    ("ST_MultiPoint", "MULTIPOINT({x} {y},1 2)"),
    ("ST_MultiLineString", "MULTILINESTRING(({x} {y},1 2),(3 4,5 6))"),
    ("ST_MultiPolygon", "MULTIPOLYGON((({x} {y},{x} 99,-5 99,{x} {y})))"),
    ("ST_GeometryCollection", "GEOMETRYCOLLECTION(POINT({x} {y}),LINESTRING(1 2,3 4))"),
    ("ST_LineString", "LINESTRING({x} {y},1 2)"),
)


def _pick(of: int, x: str, y: str) -> str:
    quoted = [m[of].replace("{x}", f"' || {x} || '").replace("{y}", f"' || {y} || '") for m in _MULTI]
    return "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(quoted)) + " END"


@_query(f"SELECT c_custkey, {_pick(1, 'c_custkey', 'c_nationkey')} AS wkt, {_pick(0, '', '')} AS kind, 4326 AS srid FROM customer")
def multi_types(spark, sf_dir):
    """Text, type and SRID of all types, written to Parquet and read back."""
    c = _table(spark, sf_dir, "customer").withColumn("wkt", F.expr(_pick(1, "c_custkey", "c_nationkey")))
    c = stored(c.select("c_custkey", G.st_geom_from_text("wkt", F.lit(4326)).alias("g")))
    return c.select("c_custkey", G.st_as_text("g").alias("wkt"), G.st_geometry_type("g").alias("kind"), G.st_srid("g").alias("srid"))


@_query("SELECT c_custkey, 'MULTIPOINT(' || (-c_custkey - 10) || ' ' || c_nationkey || ',1 2)' AS wkt FROM customer")
def boundary_of_lines(spark, sf_dir):
    line = F.concat_ws("", F.lit("LINESTRING("), (-F.col("c_custkey") - 10).cast("string"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(",7 7,1 2)"))
    return _table(spark, sf_dir, "customer").select("c_custkey", G.st_as_text(G.st_boundary(G.st_geom_from_text(line))).alias("wkt"))


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read back: geometry columns are plain binary values there."""
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.checkpoint.dir', '') or '/tmp/checkpoints'}/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@_query(f"SELECT c_custkey, {_POINT} AS wkt, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 4326 END AS srid FROM customer")
def dialects(spark, sf_dir):
    """All five dialects are read alike; the SRID 1 stands for none."""
    c = _customers(spark, sf_dir, 4326)

    @F.pandas_udf("binary")
    def in_dialect(g: pd.Series, key: pd.Series) -> pd.Series:
        from geolith.geo.codec import decode

        return pd.Series([encode(decode(v), Dialect(1 + k % 5)) for v, k in zip(g, key)])

    c = c.withColumn("g", in_dialect("g", "c_custkey"))
    return c.select("c_custkey", G.st_as_text("g").alias("wkt"), F.coalesce(G.st_srid("g"), F.lit(1)).alias("srid"))


@_query(
    "SELECT k, CASE k % 5 WHEN 0 THEN 'POINT(' || k || ' 1)' WHEN 1 THEN 'LINESTRING(0 ' || k || ',2 3)' WHEN 2 THEN 'POLYGON((0 0,0 ' || k || ',1 1,0 0))' WHEN 3 THEN 'POINT(' || k || ' 7)' END AS wkt, "
    "CASE WHEN k % 5 = 3 THEN 2 WHEN k % 5 < 3 THEN k % 3 + 2 END AS tag FROM range(60) AS t(k)"
)
def built_from_shapes(spark, sf_dir):
    """A fixed table: plain coordinates of all three depths in three dialects, payloads that get a tag, and nulls."""
    rows = []
    for k in range(60):
        payload = write_wkb(Geometry(1, ((float(k), 7.0),)), False)
        made = [(k, 1), [(0, k), (2, 3)], [[(0, 0), (0, k), (1, 1), (0, 0)]], payload, None][k % 5]
        rows.append((k, sources.encode([made], Dialect.EWKB if k % 5 == 3 else Dialect(k % 3 + 2))[0]))
    table = spark.createDataFrame(rows, "k long, g binary")
    return table.select("k", G.st_as_text("g").alias("wkt"), F.expr("ascii(substring(g, 1, 1))").cast("long").alias("tag"))


@_query("SELECT 1 AS hit, 15 AS n")
def bench_intersects(spark, sf_dir):
    """Three times a million lines against a point."""
    return bench_table(spark).where(G.st_intersects("geom", G.geometry("POINT(10 11)"))).agg(F.lit(1).alias("hit"), F.count("*").cast("int").alias("n"))


def bench_table(spark: SparkSession, rows: int = 1_000_000, copies: int = 3) -> DataFrame:
    """Row i of each copy is the line (i i+1, i+2 i+3, i+4 i+5)."""

    def lines(frames):
        head = np.frombuffer(bytes([2, 1, 2, 0, 0, 0, 3, 0, 0, 0]), np.uint8)
        for frame in frames:
            i = frame["id"].to_numpy() % rows
            xy = (i[:, None] + np.array([0, 1, 2, 3, 4, 5])).astype("<f8").view(np.uint8)
            raw = np.concatenate([np.broadcast_to(head, (len(i), len(head))), xy], axis=1)
            yield pd.DataFrame({"geom": [r.tobytes() for r in raw]})

    return spark.range(0, rows * copies, 1, 8).mapInPandas(lines, "geom binary")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the extent of its customers and how many of them lie in an envelope."""
    c = _customers(spark, sf_dir).select("c_nationkey", G.box2d("g").alias("b"), G.st_covers(_envelope(), "g").alias("hit"))
    return c.groupBy("c_nationkey").agg(F.count_if("hit").alias("hits"), G.st_extent_of("b").alias("e")).select("c_nationkey", "hits", *_flat("e"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
