"""Seconds of the headline queries, as one line of JSON."""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from geolith import functions as G  # noqa: E402
from geolith.plans import queries as spatial  # noqa: E402

QUERIES = ["as_text", "geom_from_text", "as_geojson", "box2d", "extent", "intersects", "covers", "buffer", "spatial_join_broadcast", "spatial_join_grid", "extent_by_day"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("SPARK_SHARED_DIR", "/tmp/checkpoints"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def clock(name: str, run) -> None:
        run()  # the first run compiles and starts workers
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    lines = spatial.bench_table(spark).cache()
    lines.count()
    hit = lines.where(G.st_intersects("geom", G.geometry("POINT(10 11)")))

    def intersects() -> None:
        assert hit.count() == 15

    clock("intersects_3m_lines", intersects)
    every = lines.select(G.st_intersects("geom", G.geometry("POINT(10 11)")).alias("hit"))
    clock("intersects_3m_lines_all_rows", lambda: every.write.format("noop").mode("overwrite").save())
    lines.unpersist()
    for name in QUERIES:
        clock(name, lambda: spatial.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
