"""Sharding by a two-pass external shuffle, in SQL functions only.

Pass one scatters the records by a seeded hash over buckets of a bounded size.
Pass two puts each bucket into a fixed order, shuffles it by Fisher-Yates
(Spark's ``shuffle``) and lays the buckets end to end; that sequence, a random
permutation of all records, is dealt to the shards in equal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import at, before, written

#: Bytes of text in a bucket, on average; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
#: Copies of one row, by doc_id and text, from which on rows are told apart by their place in the input, too.
COPIES = 64


def shuffled_buckets(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Both passes: ``_bucket, _k, doc_id, text``, the rows of each bucket in shuffled order, written; and the number of rows."""
    rows = docs.select("doc_id", "text")
    content = F.xxhash64(F.lit(seed), "doc_id", F.isnull("text"), F.coalesce("text", F.lit("")))
    copied = not rows.groupBy("doc_id", content.alias("_c")).count().where(F.col("count") > COPIES).isEmpty()
    place = F.monotonically_increasing_id() if copied else F.lit(0)
    n, size = docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("s")).agg(F.count("*"), F.sum(F.col("s") + 8)).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(content, place), F.lit(buckets)).cast("int").alias("_bucket")
    record = F.struct(F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("_h"), "doc_id", "text")
    filled = rows.select(bucket, record.alias("_r")).repartitionById(int(buckets), F.col("_bucket")).groupBy("_bucket").agg(F.sort_array(F.collect_list("_r")).alias("_a"))
    dealt = filled.select("_bucket", F.posexplode(F.shuffle("_a", F.lit(seed))).alias("_k", "_r"))
    return written(dealt.select("_bucket", "_k", "_r.doc_id", "_r.text"), "dealt"), n


def shard(docs: DataFrame, shards: int = 24, seed: int = 23, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, shard, slot``; the shards' row counts differ by one at most.

    ``slot`` is the place in the shard, gapless from 0. The result is a table in
    the shared folder whose files each hold records of one bucket in their order.

    A row's bucket depends on its doc_id and text. Where there are many copies of a
    row, it also depends on the row's place in the input, so that copies don't meet
    in one bucket; an input whose order may change between two readings should be
    written first.

    Null text stays null and counts as no bytes; null doc_ids and repeated rows
    are records like others. An empty table gives an empty result, and shards may
    be empty if there are fewer rows than shards. Other columns are not read.
    """
    dealt, n = shuffled_buckets(docs, seed, bucket_bytes)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    group = 1024  # buckets whose counts are summed in one place
    sums = before(counts.groupBy(F.floor(F.col("_bucket") / group).cast("int")).agg(F.sum("_n")).collect())
    w = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_g", F.floor(F.col("_bucket") / group).cast("int"))
    starts = written(starts.select(F.col("_bucket").alias("_b"), (at(sums, "_g") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_start")), "starts")
    placed = dealt.join(starts, F.col("_bucket") == F.col("_b")).withColumn("_at", F.col("_start") + F.col("_k"))
    which = F.expr(f"(_at * {shards}L) div {max(1, n)}L")
    placed = placed.withColumn("shard", which.cast("int"))
    begin = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "text", "shard", (F.col("_at") - begin).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
