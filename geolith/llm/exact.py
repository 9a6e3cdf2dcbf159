"""Exact dedup: a 128-bit hash of the normalised text groups the documents, and bytes are compared within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import BLANKS, written


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(text))


def _best() -> Column:
    """Which row of a group stays: the most code points, then the least doc_id (null last), then the least md5 of the text."""
    return F.min(F.struct(-F.col("_len"), F.col("doc_id").isNull().alias("no"), "doc_id", "_md5", F.col("_u").alias("u"))).alias("_best")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, text_md5``.

    Texts are equal when they are identical without their blanks. Of equal texts
    the row with the most code points stays, then the smallest doc_id (null last),
    then the least md5; of rows that are alike in all this, one.

    Only a narrow table (id, hash, digest, length) is shuffled for the grouping.
    Texts are read again just for documents that share a hash, and compared by
    the least and the greatest text of each hash, which map-side combining keeps
    to two texts per task and hash. If these differ, the hash collides, and its
    documents are grouped by the text itself.

    Null text counts as empty, so all empty texts are one group. Rows that repeat
    a doc_id count each, and exactly one row of a group has ``kept``. An empty
    table gives an empty result. Other columns are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    n = normalised(F.col("text"))
    slim = docs.select("doc_id", content_hash(n).alias("_h"), F.unhex(F.sha2(n, 256)).alias("_sha"), F.char_length(t).alias("_len"), F.unhex(F.md5(t)).alias("_md5"), F.monotonically_increasing_id().alias("_u"))
    slim = written(slim, "hashes")
    groups = slim.groupBy("_h").agg(F.count("*").alias("_n"), _best()).where("_n > 1")
    groups = written(groups.select(F.col("_h").alias("_k"), F.col("_best.doc_id").alias("_keep"), F.col("_best.u").alias("_at"), "_n"), "groups")

    members = slim.join(groups, F.col("_h") == F.col("_k"), "left_semi").select(F.col("doc_id").alias("_d")).distinct()
    members = written(members, "members")
    texts = docs.select("doc_id", F.col("text")).join(members, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    texts = texts.select("doc_id", normalised(F.col("text")).alias("_t"), F.char_length(t).alias("_len"), F.unhex(F.md5(t)).alias("_md5"))
    texts = texts.withColumn("_h", content_hash(F.col("_t")))
    clash = texts.groupBy("_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z")).where("_a <> _z").select(F.col("_h").alias("_c"))
    clash = written(clash, "collisions")
    if clash.isEmpty():
        return _shaped(slim.join(groups, F.col("_h") == F.col("_k"), "left"))
    plain = slim.join(clash, F.col("_h") == F.col("_c"), "left_anti").join(groups, F.col("_h") == F.col("_k"), "left")
    rows = texts.join(clash, F.col("_h") == F.col("_c"), "left_semi")
    rows = written(rows.withColumns({"_sha": F.unhex(F.sha2("_t", 256)), "_u": F.monotonically_increasing_id()}), "collided")
    own = rows.groupBy("_t").agg(F.count("*").alias("_n"), _best())
    own = written(own.select(F.col("_t").alias("_k"), F.col("_best.doc_id").alias("_keep"), F.col("_best.u").alias("_at"), "_n"), "regrouped")
    return _shaped(plain).unionByName(_shaped(rows.join(own, F.col("_t") == F.col("_k"))))


def _shaped(rows: DataFrame) -> DataFrame:
    """Rows with their group's ``_n, _keep, _at`` beside them, or null in these if they have no equal."""
    alone = F.col("_n").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_u") == F.col("_at"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.lower(F.hex("_md5")).alias("text_md5"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_md5")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), s AS (SELECT doc_id, length(t) AS len, sha256(n) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
