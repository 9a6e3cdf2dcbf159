"""The decisions of operators, applied to whole rows of documents.

All take and return the columns of ``docs``, whatever their names and types; only
doc_id, text and, for the mix, source are looked at. Nulls and empty texts count as
the operators say. Where rows repeat a doc_id and text, the row that goes first by
all its columns as JSON stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import fresh, written
from geolith.llm.exact import dedup
from geolith.llm.mixing import mix
from geolith.llm.near import near_duplicates


def text_mark(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (``doc_id, text_md5, kept``, a row for each) keeps."""
    d, m, nth = (fresh(n, docs.columns) for n in ("_kept_id", "_kept_md5", "_nth"))
    decided = written(decided.select(F.col("doc_id").alias(d), F.col("text_md5").alias(m), "kept"), "decided")
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (text_mark(docs) == F.col(m))
    rows = docs.join(decided.where("kept").select(d, m), same, "left_semi")
    if decided.groupBy(d, m).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept AND n > 1").isEmpty():
        return rows
    w = Window.partitionBy("doc_id", text_mark(rows)).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
    return rows.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def exact_stage(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts: that with the most code points, then the least doc_id (null last)."""
    return keep_rows(docs, dedup(docs))


def near_stage(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates: that with the least doc_id (null last); texts without words are one class."""
    return keep_rows(docs, near_duplicates(docs))


def mix_stage(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it; rows with the same doc_id and text share what is taken of them, rounded up.

    Texts without words are never taken. A null source is a source of its own.
    """
    d, m, times, i = (fresh(n, docs.columns) for n in ("_taken_id", "_taken_md5", "_times", "_i"))
    taken = mix(docs, carry=[F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")]).groupBy(F.col("doc_id").alias(d), F.col("mark").alias(m))
    taken = taken.agg(F.ceil(F.sum("times") / F.count("*")).cast("int").alias(times)).where(F.col(times) > 0)
    taken = written(taken, "taken")
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(d)) & (text_mark(docs) == F.col(m)))
    rows = rows.withColumn(i, F.explode(F.array_repeat(F.lit(0), F.col(times))))
    return rows.select(*(docs[f"`{c}`"] for c in docs.columns))
