"""From raw documents to packed sequences: quality, exact dedup, near dedup, mixing, packing.

Every stage takes nulls in any column, empty and long texts, repeated rows, empty
tables and extra columns of any name, and returns the columns of its input, but for
the last. How each counts nulls and ties is said with the operator that it calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from geolith.llm.common import release, scratch_scope, written
from geolith.llm.packing import pack
from geolith.llm.quality import keep_quality
from geolith.llm.stages import exact_stage, mix_stage, near_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The run that the stages belong to; stages called by themselves are one sequence.
_run: ContextVar[str] = ContextVar("run", default="stages")


def _stage(stage: Stage) -> Stage:
    """With scratch tables of the run: those of the stage before go, as its result has been written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch_scope(_run.get()):
            release(_run.get())
            return stage(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from them and the table of labels, scores at 0.3 or more."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without blanks; texts without signs are one group."""
    return exact_stage(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id."""
    return near_stage(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; documents without words are never taken."""
    return mix_stage(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 1024 tokens."""
    return pack(docs, ids=False)


#: A stage's result is written before the next stage begins, which deletes the scratch tables of the one before.
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, the signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token = _run.set(f"pipeline-{uuid.uuid4().hex}")
    try:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _run.reset(token)
