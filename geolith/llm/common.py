"""What the operators of this subpackage share: scratch tables, global order, running sums.

Scratch tables are Parquet under the folder that ``spark.checkpoint.dir`` names,
which every executor and the driver can reach; they cut lineage, so a lost
executor costs the tasks it was running and nothing that was already written.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts: the blank, and tab to carriage return. Fixed values.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts in a batch that Spark hands to Python; where equal chunks of a batch are handled once, more pay.
TEXTS, CHUNKED = 1000, 2000

#: Scratch tables by the scope in which they were made; those of no scope stay until the end of the program.
_scratch: dict[str | None, list[tuple[SparkSession, str]]] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local master may go without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


@contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """What is written within it belongs to the scope ``name``, which ``release`` deletes."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(None if keep else _scope.get(), []).append((spark, path))
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is written hands Python batches of so many rows at most: a batch is held once in the JVM and once in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let_go(*holders) -> None:
    """At the end of a Python task: the holders ``forget``, and freed memory goes back to the system, as the worker lives on."""
    import ctypes

    import pyarrow as pa

    for holder in holders:
        holder.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def groups_of(batches, keys: list[str]):
    """(key values, record batches) of runs of equal integer keys in sorted batches."""
    import numpy as np

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != last:
                yield last, held
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield last, held


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut. With ``keep``, it belongs to no scope."""
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(scope: str | None) -> None:
    """Delete the scratch tables of a scope. Call it once what was derived from them is written."""
    for spark, path in _scratch.pop(scope, []):
        if spark.sparkContext._jsc is None:
            continue
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        for scope in list(_scratch):
            release(scope)
    except Exception:  # noqa: BLE001  the session is gone already
        _scratch.clear()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it, in capitals or not."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def words_in(text: Column) -> Column:
    """The number of words, long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, keys: list, name: str) -> tuple[DataFrame, list[int]]:
    """``df`` sorted globally by ``keys`` and written, with ``_pid`` and ``_idx``.

    Also returns how many rows lie before each partition. The driver sees one
    count per partition; the rank of a row is ``before[_pid] + _idx``.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.withColumns({"_pid": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    table = written(laid, name)
    return table, before(table.groupBy("_pid").agg(F.count("*").alias("n")).collect())


def before(counts: list) -> list[int]:
    """Running totals, exclusive, from rows of (partition number, amount)."""
    sums, have = [], dict((r[0], r[1] or 0) for r in counts)
    total = 0
    for p in range(max(have, default=-1) + 2):
        sums.append(total)
        total += have.get(p, 0)
    return sums


def at(values: list[int], index: str) -> Column:
    """``values[index]`` from a constant array, one entry per partition."""
    return F.get(F.lit([int(v) for v in values]).cast("array<bigint>"), F.col(index))


def running_sum(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` within ``group`` up to this row, by (bucket, order).

    ``bucket`` cuts every group into parts that one task can sort. Sums per part
    are combined first, so a group of any size is spread over the tasks.
    """
    parts = df.groupBy(group, bucket).agg(F.sum(value).alias("_part"))
    w = Window.partitionBy(group).orderBy(bucket)
    parts = parts.withColumn("_base", F.sum("_part").over(w) - F.col("_part"))
    parts = written(parts.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), "_base"), "parts")
    inner = Window.partitionBy(bucket, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.repartitionByRange(bucket).withColumn("_run", F.sum(value).over(inner))
    joined = summed.join(parts, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b")), "left")
    return joined.withColumn(out, F.col("_run") + F.col("_base")).drop("_run", "_base", "_g", "_b")
