"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded random order, served up to
``repeats`` times over. A service finishes at the virtual time (words served of
its source so far) / (weight of the source). All services are sorted globally by
finish time and cut where the words reach the total budget. At the cut every
queue that is not exhausted has had words in proportion to its weight, and what
exhausted queues leave goes to the others by weight: the water level. As whole
documents are served, no service may end beyond its source's level, and what a
source then lacks is filled with services that still fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import numbered, at, before, running_sum, words_in, written


def source_targets(sized: DataFrame, weights: Sequence[float], repeats: int, share: float) -> tuple[DataFrame, float, int]:
    """One row per source (``source, sid, source_size, weight, target``), the budget and the number of rows.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    The level is found by rounds of one-row aggregates over the sources, so
    neither their number nor their sizes have to fit the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    ranked, offsets = numbered(sums, [F.col("source").isNull(), "source"], "sources")
    ranked = ranked.withColumn("sid", at(offsets, "_pid") + F.col("_idx"))
    weight = F.get(F.lit([float(w) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    ranked = ranked.select("source", "sid", "source_size", "_rows", weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("_most"))
    total, rows = ranked.agg(F.sum("source_size"), F.sum("_rows")).first()
    budget = share * (total or 0)
    level = 0.0
    while True:
        full = F.col("_most") <= F.col("weight") * level
        spent, open_weight = ranked.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (budget - (spent or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    targets = ranked.select("source", "sid", "source_size", "weight", F.least("_most", F.col("weight") * level).alias("target"))
    return written(targets, "targets"), budget, rows or 0


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, share: float = 1.0, seed: int = 17, carry: Sequence[Column] = ()
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, times, taken``.

    ``times`` is how often the mix takes the document (0 to ``repeats``) and
    ``taken`` = size x times. Whole documents are taken, so at the cut a source
    lacks less than its next document. What it lacks is then filled from its other
    services, the longest that fits first, until none is left that fits.

    Null text and text without words have size 0, and such documents are never
    taken. ``carry`` adds columns of narrow values to the result. A null source is
    a source of its own, last in order. Rows that share a doc_id are documents of
    their own. An empty table gives an empty result. Only
    doc_id, text and source are read; other columns cannot clash.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    sized = docs.select("doc_id", source.cast("string").alias("source"), words_in(F.col("text")).alias("size"), F.struct(F.lit(0), *carry).alias("_carry"))
    sized = sized.withColumns({"_h": F.xxhash64(F.lit(seed), "doc_id", "source", "size"), "_uid": F.monotonically_increasing_id()})
    sized = written(sized, "sized")
    targets, budget, rows = source_targets(sized, weights, repeats, share)
    t = targets.withColumnRenamed("source", "_s")
    sized = sized.join(t, sized.source.eqNullSafe(t._s), "left").drop("_s")

    bits = max(6, (max(1, rows) // 4000).bit_length())
    queue = sized.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    queue = running_sum(queue.withColumnRenamed("_b", "_bucket"), "sid", "_bucket", ["_h", "_uid"], "size", "_cum")
    served = queue.withColumn("_pass", F.explode(F.lit(list(range(repeats)))))
    served = served.withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_cum")) / F.col("weight"))
    events, _ = numbered(served, ["_finish", "_uid"], "events")

    sums = before(events.groupBy("_pid").agg(F.sum("size")).collect())
    cut = max((p for p in range(len(sums) - 1) if sums[p] <= budget), default=0)
    taken = F.col("_pid") < cut
    if len(sums) > 1:
        w = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
        last = events.where(F.col("_pid") == cut).withColumn("_c", F.sum("size").over(w) + sums[cut])
        idx = last.where(F.col("_c") <= budget).agg(F.max("_idx")).first()[0]
        taken = taken | ((F.col("_pid") == cut) & (F.col("_idx") <= (-1 if idx is None else idx)))
    served = F.col("_pass") * F.col("source_size") + F.col("_cum")
    events = events.withColumn("_on", taken & (served <= F.col("target") + 1e-6))

    events = written(_filled(events, bits), "served")

    times = F.sum(F.when(F.col("_on") & (F.col("size") > 0), 1).otherwise(0)).alias("times")
    out = events.groupBy("_uid", "doc_id", "source", "size", "source_size", "target", "_carry").agg(times)
    out = out.withColumn("taken", F.col("size") * F.col("times"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", "taken", *(f"_carry.{n}" for n in out.schema["_carry"].dataType.names[1:]))


def _filled(events: DataFrame, bits: int) -> DataFrame:
    """``events`` with more of them ``_on``: per source the longest services that fit in what its target lacks.

    How many of each size is decided on counts by size, of which a source has at
    most as many as words that it lacks, and it lacks less than one document.
    """
    got = written(events.where("_on").groupBy("sid").agg(F.sum("size").alias("_got")).withColumnRenamed("sid", "_sid"), "got")
    fitting = events.where(~F.col("_on") & (F.col("size") > 0)).join(got, F.col("sid") == F.col("_sid"), "left")
    fitting = fitting.withColumn("_lack", F.floor(F.col("target") - F.coalesce("_got", F.lit(0)) + 1e-6)).where("size <= _lack").drop("_sid", "_got")
    sizes = fitting.groupBy("sid", "size").agg(F.count("*").alias("n"), F.first("_lack").alias("_lack"))
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n"))))
    taken = F.aggregate(
        "_sizes",
        F.struct(F.col("_lack").cast("long").alias("lack"), F.array().cast("array<struct<size: bigint, quota: bigint>>").alias("out")),
        lambda a, x: F.struct(
            (a["lack"] - F.least(x["n"], F.floor(a["lack"] / x["size"])) * x["size"]).alias("lack"),
            F.concat(a["out"], F.array(F.struct(x["size"].alias("size"), F.least(x["n"], F.floor(a["lack"] / x["size"])).alias("quota")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    quotas = sizes.groupBy("sid").agg(F.first("_lack").alias("_lack"), falling.alias("_sizes")).select(F.col("sid").alias("_s"), F.inline(taken))
    quotas = written(quotas.where("quota > 0").select("_s", F.col("size").alias("_z"), "quota"), "quotas")
    chosen = fitting.join(quotas, (F.col("sid") == F.col("_s")) & (F.col("size") == F.col("_z"))).select("sid", "size", "_pass", "_bucket", "_h", "_uid", "quota")
    chosen = chosen.withColumns({"_kind": F.struct("sid", "size"), "_slot": F.col("_pass") * (1 << bits) + F.col("_bucket"), "_one": F.lit(1)})
    chosen = running_sum(chosen, "_kind", "_slot", ["_h", "_uid"], "_one", "_nth").where("_nth <= quota")
    chosen = written(chosen.select(F.col("_uid").alias("_u"), F.col("_pass").alias("_p"), F.lit(True).alias("_fit")), "fits")
    events = events.join(chosen, (F.col("_uid") == F.col("_u")) & (F.col("_pass") == F.col("_p")), "left")
    return events.withColumn("_on", F.col("_on") | F.coalesce("_fit", F.lit(False))).drop("_u", "_p", "_fit")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times")
