"""URL filters as a sort-merge range join of canonical keys with rule intervals.

The key of a URL is its host with the labels reversed, a slash less, and its
path: ``http://a.example.net/en/1`` has ``net.example.a/en/1``. A rule's key is
the prefix of the keys it fits, that is, an interval of the sorted keys. As a rule
fits all subdomains, a URL has one key for each suffix of its host. Keys and rule
starts are sorted together, and one sweep over them keeps the stack of the rules
that are open at the current key; they are nested, so the top is the longest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import written

#: (rule, verdict): a host with a path. Fixed values of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (``page_id, url``): ``page_id, host, path, rule, verdict``.

    ``rules`` has ``rule`` (host, slash, rest of path) and ``verdict``. A rule fits
    a URL whose host is the rule's or a subdomain of it and whose path starts with
    the rule's; of several the one with the longest host wins, then with the
    longest path. Without a rule the verdict is ``default``.

    A null URL or one without ``://`` has an empty host and path and fits no rule.
    Repeated rows give repeated results. Rules with an empty host fit nothing; a
    rule given twice counts as the one with the lesser verdict. Both tables may be
    empty or large: the rules are range-partitioned along with the keys.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    probes = urls.withColumn("_l", labels).select("page_id", "host", "path", F.posexplode(F.transform("_l", lambda x, i: F.concat(F.concat_ws(".", F.slice("_l", F.lit(1), i + 1)), F.col("path")))).alias("_k", "key"))
    shown = F.col("rule")
    cut = F.instr(shown, "/")
    host = F.translate(F.substring(shown, F.lit(1), cut - 1), _UPPER, _LOWER)
    prefix = F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.substring(shown, cut, F.length(shown)))
    known = rules.where((cut > 1) & F.col("verdict").isNotNull()).groupBy(prefix.alias("key")).agg(F.min(F.struct("verdict", "rule")).alias("_r"))
    known = written(known.select("key", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict")), "rules")

    none = F.lit(None).cast("string")
    rows = known.select("key", F.lit(0).alias("_type"), F.lit(None).cast("long").alias("page_id"), none.alias("host"), none.alias("path"), F.lit(-1).alias("_k"), "rule", "verdict")
    rows = rows.unionByName(probes.select("key", F.lit(1).alias("_type"), F.col("page_id").cast("long").alias("page_id"), "host", "path", "_k", none.alias("rule"), none.alias("verdict")))
    keys = ["key", "_type", "page_id", "path"]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.withColumns({"_pid": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = written(laid, "keys")

    # The rules that are open where a partition begins are prefixes of its first key: at most one per character. They go first in it.
    first = laid.groupBy("_pid").agg(F.min("key").alias("_first"))
    lengths = F.sequence(F.lit(1), F.length("_first"))
    begins = first.where(F.length("_first") > 0).select("_pid", F.explode(F.transform(lengths, lambda n: F.substring(F.col("_first"), F.lit(1), n))).alias("_prefix"))
    carried = begins.join(known, F.col("_prefix") == F.col("key")).select("_pid", (F.length("key") - (1 << 32)).cast("long").alias("_idx"), "key", F.lit(0).alias("_type"), "rule", "verdict")
    laid = laid.unionByName(carried, allowMissingColumns=True).repartition("_pid").sortWithinPartitions("_pid", "_idx")

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, stack = None, []
        for frame in frames:
            got = []
            for at, key, kind, rule, verdict in zip(*(frame[c] for c in ("_pid", "key", "_type", "rule", "verdict"))):
                if at != pid:
                    pid, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0 and not (stack and stack[-1][0] == key):
                    stack.append((key, rule, verdict))
                got.append(stack[-1][1:] if stack else (None, None))
            out = frame[["page_id", "host", "path", "_k"]].copy()
            out["rule"], out["verdict"] = [g[0] for g in got], [g[1] for g in got]
            yield out[frame["_type"] == 1]

    laid = laid.select(F.col("page_id").cast("string").alias("page_id"), "host", "path", "_k", "key", "_type", "rule", "verdict", "_pid")
    swept = laid.mapInPandas(sweep, "page_id string, host string, path string, _k int, rule string, verdict string")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("_k", "rule", "verdict"))).alias("_best")
    out = swept.groupBy("page_id", "host", "path").agg(best, F.count_if(F.col("_k") == 0).alias("_n"))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), r(rule, rhost, rpath, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
) SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
