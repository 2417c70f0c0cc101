"""URL filters as a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm.common import read
from deskweave.operators.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host's key begins the keys of all its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _swept(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Points and rules in key order; ``stack`` holds the hosts whose interval contains the current key."""
    stack: list[tuple[str, list[str], dict[str, tuple[str, str]]]] = []  # (host key, sorted paths, path -> rule, verdict)

    def close(key: str) -> None:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()

    def add(key: str, path: str, rule: str, verdict: str) -> None:
        if not stack or stack[-1][0] != key:
            stack.append((key, [], {}))
        if path not in stack[-1][2]:
            stack[-1][1].insert(bisect_right(stack[-1][1], path), path)
            stack[-1][2][path] = (rule, verdict)

    def longest(path: str) -> tuple[str | None, str]:
        best: tuple[int, int, str | None, str] = (-1, -1, None, default)
        for depth, (_, paths, rules) in enumerate(stack):
            at = bisect_right(paths, path) - 1
            while at >= 0 and not path.startswith(paths[at]):
                # Every prefix of the path is at most as long as what it shares with this neighbour.
                shared = 0
                for x, y in zip(path, paths[at]):
                    if x != y:
                        break
                    shared += 1
                at = bisect_right(paths, path[:shared], 0, at) - 1
            if at >= 0:
                rule, verdict = rules[paths[at]]
                best = max(best, (len(rule), depth, rule, verdict), key=lambda b: b[:2])
        return best[2], best[3]

    at_slice = None
    for batch in batches:
        rows = batch.to_pydict()
        rules_out: list[str | None] = []
        verdicts: list[str] = []
        keep: list[int] = []
        for i in range(batch.num_rows):
            key = rows["key"][i]
            if rows["slice"][i] != at_slice:
                at_slice = rows["slice"][i]
                stack.clear()
            close(key)
            if rows["rule"][i] is not None:
                add(key, rows["path"][i], rows["rule"][i], rows["verdict"][i])
            else:
                rule, verdict = longest(rows["path"][i])
                keep.append(i)
                rules_out.append(rule)
                verdicts.append(verdict)
        if keep:
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("page_id"), taken.column("host"), taken.column("path"), pa.array(rules_out, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path starts with its
    path; the longest ``host + path`` wins, of equally long ones the longer host, of repeated ones the
    verdict that sorts first. Without a rule: null and ``default``.

    Keys are host labels in reverse, so a rule's host is an interval of keys that nests with all others.
    Rules and URLs are written together in key order (range-partitioned by key, path and id, so a host
    with a third of all URLs spreads over many slices) and each slice is swept once with a stack of
    the hosts that contain the current key. A slice begins with the rules still open from slices before
    it; these contain its first key, hence at most one chain of host labels per slice is handed on.

    A null URL has empty host and path. Repeated rows are judged each. Empty tables give no rows. Other
    columns of either table are ignored. Rules with null host, path or verdict fit nothing.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    none = F.lit(None).cast("string")
    points = pages.select("page_id", host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    known = known.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.translate("host", UPPER, LOWER).alias("host"), "path", F.concat("host", "path").alias("rule"), "verdict")
    both = points.union(known).withColumn("key", host_key(F.col("host"))).withColumn("_url", F.col("rule").isNull())
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "_url", "path", "page_id"]
    both = both.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()).sortWithinPartitions(*order)
    both = stage(both, "urls")
    # Of each slice its first key; the rules of earlier slices whose host contains it are added to the slice.
    labels = F.split(F.expr("substring(first, 1, length(first) - 1)"), "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    heads = both.groupBy("slice").agg(F.min("key").alias("first")).select(F.col("slice").alias("to"), F.explode(chain).alias("key"))
    handed = heads.join(both.where("rule is not null"), "key").where("slice < to")
    handed = handed.withColumn("slice", F.col("to")).select(*both.columns)
    swept = both.union(handed).repartitionByRange(slices, "slice").sortWithinPartitions("slice", *order)
    schema = "page_id long, host string, path string, rule string, verdict string"
    return swept.mapInArrow(lambda batches: _swept(batches, default), schema)


def op9_reversed_host_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS place
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE place = 1
"""
