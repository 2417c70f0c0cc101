"""Evaluation along a graph that is held in an edge table, frontier by frontier.

A frontier is what has no open predecessor left. Every edge is joined once, in the round that its child becomes
ready, and every row once; the number of rounds is the depth of the graph, whatever the number of rows. What
each round finds is written, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from deskweave.operators.joins import BROADCAST_ROWS
from deskweave.operators.staging import stage

STUCK = -1  # stands for the level of what a cycle holds back


def levels(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the last predecessor's; null on or behind a cycle.

    ``edges`` has child and parent; edges whose parent is not among ``nodes`` are left out. One table is written per level.
    """
    known = stage(nodes.select(node).distinct(), "nodes")
    open_ = edges.select("child", "parent").join(known.select(F.col(node).alias("parent")), "parent", "left_semi")
    # Repeated edges go where the rows already lie by child. ``gone`` marks edges whose parent has its level; a child all of whose
    # edges are gone is ready.
    inner = open_.join(known.select(F.col(node).alias("child")), "child", "left_semi").distinct()
    rounds = stage(inner.withColumn("gone", F.lit(False)), "edges")
    waiting = rounds.select(F.col("child").alias(node)).distinct()
    ready = stage(known.join(waiting, node, "left_anti"), "ready")
    found = [ready.withColumn("level", F.lit(0))]
    while True:
        marked = rounds.where(~F.col("gone")).drop("gone").join(ready.select(F.col(node).alias("parent"), F.lit(True).alias("gone")), "parent", "left")
        before, rounds = rounds, stage(marked.withColumn("gone", F.coalesce("gone", F.lit(False))), "edges")
        gone, left = rounds.agg(F.count_if("gone"), F.count_if(~F.col("gone"))).first()
        if not gone:
            break
        ready = rounds.groupBy(F.col("child").alias(node)).agg(F.bool_and("gone").alias("_all")).where("_all").drop("_all")
        # Written, as the next round and the result both read it.
        ready = stage(ready, "ready")
        found.append(ready.withColumn("level", F.lit(len(found))))
        if not left:
            break
    if left:
        stuck = before.where(~F.col("gone")).select(F.col("child").alias(node)).distinct()
        found.append(stuck.withColumn("level", F.lit(None).cast("int")))
    return reduce(DataFrame.unionByName, found)


def _catalogue(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple], bool]:
    """(node, level) of all jobs with an edge, edges with the levels of both ends, the pairs of levels that edges lead
    between, and whether the edges may be broadcast.

    A catalogue of checked size, as is otherwise broadcast, is peeled by the driver without a job per level; a larger one by
    ``levels``.
    """
    spark = edges.sparkSession
    rows = edges.limit(BROADCAST_ROWS + 1).collect()
    kind, place = edges.schema["child"].dataType, edges.schema["place"].dataType
    ends = [StructField("child_level", IntegerType()), StructField("parent_level", IntegerType())]
    if len(rows) > BROADCAST_ROWS:
        jobs = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
        known = stage(levels(jobs, edges), "job-levels")
        sides = [known.select(F.col("node").alias(end), F.col("level").alias(f"{end}_level")) for end in ("child", "parent")]
        placed = stage(edges.join(sides[0], "child").join(sides[1], "parent"), "job-edges")
        return known, placed, [tuple(r) for r in placed.select("child_level", "parent_level").distinct().collect()], False
    waits: dict[object, int] = {}
    children: dict[object, list] = {}
    for child, parent in {(r["child"], r["parent"]) for r in rows}:
        waits[child] = waits.get(child, 0) + 1
        waits.setdefault(parent, 0)
        children.setdefault(parent, []).append(child)
    found: dict[object, int | None] = dict.fromkeys(waits)
    ready = [job for job, n in waits.items() if not n]
    level = 0
    while ready:
        found.update(dict.fromkeys(ready, level))
        told = [c for job in ready for c in children.get(job, ())]
        for c in told:
            waits[c] -= 1
        ready, level = [c for c in dict.fromkeys(told) if not waits[c]], level + 1
    known = spark.createDataFrame(list(found.items()), StructType([StructField("node", kind), StructField("level", IntegerType())]))
    placed = [(r["child"], r["parent"], r["place"], found[r["child"]], found[r["parent"]]) for r in rows]
    schema = StructType([StructField("child", kind), StructField("parent", edges.schema["parent"].dataType), StructField("place", place), *ends])
    return known, spark.createDataFrame(placed, schema), list({p[3:] for p in placed}), True


def along(
    rows: DataFrame,
    edges: DataFrame,
    job: str,
    by: Sequence[str],
    told: Mapping[str, tuple[Column, str]],
    step: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``step`` of every row, with what its finished predecessors in the same ``by`` group tell it; and its ``level``.

    ``rows`` has one row per ``by`` and job. ``edges`` has child, parent and place (order of a child's parents), alike for
    all groups. ``told`` names aggregates, with their types, over the parents' finished rows: these have the columns of
    ``step``'s result and of the edge. Without predecessors, or where the group does not hold them, they are null.
    ``step`` must keep the columns of ``rows``. Jobs on or behind a cycle have a null level and nothing told; the caller
    decides what that means.
    """
    edges = edges.select("child", "parent", "place")
    known, placed, pairs, small = _catalogue(edges)
    # Jobs without edges are ready at once.
    of_job = known.select(F.col("node").alias(job), F.coalesce("level", F.lit(STUCK)).alias("level"))
    work = rows.join(F.broadcast(of_job) if small else of_job, job, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    work = stage(work, "job-rows", by=("level",))
    done: dict[int, DataFrame] = {}
    for (level,) in sorted(work.select("level").distinct().collect()):
        here = work.where(F.col("level") == level)
        sources = [done[p] for c, p in sorted(pairs, key=str) if c == level and p in done]
        if sources:
            news = reduce(DataFrame.unionByName, sources).drop("level")
            arcs = placed.where(F.col("child_level") == level)
            news = news.join(F.broadcast(arcs) if small else arcs, F.col(job) == F.col("parent"))
            news = news.groupBy(*by, F.col("child").alias(job)).agg(*[c.cast(kind).alias(k) for k, (c, kind) in told.items()])
            here = here.join(news, [*by, job], "left")
        else:
            here = here.withColumns({k: F.lit(None).cast(kind) for k, (_, kind) in told.items()})
        done[level] = stage(step(here), f"job-level-{level}")
    if not done:
        return step(work.withColumns({k: F.lit(None).cast(kind) for k, (_, kind) in told.items()}))
    return reduce(DataFrame.unionByName, done.values()).withColumn("level", F.when(F.col("level") != STUCK, F.col("level")))
