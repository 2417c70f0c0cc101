"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.operators.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links(a, b)``; nodes of a component share one root.

    Each round every node moves to the neighbour (or itself) with the smallest hash of that round, and the
    links are rewritten and made distinct. The hash changes per round, so an expected constant share of
    the nodes goes away in each: a long chain needs logarithmically many rounds. All steps are
    aggregations with map-side combine and equi-joins, so a hub's links can be split over tasks.
    Null ends and links of a node to itself are ignored; an empty table gives an empty one.
    """
    links = stage(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    moves: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("to"))
        move = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["to"].alias("to"))
        move = stage(move, "moves")
        moves.append(move)
        left = links.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        left = left.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        low, high = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        links = stage(left.where("x <> y").select(low, high).distinct(), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        known = roots.select(F.col("node").alias("to"), "root")
        roots = move.join(known, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        # A node that others moved to, but that is in no later link, is a root itself.
    return stage(roots, "roots")
