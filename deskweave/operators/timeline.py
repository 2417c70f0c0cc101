"""Event sequences per key, exact even when one key holds a large part of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskweave.operators.ordering import chunked, numbered, running, sliced

CHUNK_ROWS = 50_000


def trailing_counts(df: DataFrame, keys: Sequence[str], at: str, days: int, name: str = "in_window") -> DataFrame:
    """Per key and instant: events in the closed interval from ``days`` before up to the instant.

    Equal instants are counted together first. Each instant then asks for two running totals, its
    own and the one just before its interval begins; their difference is the count. The totals run
    over slices of the sequence, so no key has to fit into one task.
    """
    per_instant = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_n"))
    marks = F.array(
        F.struct((F.col(at) - F.make_dt_interval(F.lit(days))).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_add")),
        F.struct(F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.col("_n").alias("_add")),
    )
    spread = per_instant.select(*keys, at, F.inline(marks))
    order = ["_t", "_kind"]
    totals = running(sliced(spread, keys, order), keys, order, sums={"_total": F.col("_add")})
    upto = F.max(F.when(F.col("_kind") == 1, F.col("_total")))
    before = F.max(F.when(F.col("_kind") == 0, F.col("_total")))
    return totals.groupBy(*keys, at).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_add"))).alias("here"), (upto - before).alias(name)
    )


def with_next_event(df: DataFrame, key: str, at: str, seq: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds the time of the key's next event and the seconds until then."""
    placed = chunked(numbered(df, [at, seq], "_position", [key]), "_position", chunk_rows, after=1)
    order = Window.partitionBy(key, "_chunk").orderBy("_position")
    seen = placed.withColumn("next_at", F.lead(at).over(order)).where("_home")
    return seen.withColumn("seconds_in_state", F.timestamp_diff("SECOND", F.col(at), F.col("next_at"))).drop(
        "_position", "_chunk", "_home"
    )


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Mean of the ``rows`` values before the current one, the current one left out."""
    placed = chunked(numbered(df, order, "_position", keys), "_position", max(chunk_rows, rows), before=rows)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_position").rowsBetween(-rows, -1)
    return placed.withColumn(name, F.avg(value).over(frame)).where("_home").drop("_position", "_chunk", "_home")


def latest_state(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], as_of: Column | None = None, tie: str | None = None) -> DataFrame:
    """The last known row per key, up to a point in time if given. Partial aggregation, no window."""
    rows = df if as_of is None else df.where(F.col(at) <= as_of)
    order = F.struct(at, tie) if tie else F.col(at)
    last = F.max_by(F.struct(at, *columns), order)
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")
