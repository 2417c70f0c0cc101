"""Order-dependent operators that never put one group into one task.

A plain window over a hot key (or over no key at all) sorts the whole group in a single task. Here
the rows are range-partitioned by (keys, order): a hot key simply spreads over several slices. Work
is done per (keys, slice), and what earlier slices pass on is a table of at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskweave.operators.staging import stage

SLICE = "_slice"

Order = Sequence[str | Column]


def _columns(order: Order) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order]


def sliced(df: DataFrame, keys: Sequence[str], order: Order, slices: int | None = None) -> DataFrame:
    """Rows in contiguous slices of the (keys, order) sequence. ``order`` must break all ties."""
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(k).asc_nulls_first() for k in keys], *_columns(order))
    return stage(ranged.withColumn(SLICE, F.spark_partition_id()), "sliced")


def running(
    slices: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running totals and maxima, current row included, per key in the given order."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    local = Window.partitionBy(*keys, SLICE).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)

    per_slice = slices.groupBy(*keys, SLICE).agg(
        *[F.sum(c).alias(f"_carry_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_carry_{n}") for n, c in maxima.items()],
    )
    # Only the first key of a slice can continue from the slice before, so this table has fewer
    # rows than there are slices: small by construction, whatever the data volume.
    carried = per_slice.select(
        *keys,
        SLICE,
        F.lag(SLICE).over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_previous"),
        *[F.sum(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_carry_{n}").over(earlier).alias(f"_carry_{n}") for n in maxima],
    ).where(F.col("_previous").isNotNull())
    carried = carried.select(
        F.col(SLICE).alias("_carry_slice"),
        *[F.col(k).alias(f"_carry_key_{k}") for k in keys],
        *[f"_carry_{n}" for n in [*sums, *maxima]],
    )
    same = F.col(SLICE) == F.col("_carry_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_carry_key_{k}"))

    out = slices
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(local))
    for n, c in maxima.items():
        out = out.withColumn(n, F.max(c).over(local))
    out = out.join(F.broadcast(carried), same, "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)))
    for n in maxima:
        out = out.withColumn(n, F.greatest(F.col(n), F.col(f"_carry_{n}")))
    return out.drop("_carry_slice", *[f"_carry_key_{k}" for k in keys], *[f"_carry_{n}" for n in [*sums, *maxima]])


def numbered(df: DataFrame, order: Order, name: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """Dense positions 1, 2, 3 … over the whole table, or per key."""
    slices = sliced(df, keys, order)
    return running(slices, keys, order, sums={name: F.lit(1).cast("bigint")}).drop(SLICE)


def chunked(
    df: DataFrame, position: str, size: int, before: int = 0, after: int = 0, chunk: str = "_chunk"
) -> DataFrame:
    """Cut positions into chunks of ``size``; rows near an edge are repeated in the neighbour chunk.

    A frame of ``before``/``after`` rows computed per (key, chunk) is then exact for the rows with
    ``_home`` true; the repeated rows only serve as context and are dropped by the caller.
    """
    if max(before, after) > size:
        raise ValueError("The frame must fit into one chunk.")
    at = F.col(position) - 1
    home = F.floor(at / size).cast("bigint")
    offset = at % size
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    spread = F.filter(F.array(*targets), lambda c: c.isNotNull())
    return df.withColumn("_own", home).withColumn(chunk, F.explode(spread)).withColumn(
        "_home", F.col(chunk) == F.col("_own")
    ).drop("_own")


def first_rows(df: DataFrame, order: Order, n: int, heap_limit: int = 100_000) -> DataFrame:
    """The first ``n`` rows. Small ``n`` uses Spark's top-k; a large one keeps the rows distributed."""
    if n <= heap_limit:
        return df.orderBy(*_columns(order)).limit(n)
    return numbered(df, order, "_position").where(F.col("_position") <= n).drop("_position")


def latest_by(df: DataFrame, keys: Sequence[str], order: str | Column, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in order. Partial aggregation absorbs hot keys."""
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*[F.col(c) for c in rest]), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)
