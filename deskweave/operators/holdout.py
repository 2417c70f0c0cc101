"""Cut a label-free holdout from a labelled table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.operators.ordering import first_rows, numbered

# The naming convention of hidden truth and reporting context.
TRUTH_PREFIX = "_expected_"
SCENARIO_FIELD = "_test_scenario"
SURROGATE_ID = "_evaluation_id"


def hidden_columns(df: DataFrame, configured: Sequence[str] = ()) -> list[str]:
    names = set(configured) | {SCENARIO_FIELD}
    return sorted(c for c in df.columns if c.startswith(TRUTH_PREFIX) or c in names)


def visible_rows(
    df: DataFrame, id_field: str = "number", configured: Sequence[str] = (), allowed: Sequence[str] = ()
) -> DataFrame:
    """What a scorer may see: no truth, no scenario; the id always, then the allowed columns in order."""
    hidden = set(hidden_columns(df, configured)) - {id_field}
    remaining = [c for c in df.columns if c not in hidden]
    if allowed:
        remaining = [c for c in dict.fromkeys([id_field, *allowed]) if c in remaining]
    return df.select(*remaining)


def drop_truth(df: DataFrame) -> DataFrame:
    """Last guard before scoring."""
    return df.drop(*[c for c in df.columns if c.startswith(TRUTH_PREFIX)])


def holdout_sample(df: DataFrame, size: int, id_field: str = "number", seed: int = 42) -> DataFrame:
    """A fixed-size sample that does not depend on partitioning: smallest seeded hashes of the id."""
    key = F.md5(F.concat(F.col(id_field).cast("string"), F.lit(f":{seed}")))
    return first_rows(df, [key, F.col(id_field)], max(int(size), 1))


def head(df: DataFrame, size: int, order: str = "seq") -> DataFrame:
    return first_rows(df, [order], max(int(size), 1))


def has_repeated_ids(df: DataFrame, id_field: str) -> bool:
    """A one-row check; duplicates are found by a grouped count, not by collecting ids."""
    return not df.groupBy(id_field).count().where("count > 1").limit(1).isEmpty()


def with_surrogate_id(df: DataFrame, id_field: str = "number", order: Sequence[str] = ("seq",)) -> tuple[DataFrame, str]:
    """The table and its id column; TEST-00001 … when the given id is missing or repeated."""
    if id_field in df.columns and not has_repeated_ids(df, id_field):
        return df, id_field
    return surrogate_ids(df, order), SURROGATE_ID


def surrogate_ids(df: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    placed = numbered(df, order, "_position")
    return placed.withColumn(SURROGATE_ID, F.format_string("TEST-%05d", "_position")).drop("_position")


def batch_numbers(df: DataFrame, size: int, order: Sequence[str] = ("seq",), limit: int = 50) -> DataFrame:
    """Consecutive batches of fixed size, numbered from 1."""
    size = max(1, min(int(size), limit))
    placed = numbered(df, order, "_position")
    return placed.withColumn("batch_no", F.floor((F.col("_position") - 1) / size).cast("bigint") + 1).drop("_position")


def split_summary(sample: DataFrame, visible: DataFrame, id_field: str, configured: Sequence[str] = ()) -> DataFrame:
    """One-row report of a split."""
    hidden = [c for c in hidden_columns(sample, configured) if c not in visible.columns]
    return visible.agg(F.count(F.lit(1)).alias("visible_count")).select(
        "visible_count", F.lit(", ".join(hidden)).alias("hidden_columns"), F.lit(id_field).alias("id_field")
    )
