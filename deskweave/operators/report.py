"""Breakdowns of scored rows. Each is one partial/final aggregation over a few narrow columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.functions import text as X
from deskweave.operators.holdout import SCENARIO_FIELD
from deskweave.operators.ordering import first_rows

# Fixed values.
NO_SCENARIO, NO_VALUE = "Unspecified", "Missing"


def scored_fields(scored: DataFrame) -> list[str]:
    return [c[len("correct_"):] for c in scored.columns if c.startswith("correct_")]


def _share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def overall(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.round(_share(F.col("prediction_received")), 6).alias("prediction_coverage"),
        F.round(_share(F.col("all_fields_correct")), 6).alias("overall_exact_match"),
    )


def field_performance(scored: DataFrame) -> DataFrame:
    """Per field accuracy and coverage over all scored rows.

    All fields are aggregated in one pass; only the single result row is turned into one row per field.
    """
    kinds = dict(scored.dtypes)
    fields = scored_fields(scored)
    measures = []
    for i, f in enumerate(fields):
        covered = X.present(f"predicted_{f}", kinds[f"predicted_{f}"]) if f"predicted_{f}" in kinds else F.lit(False)
        measures += [
            F.sum(F.coalesce(F.col(f"correct_{f}"), F.lit(False)).cast("int")).alias(f"_n{i}"),
            F.sum(covered.cast("int")).alias(f"_c{i}"),
        ]
    one = scored.agg(F.count(F.lit(1)).alias("_total"), *measures)
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("correct"), F.col(f"_c{i}").alias("covered"))
        for i, f in enumerate(fields)
    ])
    long = one.where("_total > 0").select("_total", F.inline(rows))
    return long.select(
        "field",
        F.round(F.col("correct") / F.col("_total"), 6).alias("accuracy"),
        F.round(F.col("covered") / F.col("_total"), 6).alias("coverage"),
        "correct",
        F.col("_total").alias("total"),
    ).orderBy("accuracy", "field")


def scenario_performance(scored: DataFrame, scenario: str = SCENARIO_FIELD) -> DataFrame:
    fields = scored_fields(scored)
    label = F.coalesce(F.col(scenario).cast("string"), F.lit(NO_SCENARIO)) if scenario in scored.columns else F.lit(NO_SCENARIO)
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"correct_{f}"), F.lit(False)).cast("int") for f in fields])
    rows = scored if scenario in scored.columns else scored.where(F.lit(False))
    return rows.groupBy(label.alias("scenario")).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.round(_share(F.col("prediction_received")), 6).alias("prediction_coverage"),
        F.round(_share(F.col("all_fields_correct")), 6).alias("all_fields_exact_match"),
        F.round(F.avg(hits / F.lit(len(fields))), 6).alias("average_field_accuracy"),
    )


def confusion(scored: DataFrame, field: str) -> DataFrame:
    def label(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(NO_VALUE))

    return (
        scored.groupBy(label(f"expected_{field}").alias("expected"), label(f"predicted_{field}").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("tickets"))
        .orderBy(F.desc("tickets"), "expected", "predicted")
    )


def _class_counts(scored: DataFrame, field: str) -> DataFrame:
    """Hits, support and claims per label, from the confusion rows (classes squared, not tickets)."""
    cells = confusion(scored, field)
    hits = F.when(F.col("expected") == F.col("predicted"), F.col("tickets")).otherwise(0)
    none = F.lit(0).cast("bigint")
    as_truth = F.struct(F.col("expected").alias("label"), hits.alias("hits"), F.col("tickets").alias("support"), none.alias("claimed"))
    as_claim = F.struct(F.col("predicted").alias("label"), none.alias("hits"), none.alias("support"), F.col("tickets").alias("claimed"))
    return cells.select(F.inline(F.array(as_truth, as_claim))).groupBy("label").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    ).withColumn("f1", F.coalesce(F.try_divide(F.lit(2) * F.col("hits"), F.col("support") + F.col("claimed")), F.lit(0.0)))


def class_metrics(scored: DataFrame, field: str) -> DataFrame:
    """Precision, recall and F1 per class."""
    return _class_counts(scored, field).where(F.col("label") != NO_VALUE).select(
        "label",
        "support",
        F.round(F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)), 6).alias("recall"),
        F.round("f1", 6).alias("f1"),
    )


def macro_f1(scored: DataFrame, field: str) -> DataFrame:
    """Unweighted mean F1 over classes, and the share of tickets without a usable prediction."""
    named = F.col("label") != NO_VALUE
    return _class_counts(scored, field).agg(
        F.lit(field).alias("field"),
        F.count_if(named).alias("classes"),
        F.round(F.avg(F.when(named, F.col("f1"))), 5).alias("macro_f1"),
        F.round(F.sum(F.when(named, 0).otherwise(F.col("claimed"))) / F.sum("claimed"), 6).alias("invalid_rate"),
    )


def failures(scored: DataFrame, limit: int, order: str = "seq", scenario: str = SCENARIO_FIELD) -> DataFrame:
    ids = [c for c in ("number", "sys_id", "_evaluation_id") if c in scored.columns]
    shown = [
        c for c in scored.columns
        if c in (scenario, "prediction_received") or c.startswith(("expected_", "predicted_", "correct_"))
    ]
    missed = scored.where(~F.coalesce(F.col("all_fields_correct"), F.lit(False)))
    return first_rows(missed.select(*dict.fromkeys([*ids, order, *shown])), [order], max(int(limit), 1)).select(*ids, *shown)


def branch_comparison(branches: Mapping[str, DataFrame]) -> DataFrame:
    """Accuracy per field, one column per predictor, over the same holdout."""
    names = sorted(branches)
    per_field = [
        field_performance(branches[name]).select("field", F.lit(name).alias("branch"), "accuracy") for name in names
    ]
    return reduce(DataFrame.unionByName, per_field).groupBy("field").pivot("branch", names).agg(F.first("accuracy"))


def dashboard(scored: DataFrame) -> DataFrame:
    """Field rows with the text columns of a printed report."""
    return field_performance(scored).select("*", X.bar("accuracy").alias("bar"), X.percent("accuracy").alias("shown"))


def run_summary(predictions: DataFrame, mode: str) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("predictions")).select(F.lit(mode).alias("mode"), "predictions")


def response_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Requested against returned records per finish reason."""
    return diagnostics.groupBy("finish_reason").agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum("requested").alias("requested"),
        F.sum("returned").alias("returned"),
        F.sum((F.col("returned") < F.col("requested")).cast("int")).alias("short_responses"),
        F.round(F.avg("completion_tokens"), 4).alias("mean_tokens"),
    )


def last_diagnostics(diagnostics: DataFrame, order: Sequence[str] = ("seq",), keep: int = 100) -> DataFrame:
    return first_rows(diagnostics, [F.col(c).desc() for c in order], keep)
