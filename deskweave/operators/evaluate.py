"""Score predictions against hidden truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.functions import responses as R
from deskweave.functions import text as X
from deskweave.operators.holdout import TRUTH_PREFIX
from deskweave.operators.ordering import latest_by

# Prediction columns passed through, and the columns of the resolution view.
PASS_THROUGH = ("confidence", "resolution_action", "proposed_solution", "verification", "reason")
RESOLUTION_VIEW = ("predicted_support_level", "correct_support_level", "predicted_confidence",
                   "predicted_resolution_action", "predicted_proposed_solution", "predicted_verification",
                   "predicted_reason")


def parsed_predictions(
    predictions: DataFrame, fields: Sequence[str], response: str = "model_response", kinds: Mapping[str, str] | None = None
) -> DataFrame:
    """Add the prediction fields found in the response. A column that exists already wins, null or not."""
    wanted = [f for f in fields if f not in predictions.columns]
    if not wanted or response not in predictions.columns:
        return predictions
    kinds = kinds or {}
    parsed = predictions.withColumn("_prediction", R.prediction_object(response))
    return parsed.select(
        *[F.col(c) for c in predictions.columns],
        *[R.response_field(F.col("_prediction"), f, kinds.get(f, "string")).alias(f) for f in wanted],
    )


def score(
    truth: DataFrame,
    predictions: DataFrame,
    targets: Sequence[str],
    id_field: str = "number",
    seq: str = "seq",
    breakdowns: Sequence[str] = (),
    keep_unpredicted: bool = False,
) -> DataFrame:
    """One row per truth row that has a prediction (or per truth row, with ``keep_unpredicted``).

    The last prediction of an id counts. Ids are compared as text. Only the columns needed are
    carried, so wide ticket text never enters the join.
    """
    passed = [f for f in PASS_THROUGH if f in predictions.columns and f not in targets]
    answer = latest_by(
        predictions.select(
            F.col(id_field).cast("string").alias("_id"),
            F.col(seq).alias("_seq"),
            *[F.col(f).alias(f"_p_{f}") for f in targets if f in predictions.columns],
            *[F.col(f).alias(f"_p_{f}") for f in passed],
        ),
        ["_id"],
        "_seq",
    )
    kinds = dict(truth.dtypes)
    expected = {f: (TRUTH_PREFIX + f if TRUTH_PREFIX + f in kinds else f) for f in targets}
    kept = [c for c in dict.fromkeys([id_field, seq, *breakdowns]) if c in kinds]
    left = truth.select(
        F.col(id_field).cast("string").alias("_truth_id"),
        *[F.col(c) for c in kept],
        *[F.col(e).alias(f"expected_{f}") if e in kinds else F.lit(None).cast("string").alias(f"expected_{f}")
          for f, e in expected.items()],
    )
    joined = left.join(answer, F.col("_truth_id") == F.col("_id"), "left" if keep_unpredicted else "inner")
    received = F.col("_id").isNotNull()
    predicted_kinds = dict(joined.dtypes)
    flags, columns = [], []
    for f in targets:
        actual = F.col(f"_p_{f}") if f"_p_{f}" in predicted_kinds else F.lit(None).cast("string")
        flag = X.equal_after_normalising(F.col(f"expected_{f}"), actual, kinds.get(expected[f], "string"))
        flags.append(flag)
        columns += [F.col(f"expected_{f}"), actual.alias(f"predicted_{f}"), flag.alias(f"correct_{f}")]
    all_correct = received
    for flag in flags:
        all_correct = all_correct & flag
    return joined.select(
        *kept,
        received.alias("prediction_received"),
        *columns,
        all_correct.alias("all_fields_correct"),
        *[F.col(f"_p_{f}").alias(f"predicted_{f}") for f in passed],
    )


def resolution_decisions(scored: DataFrame, id_field: str = "number") -> DataFrame:
    return scored.select(*[c for c in (id_field, *RESOLUTION_VIEW) if c in scored.columns])


def without_prediction(tickets: DataFrame, predictions: DataFrame, id_field: str = "number") -> DataFrame:
    answered = predictions.select(F.col(id_field).cast("string").alias("_id"))
    return tickets.join(answered, F.col(id_field).cast("string") == F.col("_id"), "left_anti")


def with_prediction(truth: DataFrame, predictions: DataFrame, id_field: str = "number") -> DataFrame:
    answered = predictions.select(F.col(id_field).cast("string").alias("_id"))
    return truth.join(answered, F.col(id_field).cast("string") == F.col("_id"), "left_semi")


def aligned_predictions(
    batches: DataFrame, fields: Sequence[str], ids: str = "ids", response: str = "response", id_field: str = "number"
) -> DataFrame:
    """Predictions of each batch response, tied to the ids of the batch.

    An unknown id is replaced by the id at the same position when the counts agree; rows that stay
    unknown and repeated ids are dropped, first one kept. A batch is one row, so this needs no shuffle.
    """
    items = R.record_array(response, "predictions")
    given = F.transform(F.col(ids), lambda i: i.cast("string"))

    def resolve(item, i):
        named = F.try_variant_get(item, f"$.{id_field}", "string")
        known = F.array_contains(F.col("_given"), named)
        by_place = (F.size("_items") == F.size("_given")) & (i < F.size("_given"))
        place = F.try_element_at(F.col("_given"), i + 1)
        return F.struct(F.when(known, named).when(by_place, place).alias("id"), item.alias("item"))

    resolved = batches.select(
        *[c for c in batches.columns if c not in (ids, response)], given.alias("_given"), items.alias("_items")
    ).withColumn("_resolved", F.transform("_items", resolve))
    known_ids = F.transform("_resolved", lambda r: r["id"])
    first = F.filter("_resolved", lambda r, i: r["id"].isNotNull() & (F.array_position(F.col("_order"), r["id"]) == i + 1))
    kept = resolved.withColumn("_order", known_ids).withColumn("_one", F.explode(first))
    return kept.select(
        *[c for c in batches.columns if c not in (ids, response)],
        F.col("_one.id").alias(id_field),
        *[F.try_variant_get(F.col("_one.item"), f"$.{f}", "string").alias(f) for f in fields],
    )
