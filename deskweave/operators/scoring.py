"""Batched scoring by a callable of the user's: rows in, one response text per batch out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.functions.text import clamp
from deskweave.operators.evaluate import aligned_predictions, without_prediction
from deskweave.operators.holdout import drop_truth
from deskweave.operators.staging import stage

Responder = Callable[[list[dict]], str]

# The prediction fields declared by default.
PREDICTION_FIELDS = ("category", "ticket_type", "required_skills", "technology", "support_level", "resolution_action",
                     "proposed_solution", "verification", "confidence", "assignment_group", "agent_action")


def batch_responses(
    rows: DataFrame, respond: Responder, id_field: str = "number", batch_size: int = 5, concurrency: int | None = None
) -> DataFrame:
    """One row per batch of up to ``batch_size`` (1..50) visible rows: its ids and the response.

    Batches are formed inside the tasks, so nothing is numbered globally; ``concurrency`` bounds how
    many tasks call the responder at once.
    """
    size = clamp(batch_size, 1, 50)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        for frame in frames:
            plain = frame.astype(object).where(frame.notna(), None)
            out = []
            for start in range(0, len(plain), size):
                records = plain.iloc[start:start + size].to_dict("records")
                out.append((f"{task}-{made}", [str(r[id_field]) for r in records], respond(records)))
                made += 1
            yield pd.DataFrame(out, columns=["batch", "ids", "response"])

    visible = drop_truth(rows)
    if concurrency:
        visible = visible.repartition(concurrency)
    return visible.mapInPandas(run, "batch string, ids array<string>, response string")


def scored_by(
    rows: DataFrame,
    respond: Responder,
    fields: Sequence[str] = PREDICTION_FIELDS,
    id_field: str = "number",
    batch_size: int = 5,
    concurrency: int | None = None,
) -> DataFrame:
    """A prediction for every row: batches first, then the rows left unanswered one by one, else an error.

    Responses are written to the shared folder, because asking the responder again could cost or
    answer differently; every later step reads the written ones.
    """
    answered = aligned_predictions(stage(batch_responses(rows, respond, id_field, batch_size, concurrency), "responses"), fields, id_field=id_field)
    unanswered = without_prediction(rows, answered, id_field)
    retried = aligned_predictions(stage(batch_responses(unanswered, respond, id_field, 1, concurrency), "responses"), fields, id_field=id_field)
    predictions = answered.unionByName(retried).drop("batch")
    if not without_prediction(rows, predictions, id_field).isEmpty():
        raise ValueError("The responder gave no usable prediction for some rows, even one by one.")
    return predictions


def dry_run(rows: DataFrame, fields: Sequence[str] = PREDICTION_FIELDS, id_field: str = "number") -> DataFrame:
    """Empty predictions for every row; no responder is called."""
    return rows.select(id_field, F.lit("dry_run").alias("_status"), *[F.lit(None).cast("string").alias(f) for f in fields])
