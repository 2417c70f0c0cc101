import json

import pytest
from pyspark.sql import functions as F

from deskweave.operators import evaluate as E
from deskweave.operators import holdout as H
from deskweave.operators import report as P
from deskweave.operators import scoring as N

FIELDS = ["category", "ticket_type", "required_skills", "technology", "support_level", "assignment_group", "agent_action"]
ROWS = [
    ("INC0000001", 1, "common", "Network", "incident", ["VPN", "network troubleshooting"], "VPN", "L2", "Network Support", "diagnose"),
    ("INC0000002", 2, "edge", "Access", "access request", ["identity management"], "Directory", "L1", "Service Desk", "reset"),
    ("INC9999999", 3, "edge", "Other", "incident", ["x"], "Other", "L3", "Other", "other"),
]


def truth(spark):
    columns = ", ".join(f"_expected_{f} {'array<string>' if f == 'required_skills' else 'string'}" for f in FIELDS)
    return spark.createDataFrame(ROWS, f"number string, seq int, _test_scenario string, {columns}")


def responses(spark, change=lambda r: r):
    rows = []
    for number, seq, _, *values in ROWS[:2]:
        payload = change(dict(zip(FIELDS, values)))
        payload["tier"] = payload.pop("support_level", None)
        rows.append((number, seq, "```json\n" + json.dumps({"prediction": payload}) + "\n```"))
    return spark.createDataFrame(rows, "number string, seq int, model_response string")


def scored(spark, predictions):
    parsed = E.parsed_predictions(predictions, FIELDS, kinds={"required_skills": "array<string>"})
    return E.score(truth(spark), parsed, FIELDS, breakdowns=["_test_scenario"])


def test_perfect_predictions(spark):
    rows = scored(spark, responses(spark)).cache()
    assert rows.count() == 2
    assert tuple(P.overall(rows).first()) == (2, 1.0, 1.0)
    fields = P.field_performance(rows).collect()
    assert len(fields) == 7 and all(r["accuracy"] == r["coverage"] == 1.0 for r in fields)
    assert P.scenario_performance(rows).count() == 2 and P.failures(rows, 10).count() == 0
    whole = E.score(truth(spark), E.parsed_predictions(responses(spark), FIELDS, kinds={"required_skills": "array<string>"}), FIELDS, keep_unpredicted=True)
    assert round(P.overall(whole).first()["prediction_coverage"], 4) == 0.6667
    rows.unpersist()


def test_list_order_and_case_do_not_matter_but_values_do(spark):
    def shuffled(r):
        return {**r, "required_skills": [s.upper() for s in reversed(r["required_skills"])], "category": "wrong" if r["category"] == "Access" else r["category"]}

    rows = scored(spark, responses(spark, shuffled))
    got = {r["field"]: r["accuracy"] for r in P.field_performance(rows).collect()}
    assert got["required_skills"] == 1.0 and got["category"] == 0.5
    assert [r["number"] for r in P.failures(rows, 5).collect()] == ["INC0000002"]
    cells = {(r["expected"], r["predicted"]): r["tickets"] for r in P.confusion(rows, "category").collect()}
    assert cells == {("Network", "Network"): 1, ("Access", "wrong"): 1}


def test_existing_null_column_blocks_parsed_value(spark):
    df = responses(spark).withColumn("category", F.lit(None).cast("string"))
    got = {r["field"]: r["coverage"] for r in P.field_performance(scored(spark, df)).collect()}
    assert got["category"] == 0.0 and got["technology"] == 1.0


def test_last_prediction_wins(spark):
    twice = responses(spark).unionByName(spark.createDataFrame([("INC0000001", 9, '{"category":"late"}')], "number string, seq int, model_response string"))
    cells = {r["predicted"] for r in P.confusion(scored(spark, twice), "category").collect()}
    assert cells == {"late", "Access"}


def test_invariants(spark):
    rows = scored(spark, responses(spark))
    assert P.confusion(rows, "category").agg(F.sum("tickets")).first()[0] == rows.count()
    assert P.field_performance(rows).where("accuracy > coverage").count() == 0


def test_alignment(spark):
    batches = spark.createDataFrame([
        ("a", ["INC0000001", "INC0000002"], '{"predictions":[{"category":"x"},{"category":"y"}]}'),
        ("b", ["1", "2"], '{"predictions":[{"number":2,"category":"two"},{"number":2,"category":"again"},{"number":9,"category":"unknown"}]}'),
        ("c", ["7"], "no json"),
    ], "batch string, ids array<string>, response string")
    got = {(r["batch"], r["number"]): (r["category"], r["technology"]) for r in E.aligned_predictions(batches, ["category", "technology"]).collect()}
    assert got == {("a", "INC0000001"): ("x", None), ("a", "INC0000002"): ("y", None), ("b", "2"): ("two", None)}


def test_holdout_hides_truth_and_keeps_id(spark):
    visible = H.visible_rows(truth(spark).withColumn("short", F.lit("s")), "number", ["number"], ["short", "number", "_expected_category", "missing"])
    assert visible.columns == ["number", "short"]
    assert not [c for c in H.visible_rows(truth(spark)).columns if c.startswith("_")]
    assert H.drop_truth(truth(spark)).columns == ["number", "seq", "_test_scenario"]
    df, name = H.with_surrogate_id(truth(spark).unionByName(truth(spark)).withColumn("seq", F.monotonically_increasing_id()))
    assert name == "_evaluation_id" and df.select(name).distinct().count() == 6
    assert H.with_surrogate_id(truth(spark))[1] == "number"
    sample = H.holdout_sample(spark.range(1000).withColumnRenamed("id", "number"), 30)
    again = H.holdout_sample(spark.range(1000, numPartitions=3).withColumnRenamed("id", "number"), 30)
    assert sample.count() == 30 and {r[0] for r in sample.collect()} == {r[0] for r in again.collect()}


def test_scorer_retries_and_fails_loudly(spark):
    rows = spark.createDataFrame([(i,) for i in range(23)], "number long")

    def forgets(batch):
        return json.dumps({"predictions": [{"number": r["number"], "category": str(r["number"] % 2)} for r in batch if len(batch) == 1 or r["number"] % 4]})

    got = {r["number"]: r["category"] for r in N.scored_by(rows, forgets, ["category"], batch_size=7).collect()}
    assert got == {str(i): str(i % 2) for i in range(23)}
    with pytest.raises(ValueError):
        N.scored_by(rows, lambda batch: "nothing", ["category"])
    assert N.dry_run(rows).where("category IS NULL AND _status = 'dry_run'").count() == 23
