import json

import pytest
from pyspark.sql import functions as F

from deskweave.sources import readers as R
from deskweave.sources import schemas as S
from deskweave.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_record_files_of_every_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"number": "1"}, 5, {"number": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"number": "x"}], "tickets": [{"number": "3", "n": 7}]}))
    (tmp_path / "c.json").write_text(json.dumps({"number": "4", "records": "none"}))
    rows = R.records_as(R.read_record_files(spark, str(tmp_path)), "number string, n int")
    assert sorted((r["file"], r["number"], r["n"]) for r in rows.collect()) == [("a.json", "1", None), ("a.json", "2", None), ("b.json", "3", 7), ("c.json", "4", None)]
    (tmp_path / "d.json").write_text("3")
    with pytest.raises(Exception, match="array of objects"):
        R.read_record_files(spark, str(tmp_path)).collect()


def test_csv_with_byte_order_mark_round_trip(spark, tmp_path):
    nation = table(spark, SF, "nation")
    R.write_snapshot(nation, str(tmp_path / "n"), "csv")
    back = R.read_csv_records(spark, str(tmp_path / "n"))
    assert back.count() == nation.count() and back.columns == nation.columns
    (tmp_path / "bom.csv").write_text("﻿number,text\n1,\"a, b\"\n", encoding="utf-8")
    row = R.read_csv_records(spark, str(tmp_path / "bom.csv")).first()
    assert row.asDict() == {"number": "1", "text": "a, b"}
    for kind in ("json", "parquet"):
        R.write_snapshot(nation, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 25
    with pytest.raises(ValueError):
        R.write_snapshot(nation, str(tmp_path / "x"), "xml")


def test_text_files_become_sections(spark, tmp_path):
    (tmp_path / "kb.md").write_text("﻿# One\nalpha\n## Two\nbeta\n", encoding="utf-8")
    (tmp_path / "skip.bin").write_text("# no")
    got = {r["title"]: r["content"] for r in R.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"kb.md section 1": "# One alpha", "kb.md section 2": "## Two beta"}


def test_nested_cases_keep_corrupt_rows_apart(spark, tmp_path):
    case = {"case_id": "V", "ingestion_event": {"observed_at": "x"}, "cve_enrichment": None, "existing_state": {"tickets": []}}
    (tmp_path / "cases.json").write_text(json.dumps([case]))
    row = R.read_cases(spark, str(tmp_path / "cases.json"), S.VULNERABILITY_CASE).first()
    assert row["case_id"] == "V" and row["cve_enrichment"] is None and row["existing_state"]["tickets"] == []
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert R.read_json_lines(spark, str(tmp_path / "lines.json"), "a int").agg(F.sum("a")).first()[0] == 3


def test_several_tables_in_one_file(spark, tmp_path):
    request = {"number": "R1", "fields": {"ports": ["any"]}, "status_events": [{"at": "2026-09-18T08:00:00Z", "state": "Submitted"}]}
    (tmp_path / "t.json").write_text(json.dumps({"requests": [request], "problems": [{"number": "P1"}, {"number": "P2"}]}))
    got = R.read_table_group(spark, str(tmp_path / "t.json"), {"requests": S.SERVICE_REQUEST, "problems": "number string"})
    assert got["problems"].count() == 2
    first = got["requests"].select("number", F.try_variant_get("fields", "$.ports[0]", "string").alias("port"), F.col("status_events")[0]["state"].alias("s")).first()
    assert tuple(first) == ("R1", "any", "Submitted")


def test_reference_examples(spark):
    texts = spark.createDataFrame([(json.dumps({"Net": [{"a": "1"}, {"a": "2", "assignment_group": "Own"}]}),), (json.dumps([{"a": "3"}, 4]),)], "value string")
    got = sorted((r["record"]["a"], r["record"].get("assignment_group")) for r in R.reference_examples(texts).collect())
    assert got == [("1", "Net"), ("2", "Own"), ("3", None)]


def test_field_lists(spark):
    name, schema = S.table_schema("ServiceNow Incident")
    assert name == "incident" and len(schema) == 25 and schema["_expected_required_skills"].dataType.simpleString() == "array<string>"
    assert [len(S.table_schema(p)[1]) for p in S.PRESETS] == [25, 22, 23]
    custom = S.schema_of_fields('[{"name": "a", "type": "integer|null", "description": "d"}, {"name": "b"}]')
    assert custom["a"].dataType.simpleString() == "bigint" and custom["a"].metadata["description"] == "d"
    for bad in ("{", "[]", '[{"type": "string"}]', '[{"name": "a"}, {"name": "a"}]'):
        with pytest.raises(ValueError):
            S.schema_of_fields(bad)
    with pytest.raises(ValueError):
        S.table_schema("Custom", " ", "[]")
    with pytest.raises(ValueError):
        S.table_schema("Other")
