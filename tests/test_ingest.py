import random

import pytest
from pyspark.sql import functions as F

from deskweave.operators import ingest as I
from deskweave.sources.stores import DatasetStore, input_signature, row_key, uncached, with_cached


def repaired_one_by_one(rows):
    """First holders keep their number; the others take base + position or the next number nobody has."""
    taken, keep = set(), set()
    for seq, number in rows:
        if number and number not in taken:
            taken.add(number)
            keep.add(seq)
    out = {}
    for position, (seq, number) in enumerate(rows, 1):
        if seq not in keep:
            n = 1_000_000 + position
            while f"INC{n:07d}" in taken:
                n += 1
            number = f"INC{n:07d}"
            taken.add(number)
        out[seq] = number
    return out


def test_key_repair_equals_sequential_rule(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        kind = rnd.random()
        number = None if kind < 0.3 else "" if kind < 0.35 else f"INC{1_000_000 + rnd.randrange(1, 420):07d}" if kind < 0.8 else f"INC{rnd.randrange(5)}"
        rows.append((i, number))
    df = spark.createDataFrame(rows, "seq long, number string")
    got = {r["seq"]: r["number"] for r in I.repaired_numbers(df, "incident").collect()}
    assert got == repaired_one_by_one(rows)
    assert len(set(got.values())) == len(rows)


def test_key_repair_without_clash(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "seq long, number string")
    got = [r["number"] for r in I.repaired_numbers(df, "sc_request").orderBy("seq").collect()]
    assert got == ["A", "REQ1000002", "REQ1000003"]


def test_exact_distinct_with_a_third_copies(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    kept = {r["seq"] for r in I.exact_distinct(spark.createDataFrame(rows, "seq long, text string"), "seq").collect()}
    assert kept == {0} | {i for i in range(300) if i % 3}


def test_response_cap_and_objects_only(spark):
    df = spark.createDataFrame([(1, 2, '{"records":[{"a":1},3,{"a":2},{"a":3}]}'), (2, 5, "cut off {")], "seq long, requested int, response string")
    assert [(r["seq"], r["place"]) for r in I.response_records(df).orderBy("seq", "place").collect()] == [(1, 0), (1, 1)]


def test_resume_union_caps_and_prefers_stored(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, text string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (3, "d")], "seq long, text string")
    assert [r["text"] for r in I.resume_union(stored, new, "seq", 3).orderBy("text").collect()] == ["a", "b", "c"]


def test_continuity_and_recent(spark):
    df = spark.createDataFrame([(i, f"INC{i:07d}", "Network" if i % 2 else "Access", "x" * 300) for i in range(1, 26)], "seq long, number string, category string, state string")
    got = I.continuity_summary(df).first()
    assert (got["generated_so_far"], got["first_record_number"], got["latest_record_number"]) == (25, "INC0000001", "INC0000025")
    recent = I.recent_records(df, 3).collect()
    assert {r["number"] for r in recent} == {"INC0000023", "INC0000024", "INC0000025"} and len(recent[0]["state"]) == 160
    assert I.recent_records(df, 0).count() == 0
    top = {(r["field"], r["label"]): r["records"] for r in I.field_distribution(df).collect()}
    assert top[("category", "Network")] == 13 and top[("state", "x" * 100)] == 25


def test_rotating_examples_wrap(spark):
    examples = spark.createDataFrame([(i, f"e{i}") for i in range(1, 6)], "position long, name string")
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_no long")
    got = {}
    for r in I.rotating_examples(batches, examples, 2).orderBy("batch_no", "place").collect():
        got.setdefault(r["batch_no"], []).append(r["name"])
    assert got == {1: ["e1", "e2"], 2: ["e3", "e4"], 3: ["e5", "e1"]}


def test_redaction_at_depth(spark):
    df = spark.sql("SELECT 'a@b.example.org' AS note, named_struct('Caller', 'Ann', 'tags', array('x@y.example.org')) AS about, array('s1') AS secret")
    got = I.redacted(df, ["caller", "SECRET"]).first()
    assert got["note"] == "[REDACTED_EMAIL]" and got["about"]["Caller"] == "[REDACTED_CALLER]"
    assert got["about"]["tags"] == ["[REDACTED_EMAIL]"] and got["secret"] == "[REDACTED_SECRET]"


def test_redaction_of_map_values(spark):
    df = spark.sql("""SELECT map('caller_id', 'Ann', 'note', 'a@b.example.org', 'none', CAST(NULL AS string)) AS kept, map('Caller_ID', 7, 'n', 8) AS numbers,
      map('x', named_struct('caller_id', 'Ann', 'n', 1)) AS nested, map(1, 'c@d.example.org') AS by_number, CAST(NULL AS map<string, string>) AS missing""")
    got = I.redacted(df, ["caller_id"]).first()
    assert got["kept"] == {"caller_id": "[REDACTED_CALLER_ID]", "note": "[REDACTED_EMAIL]", "none": None}
    assert got["numbers"] == {"Caller_ID": None, "n": 8} and got["nested"]["x"]["caller_id"] == "[REDACTED_CALLER_ID]"
    assert got["by_number"] == {1: "[REDACTED_EMAIL]"} and got["missing"] is None


def test_variants_are_not_passed_in_clear(spark):
    df = spark.sql("SELECT parse_json('{\"caller_id\": \"Ann\"}') AS body")
    assert I.redacted(df, ["body"]).first()["body"] == "[REDACTED_BODY]"
    with pytest.raises(TypeError):
        I.redacted(df, ["caller_id"])


def test_store_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "number long, text string")
    store = DatasetStore(str(tmp_path / "store"), df.schema)
    signature, other = input_signature([("goal", "x")]), input_signature([("goal", "y")])
    assert store.load(spark, signature).count() == 0
    store.append(df, signature)
    store.append(spark.createDataFrame([(3, "c")], df.schema), signature)
    assert store.load(spark, signature).count() == 3 and store.load(spark, other).count() == 0
    cache = df.where("number = 1").select(row_key(df.columns, "s").alias("cache_key"), F.lit("1").alias("quality"))
    fresh = uncached(df, cache, df.columns, "s")
    assert [r["number"] for r in fresh.collect()] == [2]
    assert uncached(df, cache, df.columns, "other settings").count() == 2
    assert with_cached(df, cache, fresh.select("cache_key", F.lit("0").alias("quality")), df.columns, "s").count() == 2
