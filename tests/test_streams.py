"""Several files as micro-batches, restarts and repeated keys."""

from pyspark.sql import functions as F

from deskweave.streaming import streams as M


def feed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{folder}/{name}")


SCHEMA = "id long, k int, ts long, state string"


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/*").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_restart_processes_only_new_files(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, "a", [(1, 0, 10, "new"), (2, 0, 20, "open")], SCHEMA)
    first = M.drain_appends(stream(spark, folder).select("id", "state"), place)
    assert first.count() == 2
    assert M.drain_appends(stream(spark, folder).select("id", "state"), place).count() == 2
    feed(spark, folder, "b", [(3, 1, 30, "open")], SCHEMA)
    assert {r["id"] for r in M.drain_appends(stream(spark, folder).select("id", "state"), place).collect()} == {1, 2, 3}


def test_repeated_key_has_no_second_effect_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, "a", [(1, 7, 100, "x"), (2, 7, 110, "x")], SCHEMA)
    feed(spark, folder, "b", [(3, 7, 120, "x"), (4, 8, 130, "x")], SCHEMA)
    kept = M.first_events(stream(spark, folder), "k", "ts", "1 hour").select("k")
    assert sorted(r["k"] for r in M.drain_appends(kept, str(tmp_path / "out")).collect()) == [7, 8]


def test_running_state_over_micro_batches(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, "a", [(1, 1, 100, "new"), (2, 2, 105, "new"), (3, 1, 90, "old")], SCHEMA)
    feed(spark, folder, "b", [(4, 1, 200, "done"), (5, 2, 50, "late")], SCHEMA)

    def drain():
        return M.drain_changes(M.running_latest(stream(spark, folder), ["k"], "ts", "id", ["state"]), place)["table"]

    assert {r["k"]: r["state"] for r in M.newest_changes(drain(), ["k"]).collect()} == {1: "done", 2: "new"}
    feed(spark, folder, "c", [(6, 2, 300, "done")], SCHEMA)
    assert {r["k"]: r["state"] for r in M.newest_changes(drain(), ["k"]).collect()} == {1: "done", 2: "done"}


def test_growing_source_lists(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, "a", [(1, 1, 1, "VF-1"), (2, 2, 2, "VF-1"), (1, 1, 3, "VF-1")], SCHEMA)
    feed(spark, folder, "b", [(1, 1, 4, "VF-1"), (9, 1, 5, "VF-2")], SCHEMA)
    findings = stream(spark, folder).select(F.col("state").alias("canonical_finding_id"), F.concat(F.lit("SCN-"), F.col("k").cast("string")).alias("scanner_id"), F.col("id").alias("event_id"))
    got = M.drain_appends(M.merged_sources(findings), str(tmp_path / "out")).collect()
    assert sorted((r[0], r[1]) for r in got) == [("VF-1", "SCN-1:1"), ("VF-1", "SCN-2:2"), ("VF-2", "SCN-1:9")]


def test_keyed_table_stays_small_and_repeats_nothing(spark, tmp_path):
    """Many micro-batches over few keys: each bucket is kept in two versions at most, and a batch done twice counts once."""
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(6):
        feed(spark, folder, f"f{n}", [(n * 10 + k, k, 100 * n + k, f"s{n}") for k in range(4)], SCHEMA)

    def drain():
        return M.drain_latest(stream(spark, folder), place, ["k"], "ts", "id", ["state"])

    assert {r["k"]: r["state"] for r in drain().collect()} == {k: "s5" for k in range(4)}
    versions = M._versions(spark, f"{place}/table")
    kept = sum(spark.read.parquet(f"{place}/table/{M.BATCH}={n}").count() for n in versions)
    assert kept <= 2 * 4 and len(versions) <= 2
    feed(spark, folder, "late", [(99, 1, 5, "old"), (98, 9, 1, "new")], SCHEMA)
    assert {r["k"]: r["state"] for r in drain().collect()} == {**{k: "s5" for k in range(4)}, 9: "new"}
    # An unfinished batch is not read, and its retry replaces it.
    latest = max(M._versions(spark, f"{place}/table"))
    spark.createDataFrame([(1, 1, "broken")], "k int, id long, state string").write.parquet(f"{place}/table/{M.BATCH}={latest + 1}")
    M.delete_folder(spark, f"{place}/table/{M.BATCH}={latest + 1}/_SUCCESS")
    feed(spark, folder, "last", [(100, 1, 9000, "end")], SCHEMA)
    assert {r["k"]: r["state"] for r in drain().collect()} == {**{k: "s5" for k in range(4)}, 1: "end", 9: "new"}


def test_keyed_table_of_an_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, "a", [], SCHEMA)
    assert M.drain_latest(stream(spark, folder), str(tmp_path / "out"), ["k"], "ts", "id", ["state"]).count() == 0


def test_sources_without_state(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, "a", [(1, 1, 1, "VF-1"), (2, 2, 2, "VF-1"), (1, 1, 3, "VF-1"), (4, 4, 4, None)], SCHEMA)
    feed(spark, folder, "b", [(1, 1, 4, "VF-1"), (9, 1, 5, "VF-2")], SCHEMA)
    findings = stream(spark, folder).select(F.col("state").alias("canonical_finding_id"), F.concat(F.lit("SCN-"), F.col("k").cast("string")).alias("scanner_id"), F.col("id").alias("event_id"))
    got = M.drain_sources(findings, place).collect()
    assert sorted((r[0], r[1]) for r in got) == [("VF-1", "SCN-1:1"), ("VF-1", "SCN-2:2"), ("VF-2", "SCN-1:9")]
    assert not (tmp_path / "out" / "progress" / "state").exists()
