"""What registered queries write and move, on rows of the tests' own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from deskweave import queries as Q
from deskweave.operators import retrieve as T
from deskweave.plans import dag


def _tables(spark, folder):
    rng = random.Random(7)

    def write(name, columns, rows):
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")

    day = "1996-03-01 00:00:00"
    lines = [(o, 1 + rng.randrange(9), 1 + rng.randrange(6), n + 1, float(n), 100.0, 0.05, 0.03, rng.choice("RAN"), rng.choice("OF"), day) for o in range(40) for n in range(1 + o % 5)]
    spark.createDataFrame(lines + lines[:3], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    orders = [(o, 1 + o % 4, "1-URGENT", "O", day) for o in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate string").withColumn(
        "o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    write("part", "p_partkey long, p_brand string, p_size int", [(p, f"Brand#{p % 3}", p) for p in range(10)])
    write("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(s, f"S{s}", s % 3, s - 2.0) for s in range(8)])
    write("customer", "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", [(c, c % 3, "BUILDING" if c == 1 else "AUTO", 1.0) for c in range(6)])
    write("nation", "n_nationkey int, n_name string, n_regionkey int", [(n, f"N{n}", 0) for n in range(3)])
    write("region", "r_regionkey int, r_name string", [(0, "EU")])
    spark.createDataFrame([(e, e % 8, "login", e, day) for e in range(30)], "event_id long, user_id long, event_type string, value long, ts string").withColumn(
        "ts", F.to_timestamp("ts")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_f1_citation_quality_builds_one_index(spark, tmp_path, monkeypatch):
    docs = {1: "Router reset after the outage", 2: "the ROUTER RESET after all", 3: None, 4: "mail server down", 5: ""}
    asked = {1: "router reset after", 2: "mail", 3: "of the", 4: None}
    spark.createDataFrame([(*d, "en", "src1", 1) for d in docs.items()], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    built, index = [], T.matched_index
    monkeypatch.setattr(T, "matched_index", lambda *a, **k: built.append(1) or index(*a, **k))
    got = {r["item_id"]: (r["returned"], r["expected"], r["hits"]) for r in Q.QUERIES["citation_quality"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 2, 2), 2: (1, 1, 1)}
    assert len(built) == 1


def test_f2_finding_decision_writes_what_decisions_need(spark, tmp_path, monkeypatch):
    written, stage = [], Q.stage
    monkeypatch.setattr(Q, "stage", lambda df, label, *a: written.append(df.columns) or stage(df, label, *a))
    sf = _tables(spark, tmp_path)
    rows = Q.QUERIES["finding_decision"](spark, sf).collect()
    assert written and not {"scanner_id", "asset_ref", "component", "installed_version", "cvss_score", "hostname"} & set(written[0])
    assert len(rows) == Q.view(spark, sf, "v_findings").count() and {"CREATE_TICKET", "UPDATE_EXISTING"} & {r["decision"] for r in rows}


def test_f4_withheld_objects_spreads_its_pairs(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    found = Q.QUERIES["withheld_objects"](spark, sf)
    every = Q._access_objects(spark, sf).where(~F.coalesce("visible", F.lit(False))).select("request_id", "account_id").collect()
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(set(map(tuple, every))) and len(got) < len(every)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_f5_topo_levels_writes_keys_and_each_level_once(spark, tmp_path, monkeypatch):
    written, stage = [], Q.stage
    monkeypatch.setattr(Q, "stage", lambda df, label, *a: written.append((label, df.columns)) or stage(df, label, *a))
    got = {r["node"]: r["level"] for r in Q.QUERIES["topo_levels"](spark, _tables(spark, tmp_path)).collect()}
    assert ("runs", ["region_run_id", "job_no"]) in written
    assert (got["4:1"], got["4:2"], got["4:3"], got["4:4"], got["4:5"]) == (0, 1, 1, 2, 3)


def test_f5_repeated_edges_and_levels_written_once(spark, monkeypatch):
    labels, stage = [], dag.stage
    monkeypatch.setattr(dag, "stage", lambda df, label, *a: labels.append(label) or stage(df, label, *a))
    nodes = spark.createDataFrame([(n,) for n in "aabcdxyz"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "y")], "child string, parent string")
    got = {r["node"]: r["level"] for r in dag.levels(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None, "z": None}
    assert labels.count("ready") == 3


def test_f3_ranking_counts_words_within_texts_and_few_of_a_phrase(spark, tmp_path, monkeypatch):
    phrase = "north router reset after outage again and mail server down"
    docs = [(1, phrase), (2, "mail server down, router reset after outage again"), (2, "router"), (3, None), (4, ""), (5, "the of"), (None, phrase.upper() + " " + phrase), (6, "again outage after reset router")]
    asked = [(1, phrase), (2, "router"), (3, "again nowhere else at all"), (4, None)]
    spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, questions = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    index, words, written, stage = {}, [], [], T.stage
    for small in (True, False):
        index[small] = T.matched_index(read, "doc_id", F.col("text"), questions, "item_id", "text", small)
    assert sorted(map(str, index[True].collect())) == sorted(map(str, index[False].collect())) and index[True].schema == index[False].schema

    def noted(df, label, *a):
        written.append(label)
        if label == "phrase-words":
            words.extend(tuple(r) for r in df.collect())
        if label == "index":
            assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, label, *a)

    monkeypatch.setattr(T, "stage", noted)
    ranked = [tuple(r) for r in T.best(read, questions, 3, text=F.col("text")).select("item_id", "doc_id", "rank").collect()]
    assert max(sum(w[0] == i for w in words) for i in (1, 3)) == T.RAREST and "bounds" in written
    monkeypatch.setattr(T, "stage", stage)
    plain = T.top_k(T.scored_pairs(read, questions, text=F.col("text")), 3).select("item_id", "doc_id", "rank")
    assert sorted(map(str, ranked)) == sorted(str(tuple(r)) for r in plain.collect()) and len(ranked) > 5
    hits = T.phrase_hits(read, "doc_id", F.col("text"), questions.where("item_id = 1"), "item_id", "text", phrase=F.lower("text"))
    assert sorted(r["doc_id"] or 0 for r in hits.collect()) == [1]
