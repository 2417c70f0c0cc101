import random

import pytest
from pyspark.sql import functions as F

from deskweave.plans import dag
from deskweave.plans import jobs as J


def test_catalogue_and_integrity(spark):
    regions = spark.createDataFrame([("APAC",), ("EMEA",), ("AMER",)], "region string")
    rows = J.job_catalogue(regions)
    assert rows.count() == 33 and rows.where("job_type = 'BOX'").count() == 3
    enrich = rows.where("job_name = 'CMD_EMEA_ENRICH_DATA'").first()
    assert enrich["dependencies"] == ["CMD_EMEA_VALIDATE_TRANSACTIONS", "CMD_EMEA_EXTRACT_REFERENCE", "CMD_EMEA_EXTRACT_CUSTOMERS"]
    edges = J.dependency_edges(rows)
    assert edges.count() == 33 and J.dangling_edges(edges, rows, "job_name").count() == 0
    levels = {r["job_name"]: r["level"] for r in J.topological_levels(rows.where("job_type = 'CMD'"), edges, "job_name").collect()}
    assert levels["CMD_APAC_INIT"] == 0 and levels["CMD_APAC_ENRICH_DATA"] == 3 and levels["CMD_APAC_SEND_STATUS"] == 6
    assert [len(level) for level in J.REPORT_GRAPH.levels] == [1, 3, 1, 1, 1, 1, 2]


def test_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        J.topological_levels(nodes, edges)
    assert J.dangling_edges(spark.createDataFrame([("a", "z")], "child string, parent string"), nodes).count() == 1


def test_cycles_are_rows(spark):
    """Nodes on a cycle and behind it have no level; the others have theirs."""
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("c", "d"), ("e", "d"), ("e", "a"), ("f", "a"), ("f", "b"), ("f", "b"), ("f", "unknown")], "child string, parent string")
    assert {r["node"]: r["level"] for r in dag.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": None, "d": None, "e": None, "f": 2, "g": 0}
    assert dag.levels(nodes.limit(0), edges.limit(0)).count() == 0
    loop = spark.createDataFrame([("a", "a")], "child string, parent string")
    assert {r["node"]: r["level"] for r in dag.levels(nodes.where("node < 'c'"), loop).collect()} == {"a": None, "b": 0}


def test_any_graph(spark):
    """Random graphs with a cycle in one corner: every run row comes back, evaluated as by hand; jobs without edges too."""
    rng = random.Random(5)
    parents = {j: tuple(sorted(rng.sample(range(1, j), min(j - 1, rng.randrange(0, 4))))) for j in range(1, 26)}
    graph = J.JobGraph(parents, milestone=20, terminals=(23, 24))
    runs = {i: one_run(rng, graph) for i in range(20)}
    rows = [(i, n, "FAILED" if f else "SUCCESS", q, d, r) for i, run in runs.items() for n, (f, q, d, r) in run.items()]
    rows += [(i, n, "SUCCESS", 1, 2, 0) for i in runs for n in (30, 31, 32, 99)]
    rows.append(rows[0])
    edges = [(j, p, k) for j, ps in parents.items() for k, p in enumerate(ps)] + [(30, 31, 0), (31, 30, 0), (32, 31, 0), (31, 3, 1), (77, 78, 0)]
    df = spark.createDataFrame(rows, "region_run_id int, job_no int, own_status string, queue_wait_seconds long, duration_seconds long, retry_count int")
    got = {(r["region_run_id"], r["job_no"]): r for r in J.command_runs(df, spark.createDataFrame(edges, "child int, parent int, place int")).collect()}
    assert len(got) == len(set((r[0], r[1]) for r in rows))
    for i, run in runs.items():
        want = by_hand(run, graph)
        for n, w in want.items():
            g = got[(i, n)]
            blocked = ",".join(str(p) for p in w["blocked_by"])
            assert (g["status"], g["blocked_by"], g["end_seconds"], g["elapsed_seconds"], g["path"]) == (w["status"], blocked, w["end"], w["elapsed"], ">".join(map(str, w["path"])))
        assert [got[(i, n)]["status"] for n in (30, 31, 32, 99)] == ["CYCLE"] * 3 + ["SUCCESS"] and got[(i, 30)]["end_seconds"] is None
    assert J.command_runs(df.limit(0), spark.createDataFrame(edges, "child int, parent int, place int")).count() == 0


def graph_tables(spark, graph):
    """The graph as the operators take it: edges, and jobs with their flags."""
    edges = [(job, parent, place) for job in graph.order for place, parent in enumerate(graph.parents[job])]
    jobs = [(job, graph.place(job), job == graph.milestone, job in graph.terminals) for job in graph.order]
    return spark.createDataFrame(edges, "child string, parent string, place int"), spark.createDataFrame(jobs, "job_no string, place int, milestone boolean, terminal boolean")


def one_run(rng, graph):
    return {name: (rng.random() < 0.12, rng.randrange(0, 100), rng.randrange(60, 3000), rng.randrange(2)) for name in graph.order}


def by_hand(run, graph):
    out = {}
    for name in graph.order:
        failed, queue, duration, retry = run[name]
        bad = [p for p in graph.parents[name] if out[p]["status"] != "SUCCESS"]
        if bad:
            out[name] = {"status": "BLOCKED", "blocked_by": bad, "end": None, "elapsed": 0, "path": [name]}
            continue
        best = None
        for p in graph.parents[name]:
            if best is None or out[p]["elapsed"] > out[best]["elapsed"]:
                best = p
        start = max([0, *[out[p]["end"] for p in graph.parents[name]]]) + queue
        elapsed = (out[best]["elapsed"] if best else 0) + queue + duration
        out[name] = {"status": "FAILED" if failed else "SUCCESS", "blocked_by": [], "end": start + duration, "elapsed": elapsed,
                     "path": [*(out[best]["path"] if best else []), name]}
    return out


def test_outcomes_and_boxes_against_plain_python(spark):
    rng, graph = random.Random(11), J.REPORT_GRAPH
    runs = {i: one_run(rng, graph) for i in range(60)}
    rows = [(i, n, "FAILED" if f else "SUCCESS", q, d, r) for i, run in runs.items() for n, (f, q, d, r) in run.items()]
    df = spark.createDataFrame(rows, "region_run_id int, job_no string, own_status string, queue_wait_seconds long, duration_seconds long, retry_count int")
    edges, jobs = graph_tables(spark, graph)
    commands = J.command_runs(df, edges)
    got = {(r["region_run_id"], r["job_no"]): r for r in commands.collect()}
    assert len(got) == commands.count() == len(rows)
    boxes = {r["region_run_id"]: r for r in J.box_runs(commands, jobs, 9000).collect()}
    for i, run in runs.items():
        want = by_hand(run, graph)
        for name, w in want.items():
            g = got[(i, name)]
            assert (g["status"], g["blocked_by"], g["end_seconds"], g["elapsed_seconds"], g["path"]) == (w["status"], ",".join(w["blocked_by"]), w["end"], w["elapsed"], ">".join(w["path"]))
        good = all(want[t]["status"] == "SUCCESS" for t in graph.terminals)
        ends = list(graph.terminals) if good else [n for n in graph.order if want[n]["status"] == "FAILED"]
        longest = max(ends, key=lambda n: want[n]["elapsed"])
        box = boxes[i]
        assert box["status"] == ("SUCCESS" if good else "FAILED") and box["critical_path_jobs"] == ">".join(want[longest]["path"])
        assert box["box_duration_seconds"] == max(w["end"] for w in want.values() if w["end"] is not None)
        delivered = want["PUBLISH_REPORT"]["end"] if want["PUBLISH_REPORT"]["status"] == "SUCCESS" else None
        assert box["delivery_duration_seconds"] == delivered and box["delivery_sla_met"] == (delivered is not None and delivered <= 9000)


def test_live_eta_of_a_morning(spark):
    """One region complete, one with a long extract running, one not begun, one failed."""
    graph, minutes = J.REPORT_GRAPH, {n: m for n, _, m, _ in J.REPORT_JOBS}
    done = {"INIT": 300, "EXTRACT_REFERENCE": 1140, "EXTRACT_CUSTOMERS": 1680}
    rows = []
    for n in graph.order:
        p50, p90 = float(minutes[n] * 60), float(minutes[n] * 90)
        rows.append(("APAC", n, "SUCCESS", 8400 if n in graph.terminals else 7680, None, None, p50, p90, 20700, 10800))
        state = "SUCCESS" if n in done else "RUNNING" if n == "EXTRACT_TRANSACTIONS" else "WAITING"
        left = 600.0 if state == "RUNNING" else None
        rows.append(("EMEA", n, state, done.get(n), left, left and left * 2, p50, p90, 6300, 10800))
        rows.append(("AMER", n, "NOT_STARTED", None, None, None, p50, p90, -18900, 12000))
        rows.append(("FAIL", n, "FAILED" if n == "VALIDATE_TRANSACTIONS" else "SUCCESS" if graph.place(n) < graph.place("VALIDATE_TRANSACTIONS") else "BLOCKED", 100, None, None, p50, p90, 6300, 10800))
    df = spark.createDataFrame(rows, "region string, job_no string, status string, end_seconds int, remaining_p50 double, remaining_p90 double, p50 double, p90 double, now_seconds int, sla_seconds int")
    edges, jobs = graph_tables(spark, graph)
    got = {r["region"]: r for r in J.live_eta(df, edges, jobs).collect()}
    assert got["APAC"]["status"] == "complete" and got["APAC"]["blocking_job"] is None and got["APAC"]["delivery_p50_seconds"] == 7680
    emea = got["EMEA"]
    assert emea["status"] == "running" and emea["blocking_job"] == "EXTRACT_TRANSACTIONS"
    assert emea["delivery_p50_seconds"] == 6300 + 600 + (16 + 25 + 32 + 8) * 60 and emea["box_p50_seconds"] == emea["delivery_p50_seconds"] + 600
    assert emea["sla_risk"] == "breach"
    amer = got["AMER"]
    assert amer["status"] == "not_started" and amer["delivery_p50_seconds"] == (4 + 36 + 16 + 25 + 32 + 8) * 60 and amer["sla_risk"] == "on_track"
    assert got["FAIL"]["status"] == "failed" and got["FAIL"]["blocking_job"] == "VALIDATE_TRANSACTIONS" and got["FAIL"]["delivery_p50_seconds"] is None


def test_quantiles_and_remaining_time(spark):
    history = [60] * 5 + [120] * 3 + [600]
    counts = J.duration_counts(spark.createDataFrame([("J", d, "SUCCESS") for d in history] + [("J", 9999, "FAILED")], "job string, duration_seconds long, status string"), ["job"])
    row = J.duration_quantiles(counts, ["job"]).first()
    assert (row["runs"], row["p50"]) == (9, 60.0)
    running = spark.createDataFrame([("J", 100), ("J", 700)], "job string, elapsed_seconds long")
    got = {r["elapsed_seconds"]: r["remaining_p50"] for r in J.remaining_time(running, counts, ["job"]).collect()}
    assert got == {100: 20.0, 700: 0.0}


def test_calendar_and_snapshots(spark):
    bounds = spark.sql("SELECT DATE'2026-07-27' AS a, DATE'2026-09-18' AS b")
    days = J.business_days(bounds, "a", "b")
    assert days.count() == 40 and days.where("is_monday").count() == 8
    base = spark.sql("SELECT 'j1' AS job, 'RUNNING' AS status, TIMESTAMP'2026-09-21 04:36:00' AS started UNION ALL SELECT 'j2', 'WAITING', NULL")
    patch = spark.sql("SELECT 'j1' AS job, CAST(NULL AS string) AS status")
    got = {r["job"]: r["status"] for r in J.overlaid(base, patch, ["job"]).collect()}
    assert got == {"j1": None, "j2": "WAITING"}
    copies = J.replicated(base, (0, 1, 2), ["started"])
    assert copies.count() == 6 and copies.where("started IS NULL").count() == 3
    row = spark.range(1).select(J.scheduled_at(F.lit("2026-09-21"), F.lit("04:30")).alias("t"), J.scheduled_at(F.lit("bad"), F.lit("x")).alias("n")).first()
    assert str(row["t"]) == "2026-09-21 04:30:00" and row["n"] is None
    assert spark.sql("SELECT TIMESTAMP'2026-09-21 04:30:00' AS t").select(J.iso_text(F.col("t"))).first()[0] == "2026-09-21T04:30:00Z"
