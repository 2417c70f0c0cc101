"""Order-dependent operators against plain Python, with one key holding a third of the rows."""

import random

from pyspark.sql import functions as F

from deskweave.operators import ordering as O
from deskweave.operators import timeline as L

ROWS = 600


def hot_rows(seed=7):
    rnd = random.Random(seed)
    return [(i, 0 if rnd.random() < 0.34 else rnd.randrange(1, 9), rnd.randrange(0, 200), rnd.randrange(1, 50)) for i in range(ROWS)]


def frame(spark):
    return spark.createDataFrame(hot_rows(), "id long, k int, t int, v int")


def test_numbered_whole_table_and_per_key(spark):
    got = {r["id"]: r["position"] for r in O.numbered(frame(spark), ["t", "id"]).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(hot_rows(), key=lambda r: (r[2], r[0])), 1)}
    assert got == want
    got = {r["id"]: r["position"] for r in O.numbered(frame(spark), ["t", "id"], keys=["k"]).collect()}
    want, seen = {}, {}
    for r in sorted(hot_rows(), key=lambda r: (r[2], r[0])):
        seen[r[1]] = want[r[0]] = seen.get(r[1], 0) + 1
    assert got == want


def test_hot_key_spreads_over_slices(spark):
    slices = O.sliced(frame(spark), ["k"], ["t", "id"], 8)
    assert slices.where("k = 0").select(O.SLICE).distinct().count() >= 2


def test_running_sum_and_max(spark):
    df = O.sliced(frame(spark), ["k"], ["t", "id"], 8)
    got = {r["id"]: (r["s"], r["m"]) for r in O.running(df, ["k"], ["t", "id"], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    sums, peaks, want = {}, {}, {}
    for i, k, _, v in sorted(hot_rows(), key=lambda r: (r[2], r[0])):
        sums[k], peaks[k] = sums.get(k, 0) + v, max(peaks.get(k, 0), v)
        want[i] = (sums[k], peaks[k])
    assert got == want


def test_first_rows_large_limit_equals_top_k(spark):
    heap = {r["id"] for r in O.first_rows(frame(spark), ["t", "id"], 100).collect()}
    ranged = {r["id"] for r in O.first_rows(frame(spark), ["t", "id"], 100, heap_limit=10).collect()}
    assert heap == ranged


def test_rolling_mean_across_chunk_edges(spark):
    got = {r["id"]: r["m"] for r in L.rolling_mean(frame(spark), ["k"], ["t", "id"], "v", 3, "m", chunk_rows=10).collect()}
    past, want = {}, {}
    for i, k, _, v in sorted(hot_rows(), key=lambda r: (r[2], r[0])):
        last = past.setdefault(k, [])[-3:]
        want[i] = sum(last) / len(last) if last else None
        past[k].append(v)
    assert got == want


def test_next_event_across_chunk_edges(spark):
    df = frame(spark).withColumn("at", F.timestamp_seconds(F.col("t") * 60))
    got = {r["id"]: r["seconds_in_state"] for r in L.with_next_event(df, "k", "at", "id", chunk_rows=7).collect()}
    by_key, want = {}, {}
    for r in sorted(hot_rows(), key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    for rows in by_key.values():
        for a, b in zip(rows, rows[1:] + [None]):
            want[a[0]] = (b[2] - a[2]) * 60 if b else None
    assert got == want


def test_trailing_counts_closed_interval(spark):
    df = frame(spark).withColumn("at", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.col("t")))
    got = {(r["k"], r["t"]): r["n"] for r in L.trailing_counts(df.withColumn("t2", F.col("t")), ["k"], "at", 30, "n")
           .withColumn("t", F.datediff("at", F.to_date(F.lit("2024-01-01")))).collect()}
    rows = hot_rows()
    want = {(k, t): sum(1 for r in rows if r[1] == k and t - 30 <= r[2] <= t) for _, k, t, _ in rows}
    assert got == want


def test_latest_by_first_and_last(spark):
    last = {r["k"]: r["id"] for r in O.latest_by(frame(spark), ["k"], "id").collect()}
    first = {r["k"]: r["id"] for r in O.latest_by(frame(spark), ["k"], "id", last=False).collect()}
    rows = hot_rows()
    assert last == {k: max(r[0] for r in rows if r[1] == k) for k in {r[1] for r in rows}}
    assert first == {k: min(r[0] for r in rows if r[1] == k) for k in {r[1] for r in rows}}
