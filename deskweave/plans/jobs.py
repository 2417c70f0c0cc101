"""Job graphs: run outcomes, critical paths, delivery times and their forecast.

The graph is a table of edges of any shape and size, and so are the runs. Outcomes are evaluated along it frontier by
frontier (``dag``): one narrow row per run and job, joined with its predecessors once, when the last of them is done.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.operators.joins import broadcast_if_small
from deskweave.plans import dag

# The regional report box. Suffix, predecessors, base minutes, volume sensitive.
REPORT_JOBS = (
    ("INIT", (), 4, False),
    ("EXTRACT_TRANSACTIONS", ("INIT",), 36, True),
    ("EXTRACT_REFERENCE", ("INIT",), 12, False),
    ("EXTRACT_CUSTOMERS", ("INIT",), 20, True),
    ("VALIDATE_TRANSACTIONS", ("EXTRACT_TRANSACTIONS",), 16, True),
    ("ENRICH_DATA", ("VALIDATE_TRANSACTIONS", "EXTRACT_REFERENCE", "EXTRACT_CUSTOMERS"), 25, True),
    ("BUILD_REPORT", ("ENRICH_DATA",), 32, True),
    ("PUBLISH_REPORT", ("BUILD_REPORT",), 8, False),
    ("ARCHIVE", ("PUBLISH_REPORT",), 10, True),
    ("SEND_STATUS", ("PUBLISH_REPORT",), 3, False),
)


@dataclass(frozen=True)
class JobGraph:
    """Predecessors of each job in list order, the delivery milestone and the jobs that end the box."""

    parents: Mapping[object, Sequence[object]]
    milestone: object
    terminals: Sequence[object]

    @cached_property
    def order(self) -> list:
        """Jobs after their predecessors; a cycle raises an error."""
        return list(TopologicalSorter(self.parents).static_order())

    @cached_property
    def levels(self) -> list[list]:
        """Jobs whose predecessors are all in earlier levels."""
        sorter, levels = TopologicalSorter(self.parents), []
        sorter.prepare()
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=self.place)
            levels.append(ready)
            sorter.done(*ready)
        return levels

    def place(self, job: object) -> int:
        return self.order.index(job)


REPORT_GRAPH = JobGraph(
    {name: needs for name, needs, _, _ in REPORT_JOBS}, "PUBLISH_REPORT", ("ARCHIVE", "SEND_STATUS")
)


def job_catalogue(regions: DataFrame, region: str = "region") -> DataFrame:
    """One BOX and its CMD jobs per region; the template list is a literal, so no join is needed."""
    def job(row: tuple) -> Column:
        name, needs, minutes, sensitive = row
        return F.struct(
            F.lit(name).alias("suffix"), F.array(*[F.lit(n) for n in needs]).cast("array<string>").alias("needs"),
            F.lit(minutes).alias("base_duration_minutes"), F.lit(sensitive).alias("volume_sensitive"),
        )

    prefix = F.concat(F.lit("CMD_"), F.col(region).cast("string"), F.lit("_"))
    box = F.concat(F.lit("BOX_SOD_"), F.col(region).cast("string"), F.lit("_REPORTS"))
    commands = regions.select(region, F.inline(F.array(*[job(r) for r in REPORT_JOBS]))).select(
        F.concat(prefix, F.col("suffix")).alias("job_name"), F.lit("CMD").alias("job_type"), box.alias("box_name"),
        F.col(region).cast("string").alias("region"), F.transform("needs", lambda n: F.concat(prefix, n)).alias("dependencies"),
        "base_duration_minutes", "volume_sensitive",
        (F.col("suffix") == REPORT_GRAPH.milestone).alias("delivery_milestone"),
        F.col("suffix").isin(*REPORT_GRAPH.terminals).alias("terminal_for_box"),
    )
    boxes = regions.select(
        box.alias("job_name"), F.lit("BOX").alias("job_type"), F.lit(None).cast("string").alias("box_name"),
        F.col(region).cast("string").alias("region"), F.array().cast("array<string>").alias("dependencies"),
    )
    return boxes.unionByName(commands, allowMissingColumns=True)


def dependency_edges(catalogue: DataFrame) -> DataFrame:
    """(child, parent, place): the place of a predecessor in its job's list."""
    return catalogue.select(F.col("job_name").alias("child"), F.posexplode("dependencies").alias("place", "parent")).select("child", "parent", "place")


def dangling_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with an end that is not a node; empty for a sound graph."""
    edges = edges.select("child", "parent")
    known = nodes.select(F.col(node).alias("_node"))
    lost_child = edges.join(known, F.col("child") == F.col("_node"), "left_anti")
    lost_parent = edges.join(known, F.col("parent") == F.col("_node"), "left_anti")
    return lost_child.unionByName(lost_parent).distinct()


def topological_levels(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Level of each node by peeling ready nodes; raises an error if a cycle is left. ``dag.levels`` returns it as rows."""
    found = dag.levels(nodes, edges, node)
    stuck = found.where("level IS NULL").limit(5).collect()
    if stuck:
        raise ValueError(f"The job graph has a cycle; on or behind it: {[r[0] for r in stuck]}")
    return found


# --- Outcome of finished runs -------------------------------------------------------------------


def command_runs(
    runs: DataFrame, edges: DataFrame, run: str = "region_run_id", job: str = "job_no", carry: Sequence[str] = (), paths: bool = True
) -> DataFrame:
    """One row per job run: status, culprits, times in seconds after the schedule, waits, and the longest path to it.

    ``runs`` gives own_status, queue_wait_seconds, duration_seconds and retry_count per run and job; rows that repeat both
    are folded into one. ``edges`` (child, parent, place) may be any graph. A job with a predecessor that did not succeed is
    BLOCKED, one on or behind a cycle has status CYCLE. Predecessors that a run does not hold are no obstacle.
    """
    own = ["own_status", "queue_wait_seconds", "duration_seconds", "retry_count"]
    # The worst status, and the longest of repeated reports.
    folded = [F.max(F.when(F.col("own_status") == "SUCCESS", "").otherwise("FAILED")).alias("own_status"), *[F.max(c).alias(c) for c in own[1:]]]
    rows = runs.groupBy(run, job).agg(*[F.min(c).alias(c) for c in carry], *folded)
    kind = runs.schema[job].dataType.simpleString()
    reach = "struct<elapsed: bigint, place: int, path: array<%s>>" % kind
    told = {
        "_culprits": (F.array_sort(F.collect_list(F.when(F.col("status") != "SUCCESS", F.struct("place", "parent")))), f"array<struct<place: int, parent: {kind}>>"),
        "_ready": (F.max("end_seconds"), "bigint"),
        "_best": (F.max(F.struct("elapsed_seconds", -F.col("place"), F.col("_path") if paths else F.array().cast(f"array<{kind}>"))), reach),
    }

    def step(here: DataFrame) -> DataFrame:
        stuck = F.col("level") == dag.STUCK
        blocked = F.coalesce(F.size("_culprits") > 0, F.lit(False))
        ran = ~stuck & ~blocked
        work = F.col("queue_wait_seconds") + F.col("duration_seconds")
        start = F.greatest(F.lit(0).cast("bigint"), F.coalesce("_ready", F.lit(0)))
        path = F.when(ran, F.concat(F.coalesce("_best.path", F.array().cast(f"array<{kind}>")), F.array(job))).otherwise(F.array(job))
        status = F.when(stuck, "CYCLE").when(blocked, "BLOCKED").when(F.col("own_status") == "FAILED", "FAILED").otherwise("SUCCESS")
        return here.select(
            run, job, *carry, "level", status.alias("status"), F.array_join(F.transform(F.coalesce("_culprits", F.array()), lambda c: c["parent"].cast("string")), ",").alias("blocked_by"),
            F.when(ran, start).alias("eligible_seconds"), F.when(ran, start + F.col("queue_wait_seconds")).alias("start_seconds"), F.when(ran, start + work).alias("end_seconds"),
            F.when(ran, F.col("duration_seconds")).alias("duration_seconds"), F.when(ran, F.col("retry_count")).otherwise(0).alias("retry_count"),
            F.when(ran, F.coalesce("_best.elapsed", F.lit(0)) + work).otherwise(0).alias("elapsed_seconds"), *([path.alias("_path")] if paths else []),
        )

    done = dag.along(rows, edges, job, [run], told, step)
    if paths:
        done = done.withColumn("path", F.array_join(F.transform("_path", lambda c: c.cast("string")), ">"))
    return done.drop("level", "_path")


def box_runs(commands: DataFrame, jobs: DataFrame, sla_seconds: int, run: str = "region_run_id", job: str = "job_no", carry: Sequence[str] = ()) -> DataFrame:
    """One row per box run from its command runs, by one aggregation.

    ``jobs`` tells per job its place in the list and whether it is the delivery milestone or ends the box. The box succeeds
    only if every job that ends it did. Its critical path ends at the longest of these, or at the longest failed job when
    the box failed; the first in the list on ties.
    """
    ends = jobs.where("terminal").count()
    flags = jobs.select(job, "place", "milestone", "terminal")
    rows = commands.join(broadcast_if_small(flags), job, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("milestone", "terminal")})
    ok = F.col("status") == "SUCCESS"
    longest = F.struct("elapsed_seconds", -F.coalesce("place", F.lit(0)), "path")
    boxes = rows.groupBy(run).agg(
        *[F.min(c).alias(c) for c in carry],
        F.when(F.count_if(F.col("terminal") & ok) == ends, "SUCCESS").otherwise("FAILED").alias("status"),
        F.count_if(ok).cast("int").alias("successful_cmd_count"), F.count_if(F.col("status") == "FAILED").cast("int").alias("failed_cmd_count"),
        F.count_if(F.col("status") == "BLOCKED").cast("int").alias("blocked_cmd_count"), F.sum("retry_count").alias("total_retry_count"),
        F.max("end_seconds").alias("box_duration_seconds"), F.max(F.when(F.col("milestone") & ok, F.col("end_seconds"))).alias("delivery_duration_seconds"),
        F.max(F.when(F.col("terminal"), longest)).alias("_end"), F.max(F.when(F.col("status") == "FAILED", longest)).alias("_failed"),
    )
    return boxes.select(
        run, *carry, "status", "successful_cmd_count", "failed_cmd_count", "blocked_cmd_count", "total_retry_count", "box_duration_seconds",
        "delivery_duration_seconds", F.coalesce(F.col("delivery_duration_seconds") <= sla_seconds, F.lit(False)).alias("delivery_sla_met"),
        F.when(F.col("status") == "SUCCESS", F.col("_end.path")).otherwise(F.col("_failed.path")).alias("critical_path_jobs"),
    )


def with_times(rows: DataFrame, schedule: str, seconds: Mapping[str, str]) -> DataFrame:
    """Timestamps for columns that hold seconds after the schedule."""
    for name, column in seconds.items():
        rows = rows.withColumn(name, F.col(schedule) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(column)))
    return rows


# --- Statistics and forecast --------------------------------------------------------------------


def duration_counts(commands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each whole-second duration occurred: a table that stops growing with the history."""
    done = commands.where(F.col("status") == "SUCCESS")
    return done.groupBy(*keys, "duration_seconds").agg(F.count(F.lit(1)).alias("n"))


def duration_quantiles(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact P50 and P90 from the value counts."""
    both = F.expr("percentile(duration_seconds, array(0.5D, 0.9D), n)")
    return counts.groupBy(*keys).agg(both.alias("_p"), F.sum("n").alias("runs")).select(
        *keys, "runs", F.get("_p", F.lit(0)).alias("p50"), F.get("_p", F.lit(1)).alias("p90")
    )


def failure_rates(commands: DataFrame, keys: Sequence[str]) -> DataFrame:
    ran = commands.where(F.col("status") != "BLOCKED")
    return ran.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg((F.col("status") == "FAILED").cast("int")), 6).alias("failure_rate"),
        F.round(F.avg((F.col("retry_count") > 0).cast("int")), 6).alias("retry_rate"),
    )


def backtest(evaluation: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error of the P50 and coverage of the P90 on runs the quantiles have not seen."""
    joined = evaluation.where(F.col("status") == "SUCCESS").join(quantiles.select(*keys, "p50", "p90"), list(keys))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg(F.abs(F.col("duration_seconds") - F.col("p50"))), 4).alias("mean_absolute_error"),
        F.round(F.avg((F.col("duration_seconds") <= F.col("p90")).cast("int")), 6).alias("p90_coverage"),
    )


def remaining_time(running_jobs: DataFrame, counts: DataFrame, keys: Sequence[str], elapsed: str = "elapsed_seconds") -> DataFrame:
    """P50 and P90 of what is left of running jobs, among past durations longer than the time already spent.

    The running jobs are joined to value counts, not to the history. Zero if no past run was longer.
    """
    longer = F.when(F.col("_duration") > F.col(elapsed), F.col("n")).otherwise(0)
    past = counts.select(*keys, F.col("duration_seconds").alias("_duration"), "n")
    joined = running_jobs.join(past, list(keys), "left").withColumn("_longer", F.coalesce(longer, F.lit(0).cast("bigint")))
    kept = running_jobs.columns
    grouped = joined.groupBy(*kept).agg(F.expr("percentile(_duration, array(0.5D, 0.9D), _longer)").alias("_p"))

    def left(i: int) -> Column:
        return F.coalesce(F.get("_p", F.lit(i)) - F.col(elapsed), F.lit(0.0))

    return grouped.select(*kept, left(0).alias("remaining_p50"), left(1).alias("remaining_p90"))


def live_eta(states: DataFrame, edges: DataFrame, jobs: DataFrame, region: str = "region", job: str = "job_no") -> DataFrame:
    """Delivery and box forecast per region from a snapshot, along any graph.

    ``states`` has, per region and job: status, end_seconds (finished jobs), remaining_p50/p90 (running jobs), p50/p90 (jobs
    not begun), now_seconds and sla_seconds; times count from the schedule. A failed job stops everything after it.
    ``edges`` and ``jobs`` as for the finished runs.
    """
    told = {"_halted": (F.max("halted"), "boolean"), "_p50": (F.max("eta_p50"), "double"), "_p90": (F.max("eta_p90"), "double")}

    def step(here: DataFrame) -> DataFrame:
        halted = F.coalesce("_halted", F.lit(False)) | F.coalesce(F.col("status").isin("FAILED", "BLOCKED"), F.lit(False)) | (F.col("level") == dag.STUCK)
        etas = []
        for p in ("p50", "p90"):
            start = F.greatest(F.greatest("now_seconds", F.lit(0)).cast("double"), F.col(f"_{p}"))
            end = (
                F.when(F.col("status") == "SUCCESS", F.col("end_seconds").cast("double"))
                .when(F.col("status") == "RUNNING", F.col("now_seconds") + F.col(f"remaining_{p}"))
                .otherwise(start + F.col(p))
            )
            etas.append(F.when(~halted, end).alias(f"eta_{p}"))
        return here.select(region, job, "level", "status", "now_seconds", "sla_seconds", halted.alias("halted"), *etas)

    ends = jobs.where("terminal").count()
    rows = dag.along(states, edges, job, [region], told, step).join(broadcast_if_small(jobs.select(job, "place", "milestone", "terminal")), job, "left")

    def any_status(*names: str) -> Column:
        return F.coalesce(F.bool_or(F.col("status").isin(*names)), F.lit(False))

    def first_with(name: str) -> Column:
        return F.min_by(F.when(F.col("status") == name, F.col(job).cast("string")), F.when(F.col("status") == name, F.col("place")))

    complete = F.count_if(F.col("terminal") & (F.col("status") == "SUCCESS")) == ends
    status = (
        F.when(complete, "complete").when(any_status("FAILED"), "failed").when(any_status("BLOCKED"), "blocked")
        .when(any_status("RUNNING"), "running").when(any_status("SUCCESS"), "waiting").otherwise("not_started")
    )
    latest = F.max(F.when((F.col("status") == "RUNNING") & F.col("eta_p50").isNotNull(), F.struct(F.col("eta_p50"), -F.col("place"), F.col(job).cast("string").alias("job"))))
    blocking = F.when(~complete, F.coalesce(first_with("FAILED"), latest["job"], first_with("WAITING"), first_with("NOT_STARTED")))

    def all_ends(p: str) -> Column:
        return F.when(F.count(F.when(F.col("terminal"), F.col(f"eta_{p}"))) == ends, F.max(F.when(F.col("terminal"), F.col(f"eta_{p}"))))

    late = F.col("delivery_p50_seconds")
    return rows.groupBy(region).agg(
        status.alias("status"), blocking.alias("blocking_job"), F.max("sla_seconds").alias("sla"),
        *[F.max(F.when(F.col("milestone"), F.col(f"eta_{p}"))).alias(f"delivery_{p}_seconds") for p in ("p50", "p90")],
        *[all_ends(p).alias(f"box_{p}_seconds") for p in ("p50", "p90")],
    ).select(
        "*",
        F.when(late.isNull() | (late > F.col("sla")), "breach").when(F.col("delivery_p90_seconds") > F.col("sla"), "at_risk").otherwise("on_track").alias("sla_risk"),
    ).drop("sla")


# --- Snapshots and calendars --------------------------------------------------------------------


def overlaid(base: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Patch rows replace the other columns of matching base rows; null is a legal new value."""
    changed = [c for c in patches.columns if c not in keys]
    patch = patches.select(*keys, F.lit(True).alias("_patched"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = base.join(patch, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_patched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns
    ])


def replicated(snapshot: DataFrame, days: Sequence[int], times: Sequence[str], day: str = "day_offset") -> DataFrame:
    """A snapshot repeated for several days with its timestamps moved along; null times stay null."""
    copies = snapshot.withColumn(day, F.explode(F.array(*[F.lit(d) for d in days])))
    for t in times:
        copies = copies.withColumn(t, F.col(t) + F.make_dt_interval(F.col(day)))
    return copies


def business_days(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Weekdays between two dates of one row, with name and Monday/Friday flags."""
    days = bounds.select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5).select(
        "day", F.date_format("day", "EEEE").alias("weekday"), (F.weekday("day") == 0).alias("is_monday"), (F.weekday("day") == 4).alias("is_friday")
    )


def with_holidays(runs: DataFrame, holidays: DataFrame, region: str = "region", day: str = "business_date") -> DataFrame:
    marked = holidays.select(region, day).distinct().withColumn("_holiday", F.lit(True))
    return runs.join(marked, [region, day], "left").withColumn(
        "is_regional_holiday", F.coalesce("_holiday", F.lit(False))
    ).drop("_holiday")


def scheduled_at(day: Column, clock: Column) -> Column:
    """Timestamp of a date and an ``HH:MM`` text."""
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))


def iso_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
