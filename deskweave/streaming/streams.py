"""Streaming forms of the event-shaped rules. Each has a batch form that defines its result.

Results that only grow are appended. Running results go to a keyed table: its rows lie in buckets of their keys, a
micro-batch writes new versions of the buckets it touches into its own folder, and readers take each bucket's last
committed version. A repeated batch overwrites its own folder, so it leaves no second copy; versions that two newer
ones have replaced are deleted, so the table holds a small multiple of its current rows, however long the stream.
Rules without a watermark keep what they must remember in that table, not in executors' state. Nothing passes
through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from deskweave.operators.ordering import latest_by
from deskweave.operators.staging import delete_folder, folders, is_committed
from deskweave.plans import vulnerability as V

BATCH, BUCKET = "batch_id", "bucket"
BUCKETS = 32  # of a keyed table, unless told otherwise


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files (or one named file in it) as a stream."""
    schema = spark.read.parquet(os.path.join(folder, f"{name}.parquet")).schema
    return file_stream(spark, folder, schema, f"{name}.parquet", files_per_batch)


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain_appends(stream: DataFrame, place: str) -> DataFrame:
    """Process what is available, append to a Parquet table, return that table. Restarts continue."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/table").option(
        "checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/table")


def drain_changes(stream: DataFrame, place: str, outputs: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, mode: str = "update") -> dict[str, DataFrame]:
    """Process what is available into change logs: one per output, one folder per micro-batch."""
    spark = stream.sparkSession
    outputs = outputs or {"table": lambda batch: batch}

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist() if len(outputs) > 1 else batch
        for name, pick in outputs.items():
            pick(kept).write.mode("overwrite").parquet(f"{place}/{name}/{BATCH}={batch_id}")
        if len(outputs) > 1:
            kept.unpersist()

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return {name: spark.read.parquet(f"{place}/{name}") for name in outputs}


def newest_changes(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows of a change log."""
    return latest_by(log, keys, BATCH).drop(BATCH)


def _versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """Committed micro-batches of a keyed table, oldest first."""
    found = [(int(f.rpartition("=")[2]), f) for f in folders(spark, path) if f.rpartition("/")[2].startswith(f"{BATCH}=")]
    return sorted(n for n, f in found if (below is None or n < below) and is_committed(spark, f))


def current_rows(spark: SparkSession, path: str, schema: StructType, below: int | None = None) -> DataFrame:
    """The rows of a keyed table, each bucket as its last committed micro-batch left it; none before the first one."""
    versions = _versions(spark, path, below)
    if not versions:
        return spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    reader = spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())]))
    parts = [reader.parquet(f"{path}/{BATCH}={n}").withColumn(BATCH, F.lit(n)) for n in versions]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    newest = rows.groupBy(BUCKET).agg(F.max(BATCH).alias(BATCH))
    # At most one row per bucket.
    return rows.join(F.broadcast(newest), [BUCKET, BATCH]).drop(BATCH)


def _forget(spark: SparkSession, path: str, versions: Sequence[int]) -> None:
    """Delete bucket versions that a later one of ``versions`` replaces."""
    seen: set[str] = set()
    for n in reversed(versions):
        live = 0
        for folder in folders(spark, f"{path}/{BATCH}={n}"):
            bucket = folder.rpartition("/")[2]
            if not bucket.startswith(f"{BUCKET}="):
                continue
            if bucket in seen:
                delete_folder(spark, folder)
            else:
                live += 1
            seen.add(bucket)
        if not live:
            delete_folder(spark, f"{path}/{BATCH}={n}")


def drain_current(
    stream: DataFrame, place: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], mode: str = "append", buckets: int = BUCKETS
) -> DataFrame:
    """Process what is available into a keyed table and return its current rows.

    ``merge`` makes one row per key of old and new rows (it sees new ones with a greater ``batch_id``). Only buckets that a
    micro-batch touches are read and written again. Stopped and started again with the same ``place``, the table goes
    on where the last committed micro-batch ended, and a micro-batch that is done twice counts once.
    """
    spark, path, schema = stream.sparkSession, f"{place}/table", stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumns({BUCKET: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), BATCH: F.lit(batch_id)}).persist()
        old = current_rows(spark, path, schema, batch_id).withColumn(BATCH, F.lit(-1))
        touched = old.join(F.broadcast(new.select(BUCKET).distinct()), BUCKET, "left_semi")
        merged = merge(touched.unionByName(new)).select(*schema.names, BUCKET)
        merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{BATCH}={batch_id}")
        new.unpersist()
        # The version before this one stays for whoever reads it now.
        _forget(spark, path, _versions(spark, path, batch_id))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return current_rows(spark, path, schema).drop(BUCKET)


def newest_of(keys: Sequence[str], order: Sequence[str] = (BATCH,)) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the last row per key in the given order."""
    def merge(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*rows.columns), F.struct(*order))
        return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(last.alias("_last")).select("_last.*")

    return merge


def first_events(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Intake without repeats: a key seen again within the delay has no second effect."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def source_pairs(findings: DataFrame) -> DataFrame:
    """(finding, source) of every line that names a finding."""
    pairs = findings.where(F.col("canonical_finding_id").isNotNull())
    return pairs.select("canonical_finding_id", F.concat_ws(":", "scanner_id", F.col("event_id").cast("string")).alias("source"))


def merged_sources(findings: DataFrame, received: str = "received_at", delay: str | None = None) -> DataFrame:
    """New (finding, source) pairs. State is one entry per pair: with a ``delay`` it is dropped after the watermark; without
    one it is never, so endless streams take ``drain_sources`` instead."""
    keys = ["canonical_finding_id", "source"]
    if delay:
        kept = findings.where(F.col("canonical_finding_id").isNotNull()).withColumn("source", F.concat_ws(":", "scanner_id", F.col("event_id").cast("string")))
        return kept.select(*keys, received).withWatermark(received, delay).dropDuplicatesWithinWatermark(keys)
    return source_pairs(findings).dropDuplicates(keys)


def drain_sources(findings: DataFrame, place: str) -> DataFrame:
    """All (finding, source) pairs so far, in a keyed table; no state is kept between micro-batches."""
    keys = ["canonical_finding_id", "source"]
    return drain_current(source_pairs(findings), place, keys, lambda rows: rows.dropDuplicates(keys))


def drain_latest(events: DataFrame, place: str, keys: Sequence[str], at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per key so far, in a keyed table; no state is kept between micro-batches."""
    return drain_current(events.select(*keys, at, tie, *columns), place, keys, newest_of(keys, [at, tie]))


def recurring_windows(incidents: DataFrame, keys: Sequence[str], at: str, length: str = "30 days", slide: str = "1 day", delay: str = "1 day", least: int = 3) -> DataFrame:
    """Sliding windows in which a key occurs often enough."""
    counts = incidents.withWatermark(at, delay).groupBy(F.window(at, length, slide), *keys).agg(F.count(F.lit(1)).alias("incidents"))
    return counts.where(F.col("incidents") >= least).select(F.col("window.start").alias("window_start"), *keys, "incidents")


def running_latest(events: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per key, in update mode."""
    last = F.max_by(F.struct(at, tie, *columns), F.struct(at, tie))
    return events.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def stale_outputs(inventory: DataFrame, keys: Sequence[str], observed: str, collected: str, version: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Observations that newer inventory overtakes go to ``verify``, the others to ``open``."""
    def judged(batch: DataFrame) -> DataFrame:
        return V.newest_evidence(batch, inventory, keys, observed, collected, version)

    return {
        "verify": lambda batch: judged(batch).where("newer_evidence"),
        "open": lambda batch: judged(batch).where("NOT newer_evidence"),
    }


def quarantine_outputs() -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {"accepted": lambda batch: V.quarantine_split(batch)[0], "quarantined": lambda batch: V.quarantine_split(batch)[1]}
