"""Intermediate tables written to the shared folder.

A staged table cuts lineage: every reader sees the same rows even when executors are lost and
tasks are repeated, which a range partitioning (its bounds are sampled) cannot promise by itself.
The folder is the one the session names in ``spark.checkpoint.dir``. Only on a local master may the
setting be missing; then a folder for this driver process is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from deskweave.session import shared_folder_setting

_staged: list[str] = []
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = shared_folder_setting(spark)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="deskweave-stage-"))
    return _local_folder[0]


def new_stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once, in a folder per value of the columns ``by``, and return the written table."""
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Write ``df`` once in as many buckets of ``key`` as shuffles have partitions: joins on the key, as many as there
    are, move only the other side. The table is known to this session only; its files lie in the shared folder."""
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    name = f"stage_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    _staged.append(path)
    return spark.table(name)


def _file_system(spark: SparkSession, path: str):
    """The store of a path, as Spark's own readers see it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a folder; none if it does not exist."""
    store, target = _file_system(spark, path)
    return [f.getPath().toString() for f in store.listStatus(target) if f.isDirectory()] if store.exists(target) else []


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a writing job has finished the folder."""
    store, target = _file_system(spark, f"{path}/_SUCCESS")
    return bool(store.exists(target))


def delete_folder(spark: SparkSession, path: str) -> bool:
    store, target = _file_system(spark, path)
    return bool(store.delete(target, True))


def release_staged(spark: SparkSession) -> int:
    """Delete the tables staged by this driver, once their readers are done."""
    released = 0
    while _staged:
        released += delete_folder(spark, _staged.pop())
    return released
