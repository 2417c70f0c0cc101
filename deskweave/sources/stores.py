"""Tables that let a job continue where an earlier one stopped."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deskweave.functions.text import fingerprint
from deskweave.operators.staging import delete_folder, folders, is_committed, stage


class DatasetStore:
    """Records kept per input signature. A new signature starts empty and leaves the others alone.

    Every write has a job of its own: a folder that is replaced as a whole if the job writes again, so a retried
    or restarted job leaves no second copy. A replacement by key writes a new generation of all rows; readers take the
    committed jobs of the last generation that has any.
    """

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _generations(self, spark: SparkSession, signature: str) -> list[tuple[int, list[str]]]:
        """(generation, committed job folders), oldest first."""
        found = []
        for folder in folders(spark, f"{self.path}/signature={signature}"):
            jobs = [j for j in folders(spark, folder) if is_committed(spark, j)]
            if jobs:
                found.append((int(folder.rpartition("generation=")[2]), sorted(jobs)))
        return sorted(found)

    def _place(self, signature: str, generation: int, job: str) -> str:
        return f"{self.path}/signature={signature}/generation={generation}/job={job}"

    def load(self, spark: SparkSession, signature: str) -> DataFrame:
        generations = self._generations(spark, signature)
        return spark.read.schema(self.schema).parquet(*generations[-1][1]) if generations else spark.createDataFrame([], self.schema)

    def append(self, records: DataFrame, signature: str, job: str | None = None) -> str:
        """Write the records of one job; the same ``job`` again replaces what it wrote. Returns the job."""
        job = job or uuid.uuid4().hex
        generations = self._generations(records.sparkSession, signature)
        place = self._place(signature, generations[-1][0] if generations else 0, job)
        records.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(place)
        return job

    def replace(self, records: DataFrame, signature: str, keys: Sequence[str], job: str) -> None:
        """Records whose keys are stored already take the place of the stored ones; other stored rows stay.

        The next generation appears with the commit of its only job; until then readers see the last one. Done twice it
        has the same rows.
        """
        spark = records.sparkSession
        generations = self._generations(spark, signature)
        fresh = stage(records.select(*self.schema.fieldNames()), "fresh")
        others = self.load(spark, signature).join(fresh.select(*keys).distinct(), list(keys), "left_anti")
        merged = others.select(*self.schema.fieldNames()).unionByName(fresh)
        merged.write.mode("overwrite").parquet(self._place(signature, generations[-1][0] + 1 if generations else 0, job))
        for generation, _ in generations[:-1]:
            delete_folder(spark, f"{self.path}/signature={signature}/generation={generation}")


def input_signature(settings: Sequence[tuple[str, str]]) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(sorted(settings), ensure_ascii=False).encode("utf-8")).hexdigest()


def row_key(columns: Sequence[str], settings: str) -> Column:
    """Cache key of one input row under given scorer settings."""
    return F.sha2(F.concat_ws("|", F.lit(settings), fingerprint(columns)), 256)


def uncached(rows: DataFrame, cached_keys: DataFrame, columns: Sequence[str], settings: str) -> DataFrame:
    """Rows that have no stored prediction yet; only these go to the scorer."""
    keyed = rows.withColumn("cache_key", row_key(columns, settings))
    return keyed.join(cached_keys.select("cache_key"), "cache_key", "left_anti")


def with_cached(rows: DataFrame, cache: DataFrame, fresh: DataFrame, columns: Sequence[str], settings: str) -> DataFrame:
    """Predictions for all rows: stored ones and fresh ones, matched by key."""
    keyed = rows.withColumn("cache_key", row_key(columns, settings))
    known = cache.unionByName(fresh.select(*cache.columns)).dropDuplicates(["cache_key"])
    return keyed.join(known, "cache_key")
