"""Files and tables in, snapshots out.

A file that must be read whole (one JSON document, one text) is one task; many files are read in
parallel. For large inputs use JSON Lines or Parquet with the same schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deskweave.functions.responses import is_array, is_object
from deskweave.operators.documents import section_documents
from deskweave.operators.staging import stage

# Keys under which a JSON object may hold its records, and known text files.
RECORD_KEYS = ("records", "incidents", "tickets", "items", "data")
TEXT_SUFFIXES = (".md", ".markdown", ".txt")
BYTE_ORDER_MARK = "﻿"


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _whole_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(_file_name().alias("file"), F.ltrim(F.col("value"), F.lit(BYTE_ORDER_MARK)).alias("value"))


def read_record_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, place, record variant) of JSON files: an array, an object holding one, or a single object."""
    files = _whole_files(spark, path).withColumn("_v", F.try_parse_json("value"))
    root = F.col("_v")
    chosen = F.when(is_array(root), root)
    for key in RECORD_KEYS:
        inner = F.try_variant_get(root, f"$.{key}", "variant")
        chosen = chosen.when(is_array(inner), inner)
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(" must hold an object or an array of objects.")))
    items = F.when(chosen.isNotNull(), F.try_variant_get(chosen, "$", "array<variant>")).when(is_object(root), F.array(root)).otherwise(wrong)
    rows = files.select("file", F.posexplode(items).alias("place", "record"))
    return rows.where(is_object(F.col("record")))


def records_as(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """Typed columns from ``record``; fields the schema does not name are left out."""
    kept = [c for c in rows.columns if c != "record"]
    typed = F.from_json(F.to_json("record"), schema if isinstance(schema, StructType) else F.lit(schema))
    return rows.select(*kept, typed.alias("_r")).select(*kept, "_r.*")


def read_csv_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text. ``multiline`` allows line ends inside quotes but reads a file in one task."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=multiline, escape='"')
    return df.withColumnsRenamed({c: c.lstrip(BYTE_ORDER_MARK) for c in df.columns if c.startswith(BYTE_ORDER_MARK)})


def read_text_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    files = _whole_files(spark, path).where(F.lower("file").rlike(r"\.(md|markdown|txt)$"))
    return section_documents(files.withColumnRenamed("value", "text"))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of nested records with a fixed schema; rows that do not fit land in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_table_group(spark: SparkSession, path: str | Sequence[str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Several tables from JSON objects of arrays: one schema per key.

    The files, one task each, are parsed once for all tables; what is written has a folder per key, so reading one table
    touches no other. Keys without a schema are left out; a key that a file lacks has no rows from it.
    """
    root = _whole_files(spark, path).select("file", F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("key", "_items"))
    wanted = root.where(F.col("key").isin(*schemas) & is_array(F.col("_items")))
    rows = wanted.select("key", "file", F.posexplode(F.try_variant_get("_items", "$", "array<variant>")).alias("place", "_record"))
    # As text, so that any store and any later reader can hold it.
    parsed = stage(rows.select("key", "file", "place", F.to_json("_record").alias("record")), "tables", by=("key",))
    return {key: parsed.where(F.col("key") == key).select(F.from_json("record", F.lit(schema)).alias("_r")).where(F.col("_r").isNotNull()).select("_r.*") for key, schema in schemas.items()}


def reference_examples(texts: DataFrame, group_field: str = "assignment_group", text: str = "value") -> DataFrame:
    """Example records from JSON text: a flat array, or arrays by group whose name fills the group field.

    Result: place, record map<string,string>; an existing group value is kept.
    """
    parsed = texts.withColumn("_v", F.try_parse_json(text))
    flat = parsed.where(is_array(F.col("_v"))).select(
        F.lit(None).cast("string").alias("_group"), F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("place", "_item"))
    groups = parsed.where(is_object(F.col("_v"))).select(
        F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_group", "_items"))
    grouped = groups.select("_group", F.posexplode(F.try_variant_get("_items", "$", "array<variant>")).alias("place", "_item"))
    rows = flat.unionByName(grouped).where(is_object(F.col("_item")))
    record = F.try_variant_get("_item", "$", "map<string,string>")
    filled = F.when(F.col("_group").isNull() | F.map_contains_key(record, group_field), record).otherwise(
        F.map_concat(record, F.create_map(F.lit(group_field), F.col("_group"))))
    return rows.select(F.col("_group").alias("example_group"), "place", filled.alias("record"))


def write_snapshot(df: DataFrame, path: str, kind: str = "json") -> None:
    """Overwrite a JSON, CSV or Parquet snapshot."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"Unknown snapshot kind: {kind}")
