"""From raw documents to token ids: language, toxicity, near duplicates, source mix, BPE.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it. Calling one
runs the jobs that fit its model and count its statistics; the rows themselves are lazy.

All stages but the last return the columns of their input, whatever else these are named. An empty table stays empty, and
repeated rows are rows of their own except for near duplicates. No text is cut, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm import bpe, jaccard, language, mixing, toxicity
from deskweave.llm.common import read, small_batches
from deskweave.operators.staging import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose grams no learned language knows.

    Null and empty texts have no letters and go. Rows with a null lang teach nothing but are judged. Equal scores go to the
    first language by name; copies of a row share its fate. Without a learned language nothing is known and all go.
    """
    small_batches(spark)
    return language.in_known_language(docs, language.fit_filters(language.training_rows(docs)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model, fitted on the labelled ones among them, predicts to be toxic.

    Null and empty texts have the model's constant as their score. Labels are joined by doc_id; a null doc_id has none.
    Without labelled rows the model says nothing and all stay. Copies of a row share its fate.
    """
    small_batches(spark)
    labels = toxicity.training_labels(read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Null texts and texts without words link with nothing and all stay. A null doc_id comes last. Of rows that repeat a
    doc_id and text one stays; a doc_id with several texts is as many documents.
    """
    small_batches(spark)
    return jaccard.one_per_component(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copies one after the other.

    A null source is a source of its own; null texts have no words and follow their source's cut. Rows of one doc_id and
    source are taken alike, so ties and reruns agree.
    """
    small_batches(spark)
    return mixing.repeated_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers; a repeated document repeats.

    Null and empty texts have no ids. A null doc_id stays null. Other columns are left out.
    """
    small_batches(spark)
    return bpe.encode_repeated(docs).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_duplicates),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

# Learned models and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return docs
