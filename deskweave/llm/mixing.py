"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskweave.llm.common import WORD_PATTERN, read
from deskweave.operators.staging import stage

BITS = 12  # of the hash that each histogram level resolves
LEVELS = 4


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def document_hash(key: Column) -> Column:
    """BITS * LEVELS bits of the key's MD5; a null key counts as empty text."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(hexed, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), limit: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling of all words by weight.

    Sources are ordered by code point, null last, and get the weights in turn. A target stops at ``limit``
    times its source's size; what is above is shared by weight among the others until none is above. A
    source stops if, with all sources of a smaller size per weight stopped, its share is still above its
    limit. One row per source goes through the windows, never documents.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("words", F.sum(F.col("source_size").cast("double")).over(whole))
    ranked = ranked.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
    ranked = ranked.withColumn("shares", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.col("left") / F.col("shares")
    open_level = F.when(F.col("cap") >= F.col("weight") * level, level)
    ranked = ranked.withColumn("level", F.first(open_level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): the documents of a hash below ``cut`` come nearest to their source's budget of words.

    ``rows(source, size, hash)``, ``budgets(source, budget)``. Every level sums words by source and hash
    bucket and keeps the bucket in which the running sum reaches the budget; the next level looks only
    into that bucket. Of the last bucket all documents are taken or none, whichever is nearer. No document is sorted: a level's window sees at most 2**BITS sums per source.
    """
    found = budgets.where("budget > 0").select("source", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("hash", shift)
        inside = rows.alias("r").join(F.broadcast(found).alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")))
        if level:
            inside = inside.where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy(F.col("r.source").alias("source"), "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(order))
        reached = F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), "words")
        found = sums.where("upto >= rest").groupBy("source").agg(F.min(reached).alias("at"))
        found = found.select("source", F.col("at.rest").alias("rest"), F.col("at.bucket").alias("prefix"), F.col("at.words").alias("words"))
        found = stage(found, "cuts")
    nearer = (F.col("words") <= 2 * F.col("rest")).cast("long")
    return found.select("source", (F.col("prefix") + nearer).alias("cut"))


def mix_plan(rows: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), limit: float = 3.0) -> DataFrame:
    """(of, source_size, target, passes, cut), one row per source, from written ``rows(source, size, hash)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, limit), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("passes", passes)
    budget = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    cuts = hash_thresholds(rows, targets.select("source", budget.alias("budget")))
    plan = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return plan.select(F.col("t.source").alias("of"), "source_size", "target", "passes", F.coalesce("cut", F.lit(0)).alias("cut"))


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every document, written: what the plan is made from."""
    columns = ("doc_id", "source", text_size(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("hash"))
    return stage(documents.select(*columns), "sizes")


def mix_sources(documents: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), limit: float = 3.0) -> DataFrame:
    """How often each document is taken, so that every source's words come near its target.

    Returns (doc_id, source, size, source_size, target, copies, taken), one row per row of ``documents``.
    A source's target is a whole number of its passes plus a part of one: every document is taken in the
    passes, those with a hash below the source's cut once more. The cuts of all budgets of a source are
    nested: a larger budget keeps what a smaller one kept. The hash is of doc_id alone, so reruns agree
    and rows of equal doc_id are kept or left together. The copies never exceed ``limit`` rounded up.

    Null texts and texts without words have size 0 (they follow the cut like others and take 0 words).
    A null source is a source of its own, the last. A null doc_id hashes as empty text. Empty tables give
    no rows, other columns are ignored. A source without words has target 0. The number of sources is
    that of a catalogue (it is broadcast after the documents are summed, a row each); documents are
    never broadcast. Hot sources need no care: they are summed map-side.
    """
    rows = sized_documents(documents)
    plan = mix_plan(rows, weights, limit)
    out = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("passes") + (F.col("hash") < F.col("cut")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated_documents(documents: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), limit: float = 3.0) -> DataFrame:
    """The documents of the mix, each as often as ``mix_sources`` takes it, with the columns of ``documents``.

    The decision is a function of source and doc_id alone: the plan, a row per source, is sent to the scan, and no text is
    shuffled. The copies of a document follow each other. Null sources, keys and texts as in ``mix_sources``; whole
    rows go through in one column, so no name of theirs can clash.
    """
    plan = mix_plan(sized_documents(documents), weights, limit).select(F.struct("of", "passes", "cut").alias("_plan"))
    rows = documents.select(F.struct(*documents.columns).alias("_row")).withColumn("_hash", document_hash(F.col("_row.doc_id")))
    taken = rows.join(F.broadcast(plan), F.col("_row.source").eqNullSafe(F.col("_plan.of")))
    copies = F.col("_plan.passes") + (F.col("_hash") < F.col("_plan.cut")).cast("long")
    kept = taken.select("_row", copies.alias("_copies")).where("_copies > 0")
    return kept.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# The same mix with every document of a source in hash order; the cut is the first place at which the running sum
# reaches the budget, or just before it if that is nearer.
OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS hash FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY (source IS NULL)::INT, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes GROUP BY source),
caps AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS words FROM sources),
levels AS (
  SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, (source IS NULL)::INT, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, (source IS NULL)::INT, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT max_by(l.level, -l.cap / l.weight) FROM levels l WHERE l.cap >= l.weight * l.level)), cap) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets),
rests AS (SELECT *, round(target - passes * source_size)::BIGINT AS budget FROM budgets),
running AS (
  SELECT s.source, s.hash, r.budget, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.hash) AS words
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE r.budget > 0),
cuts AS (
  SELECT source, min_by(hash + (words <= 2 * (budget - (upto - words)))::INT, hash) AS cut FROM running WHERE upto >= budget GROUP BY source)
SELECT s.doc_id, s.size, r.source_size, r.target, s.size * (r.passes + (s.hash < coalesce(c.cut, 0))::BIGINT) AS taken
FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
