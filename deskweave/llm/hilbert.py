"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskweave.llm.common import read
from deskweave.llm.vectors import length_of, lengths, matrix, packed, scaled, unpacked, usable
from deskweave.operators.staging import stage

CURVES = 5
AXES = 4  # projected dimensions of a curve
BITS = 8  # per projected dimension
BLOCKS = 32  # per curve, of equally many rows; fewer while a block would have less than LEAST_BLOCK
LEAST_BLOCK = 128
WINDOW = 11  # blocks around a query's own in which it is compared with all rows
PACK = 512  # vectors in one packed row
SLACK = 1e-9  # of bounds


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dimensions, each below 2**bits).

    From the highest bit down, the half a point is in decides how the smaller cells are turned: a one
    inverts the first dimension's lower bits, a zero exchanges them with those of this dimension. The
    bits are then Gray-decoded across dimensions and read in turn, highest first.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            high = (x[d] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= parity
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level) & 1
    return key


class Curves:
    """Projections, scales and shifts of all curves; candidates get one coordinate more, so that the largest inner
    product becomes the smallest angle."""

    def __init__(self, width: int, longest: float, centre: np.ndarray | None = None, spread: np.ndarray | None = None) -> None:
        random = np.random.default_rng(20240229)
        self.longest = longest
        self.axes = np.stack([np.linalg.qr(random.standard_normal((width + 1, min(AXES, width + 1))))[0] for _ in range(CURVES)])
        self.shift = random.random((CURVES, self.axes.shape[2]))
        self.centre, self.spread = centre, spread

    def projected(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """(curves, rows, axes); a query is made as long as the longest candidate."""
        if query:
            unit, more = scaled(rows), np.zeros(len(rows))
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        else:
            unit = rows / self.longest
            more = np.sqrt(np.maximum(1 - np.linalg.norm(unit, axis=1) ** 2, 0))
        return np.concatenate([unit, more[:, None]], 1) @ self.axes

    def keys(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """(curves, rows): the curve covers four spreads around the centre, moved by its shift."""
        scaled = (self.projected(rows, query) - self.centre[:, None]) / (8 * self.spread[:, None]) + 0.25 + self.shift[:, None] / 2
        cells = np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(c, BITS) for c in cells])


def _sums(batches: Iterator[pa.RecordBatch], width: int, longest: float) -> Iterator[pa.RecordBatch]:
    curves = Curves(width, longest)
    for batch in batches:
        rows = curves.projected(matrix(batch.column("embedding"), width), False)
        values = np.stack([rows.sum(1).ravel(), (rows**2).sum(1).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.shape[1])), pa.array(values[0]), pa.array(values[1])], names=["place", "s", "ss"])


def _keyed(batches: Iterator[pa.RecordBatch], curves: Curves, query: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = curves.keys(matrix(batch.column("embedding"), curves.axes.shape[1] - 1), query)
        for curve, key in enumerate(keys):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, curve)), pa.array(key)], names=[*batch.schema.names, "curve", "key"])


def _packs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (curve, block) to packed rows of one block, in key order, with their centre and radius."""
    for batch in batches:
        place = batch.column("curve").to_numpy() * (1 << 32) + batch.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            for first in range(int(a), int(b), PACK):
                part = batch.slice(first, min(PACK, int(b) - first))
                rows = matrix(part.column("embedding"), width)
                least = part.column("least").to_pylist() if "least" in part.schema.names else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("curve").slice(0, 1), part.column("block").slice(0, 1), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([packed(rows)], pa.binary()), pa.array([least], pa.list_(pa.float64()))],
                    names=["curve", "block", "ids", "body", "least"],
                )


def _best(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of a packed row for each query of another, as far as they reach the query's least score.

    A pack is left out for the queries whose bound |q| radius + q centre, which no candidate exceeds, is below their least.
    """
    for batch in batches:
        for n in range(batch.num_rows):
            asked, ids = (np.array(batch.column(c)[n].as_py(), np.int64) for c in ("asked", "ids"))
            questions, bodies = unpacked(batch.column("question")[n], width), unpacked(batch.column("body")[n], width)
            least = np.array([-np.inf if x is None else x for x in batch.column("least")[n].as_py()])
            with np.errstate(over="ignore", invalid="ignore"):
                centre = bodies.mean(0)
                radius = np.linalg.norm(bodies - centre, axis=1).max()
                middle, reach = questions @ centre, np.linalg.norm(questions, axis=1) * radius
                near = ~(middle + reach + SLACK * (np.abs(middle) + reach) < least)
                if not near.any():
                    continue
                asked, questions, least = asked[near], questions[near], least[near]
                scores = questions @ bodies.T
            open_ = (asked[:, None] != ids[None, :]) & (scores >= least[:, None])
            order = np.argsort(ids, kind="stable")  # of equal scores the smaller id stays
            scores, open_, ids = scores[:, order], open_[:, order], ids[order]
            for row in np.flatnonzero(open_.sum(1) > k):
                places = np.flatnonzero(open_[row])
                open_[row, places[np.argsort(-scores[row, places], kind="stable")[k:]]] = False
            q, c = np.nonzero(open_)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[c]), pa.array(scores[q, c])], names=["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k candidates of largest inner product that were found.

    Both tables have (vec_id, embedding). Each curve orders all candidates by the Hilbert key of a random
    projection with a shift of its own and cuts them into BLOCKS range partitions of equally many rows. A query is compared
    first with the block of its own key on every curve; the k-th best score of these is a lower bound of its k-th score.
    Then it is compared with the other blocks of the WINDOW around its key, which hand on only what reaches that bound.
    The finds of all curves are merged, the best k kept, ties to the smaller vec_id. WINDOW / BLOCKS is a share of
    all rows, the same at every size.

    Vectors that are null, empty, zero, hold null or non-finite components, or have no vec_id take no part. Vectors of
    different lengths are searched among their like, one run per length. Rows that repeat a vec_id count once, with their
    best score; a query is never its own candidate. Empty tables give no rows; other columns are not read.
    """
    pick = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries, candidates = pick(queries), pick(candidates)
    found = [_found(queries.where(F.size("embedding") == d), candidates.where(F.size("embedding") == d), d, k) for d in lengths(candidates, "embedding")]
    if not found:
        return candidates.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return _merged(reduce(DataFrame.unionByName, found)).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _found(queries: DataFrame, candidates: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of equally long vectors, the best k among them."""
    spark = candidates.sparkSession
    rows, longest = candidates.agg(F.count("*"), F.max(length_of("embedding"))).first()
    longest = min(longest, np.finfo(np.float64).max)
    sums = candidates.mapInArrow(lambda b: _sums(b, width, longest), "place long, s double, ss double").groupBy("place").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).toArrow()
    order = np.argsort(sums["place"].to_numpy())
    mean, square = (sums[c].to_numpy()[order].reshape(CURVES, -1) / rows for c in ("s", "ss"))
    curves = Curves(width, longest, mean, np.sqrt(np.maximum(square - mean**2, 1e-12)))
    schema = "vec_id long, embedding array<double>, curve long, key long"
    placed = stage(candidates.mapInArrow(lambda b: _keyed(b, curves, False), schema), "keys")
    blocks = max(1, min(BLOCKS, rows // LEAST_BLOCK))
    window = math.ceil(WINDOW / BLOCKS * blocks) if blocks > 1 else 1
    steps = [i / blocks for i in range(1, blocks)]
    bounds = {r["curve"]: r["b"] for r in placed.groupBy("curve").agg(F.percentile_approx("key", steps or [0.5], 10_000).alias("b")).collect()} if steps else {}
    ends = F.array(*[F.array(*[F.lit(x) for x in bounds.get(c, [])]).cast("array<bigint>") for c in range(CURVES)])
    block = F.size(F.filter(F.element_at(ends, (F.col("curve") + 1).cast("int")), lambda x: x < F.col("key"))).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = ["curve", "block", "key", "vec_id"]
    pack = "curve long, block long, ids array<long>, body binary, least array<double>"

    def packs(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(parts, *cut).sortWithinPartitions(*cut).mapInArrow(lambda b: _packs(b, width), pack)

    bodies = stage(packs(placed.withColumn("block", block)), "packs").drop("least")
    asked = stage(queries.mapInArrow(lambda b: _keyed(b, curves, True), schema).withColumn("block", block), "asked")

    def compared(questions: DataFrame, other_blocks: Column) -> DataFrame:
        dealt = questions.select("curve", F.explode(other_blocks).alias("block"), F.col("ids").alias("asked"), F.col("body").alias("question"), "least")
        pairs = dealt.join(bodies, ["curve", "block"]).select("asked", "question", "least", "ids", "body")
        return pairs.mapInArrow(lambda b: _best(b, width, k), "query_id long, vec_id long, score double")

    own = stage(compared(packs(asked.withColumn("least", F.lit(None).cast("double"))), F.array("block")), "own-blocks")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = _merged(own).withColumn("_place", F.row_number().over(place)).where(F.col("_place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    first = F.least(F.greatest(F.col("block") - window // 2, F.lit(0)), F.lit(blocks - window))
    others = F.array_except(F.sequence(first, first + window - 1), F.array("block"))
    return own.unionByName(compared(packs(asked.join(kth, "vec_id", "left")), others))


def op5_hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors)
