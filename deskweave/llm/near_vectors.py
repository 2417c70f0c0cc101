"""Embedding near-duplicates: tiles of vectors in PCA order, compared leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from deskweave.llm.common import read
from deskweave.llm.components import components
from deskweave.llm.vectors import lengths, matrix, packed, scaled, units, unpacked, usable
from deskweave.operators.staging import stage

THRESHOLD = 0.98
TILE = 1024  # vectors
STEP = 8  # dimensions added between two looks at the bound
BOX = 8  # leading dimensions whose ranges are kept per tile
SLACK = 1e-9  # of bounds in rotated coordinates; survivors are decided on the original vectors


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            rows = units(matrix(batch.column("embedding").slice(first, 4096), width))
            total += rows.T @ rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["place", "value"])


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes of all unit vectors as columns, largest mean square first; width**2 sums are all that is gathered."""
    sums = vectors.select("embedding").mapInArrow(lambda b: _moments(b, width), "place long, value double")
    rows = sums.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(width * width)
    total[rows["place"].to_numpy()] = rows["value"].to_numpy()
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1]


def _keyed(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead = units(matrix(batch.column("embedding"), len(axes))) @ axes[:, 0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])


def _tiles(batches: Iterator[pa.RecordBatch], axes: np.ndarray, tile: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to tiles of one label: row numbers, vectors, and the ranges of leading coordinates."""
    number = 0
    for batch in batches:
        labels = batch.column("label").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            for first in range(int(a), int(b), tile):
                part = batch.slice(first, min(tile, int(b) - first))
                rows = matrix(part.column("embedding"), len(axes))
                turned = units(rows) @ axes[:, :BOX]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").slice(0, 1), pa.array([number]), part.column("part").slice(0, 1), pa.array([part.column("_row").to_pylist()], pa.list_(pa.int64())), pa.array([packed(rows)], pa.binary()),
                     pa.array([turned.min(0).tolist()], pa.list_(pa.float64())), pa.array([turned.max(0).tolist()], pa.list_(pa.float64()))],
                    names=["label", "number", "part", "rows", "body", "low", "high"],
                )
                number += 1


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= threshold, in double precision on the vectors as given.

    Products are summed in PCA order. What the dimensions to come can add is at most the product of both
    suffix norms; rows and columns without a pair that can still reach the threshold are dropped.
    """
    a, b = scaled(a), scaled(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ta, tb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    rest_a = np.sqrt(np.maximum(np.cumsum(ta[:, ::-1] ** 2, 1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum(tb[:, ::-1] ** 2, 1)[:, ::-1], 0))
    i, j = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)))
    for d in range(0, len(axes), STEP):
        part += ta[i, d : d + STEP] @ tb[j, d : d + STEP].T
        open_ = part >= threshold - SLACK
        if d + STEP < len(axes):
            open_ = part + np.outer(rest_a[i, d + STEP], rest_b[j, d + STEP]) >= threshold - SLACK
        rows, columns = open_.any(1), open_.any(0)
        if not rows.any():
            return np.empty(0, int), np.empty(0, int)
        if rows.mean() < 0.9 or columns.mean() < 0.9:
            i, j, part, open_ = i[rows], j[columns], part[np.ix_(rows, columns)], open_[np.ix_(rows, columns)]
    x, y = np.nonzero(open_)
    x, y = i[x], j[y]
    cosine = np.concatenate([np.einsum("ij,ij->i", a[x[k : k + 65536]], b[y[k : k + 65536]]) for k in range(0, len(x), 65536)] or [np.empty(0)])
    good = cosine / (na[x] * nb[y]) >= threshold
    return x[good], y[good]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links that connect as much as all of them do; fewer than there are ends."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            kept.append((x, y))
    return kept


def _compared(batches: Iterator[pa.RecordBatch], axes: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): number of links n of row a, or with n = 0 a link a-b of the pair's spanning forest."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = [np.array(batch.column(c)[k].as_py(), np.int64) for c in ("rows", "other_rows")]
            bodies = [unpacked(batch.column(c)[k], len(axes)) for c in ("body", "other_body")]
            x, y = close_pairs(*bodies, axes, threshold)
            a, b = rows[0][x], rows[1][y]
            if batch.column("same")[k].as_py():
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            ends, n = np.unique(np.concatenate([a, b]), return_counts=True)
            links = _forest(a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ends, [x for x, _ in links]])), pa.array(np.concatenate([ends, [y for _, y in links]])), pa.array(np.concatenate([n, np.zeros(len(links), int)]))],
                names=["a", "b", "n"],
            )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Rows of equal, not null labels are linked if their cosine reaches ``threshold``. Rows are sorted by label
    and first principal coordinate into tiles of bounded size, so a hot label is many tiles. Pairs of tiles whose
    boxes of leading coordinates are farther apart than linked vectors can be are never compared; in the others
    products stop at the suffix bound. A compared pair gives link counts per vector and a spanning forest,
    never the list of its links.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a null
    label. Vectors of different lengths are compared among their like, one run per length. Very small and very large
    components are scaled exactly before they are squared. Repeated rows are vectors of their own. A null vec_id is
    ignored for component_id unless nothing else is there; ``kept`` is then false. An empty table gives
    no rows; other columns are not read.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "embedding", "label", (usable("embedding") & F.col("label").isNotNull()).alias("good"))
    rows = stage(rows, "vectors")
    good = rows.where("good").select("_row", "embedding", "label")
    every = [_links(good.where(F.size("embedding") == width), width, threshold, tile) for width in lengths(good, "embedding")]
    if not every:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = reduce(DataFrame.unionByName, every)
    counts = found.where("n > 0").groupBy(F.col("a").alias("_row")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("n = 0")).select(F.col("node").alias("_row"), "root")
    named = rows.select("_row", "vec_id").join(counts, "_row", "left").join(roots, "_row", "left").withColumn("root", F.coalesce("root", "_row"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "root")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(good: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, n) of equally long vectors, as ``_compared`` gives them; written."""
    axes = principal_axes(good, width)
    schema = StructType([*good.schema.fields, StructField("lead", DoubleType())])
    parts = int(good.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "lead", "_row"]
    sorted_rows = good.mapInArrow(lambda b: _keyed(b, axes), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.withColumn("part", F.spark_partition_id())
    label = good.schema["label"].dataType.simpleString()
    tiles = sorted_rows.mapInArrow(lambda b: _tiles(b, axes, tile), f"label {label}, number long, part int, rows array<long>, body binary, low array<double>, high array<double>")
    tiles = stage(tiles, "tiles")
    names = tiles.select("label", F.struct("part", "number").alias("tile"), "low", "high")
    others = names.select(F.col("label").alias("l2"), F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i])
    apart = sum((gap(i) * gap(i) for i in range(1, min(BOX, width))), gap(0) * gap(0))
    near = names.join(others, (F.col("label") == F.col("l2")) & (F.col("tile") <= F.col("other")) & (apart <= 2 - 2 * threshold + SLACK)).select("tile", "other")
    bodies = tiles.select(F.struct("part", "number").alias("tile"), "rows", "body")
    pairs = near.join(bodies, "tile").join(bodies.select(F.col("tile").alias("other"), F.col("rows").alias("other_rows"), F.col("body").alias("other_body")), "other")
    pairs = pairs.select("rows", "body", "other_rows", "other_body", (F.col("tile") == F.col("other")).alias("same"))
    return stage(pairs.mapInArrow(lambda b: _compared(b, axes, threshold), "a long, b long, n long"), "links")


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
