"""What several operators share: tables, splits, and vectorised work on the UTF-8 bytes of Arrow strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


# Rows of a batch of whole texts between Spark and Python; Spark's own default of 10,000 is meant for short rows.
BATCH_ROWS = 1024
BATCH_BYTES = 1 << 22  # of rows that are large themselves, as those of an index


def small_batches(spark: SparkSession) -> None:
    """Session settings of the registered queries and the pipeline; operators themselves leave the session alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column, or that of whole rows that go through as ``_row``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("_row").field("text")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts).cast("int")


def give_back() -> None:
    """Return freed memory to the system. A worker that waits for its next task would keep it beside those that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what its steps held is given back with the last one."""
    yield from batches
    del batches
    give_back()


def utf8_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, byte offsets from 0, bytes). A null text counts as empty. Memory is given back after a batch."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, starts, body = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, at[first : last + 1] - at[first], raw[at[first] : at[last]]
        first = last
    give_back()


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _lower_table()[raw]


def _blanks() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def word_spans(at: np.ndarray, raw: np.ndarray, of_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; a word never crosses the end of a text.

    ``of_word`` tells for each of the 256 bytes whether it belongs to a word; by default all but white space do.
    """
    inside = (_blanks() if of_word is None else of_word)[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of many byte spans from one prefix sum; the power tables are kept between steps."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64))

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(raw) + 1:
            size = max(len(raw) + 1, STEP_BYTES + 1)
            self.up, self.down = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def keyed_schema(df: DataFrame, key: str, rest: str) -> StructType:
    """The key column as ``df`` has it, of any type, and columns in DDL."""
    return StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(rest).fields])


PROBES = (0, 18, 36)  # shifts that take a hash to its bits in a filter


def bit_filter(rows: DataFrame, column: str, most_bits: int) -> np.ndarray:
    """Bits of a Bloom filter of a column of 64-bit hashes, as words: sixteen bits a row, ``most_bits`` at most.

    A fuller filter only lets more through; who uses one has to decide exactly afterwards.
    """
    bits = min(1 << (max(rows.count() * 16, 64) - 1).bit_length(), most_bits)
    slots = F.array(*[F.shiftrightunsigned(F.col(column), k).bitwiseAND(F.lit(bits - 1)) for k in PROBES])
    rows = rows.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def in_filter(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for k in PROBES:
        slot = (hashes >> np.uint64(k) & np.uint64(len(words) * 64 - 1)).astype(np.int64)
        found &= (words[slot >> 6] >> (slot & 63)) & 1 == 1
    return found


def by_filter(rows: DataFrame, column: str, words: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash in ``column`` is not in the filter, and those whose hash is; no row goes through Python.

    The filter is sent as the one row of a table. Its column is called ``_words``, which ``rows`` must not have.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(pa.table({"_words": pa.array([words], pa.list_(pa.int64()))}))
    held = F.lit(True)
    for k in PROBES:
        slot = f"(shiftrightunsigned(`{column}`, {k}) & {len(words) * 64 - 1}L)"
        held &= F.expr(f"(shiftrightunsigned(get(_words, cast(shiftright({slot}, 6) as int)), cast({slot} & 63 as int)) & 1L) = 1L")
    return tuple(rows.join(F.broadcast(table), held, how) for how in ("left_anti", "left_semi"))
