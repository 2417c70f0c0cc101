"""Language-model scores by context-tree weighting over bytes, beside a word unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deskweave.llm.common import BASE, SpanHasher, fold, give_back, keyed_schema, lowered, mixed, read, signed, unsigned, utf8_steps, word_spans
from deskweave.operators.staging import stage

DEPTH = 7  # bytes of the longest context, no more: a context and the byte after it are one 64-bit number
TOP = 2  # contexts up to this length are weighted by the driver, 2**16 of them at most; longer ones in tasks, by their last TOP + 1 bytes
FLUSH = 1 << 20  # distinct values that a task counts before it passes them on
CHUNK = 1 << 23  # pairs that a task sorts and counts before it passes them on
BUCKETS = 12  # bits of the groups of subtrees by which counts are packed and dealt out
RUN_PAIRS = 1 << 17  # pairs of whole subtrees that a task weights at a time
FAR = 1 << 19  # pairs beyond the head that a task holds before it packs them
TEXTS = 10  # bits of the texts whose sums over such pairs are packed together
HEAD_PAIRS = 1 << 23  # bound of the pairs whose logarithms are sent to the tasks; all others are asked for
HEAD_WORDS = 1 << 18  # bound of the word counts that are sent to the tasks; all others are joined


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], of, name: str) -> Iterator[pa.RecordBatch]:
    """Counts of the values that ``of(at, raw)`` gives, merged within the task."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, at, raw in utf8_steps(batch.column("text")):
            parts.append(np.unique(of(at, lowered(raw)), return_counts=True))
            if len(parts) >= 8:
                parts = [_merge(parts)]
                if len(parts[0][0]) >= FLUSH:
                    yield _count_rows(*parts.pop(), name)
    if parts:
        yield _count_rows(*_merge(parts), name)


def _count_rows(values: np.ndarray, n: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n)], names=[name, "n"])


def _words() -> object:
    hasher = SpanHasher()

    def of(at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        starts, ends, _ = word_spans(at, raw)
        return hasher(raw, starts, ends)

    return of


def _stream(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each after DEPTH zero bytes, and where their own bytes are."""
    size = np.diff(at)
    place = np.arange(len(raw)) + DEPTH * (np.repeat(np.arange(len(size)), size) + 1)
    stream = np.zeros(len(raw) + DEPTH * len(size), np.uint8)
    stream[place] = raw
    return stream, place


def _pairs(at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Every byte in the lowest byte, its context of DEPTH bytes above it, the nearest in the highest: contexts with the
    same last bytes follow one another."""
    stream, place = _stream(at, raw)
    if not len(place):
        return np.empty(0, np.uint64)
    ending = np.ndarray(len(stream) - DEPTH, "<u8", stream, strides=(1,)).astype(np.uint64)[place - DEPTH]
    return ending << np.uint64(8) | ending >> np.uint64(56)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    # Stirling's series at x + 6, brought back by the recurrence.
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(6):
        series -= np.log(x + k)
    return series


SMALL = 1 << 12  # counts whose logarithms are looked up
LOG_GAMMAS = {add: _log_gamma(np.arange(SMALL) + add) for add in (0.5, 1.0)}


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these whole counts."""

    def log_gamma(count: np.ndarray, add: float) -> np.ndarray:
        out = LOG_GAMMAS[add][np.minimum(count, SMALL - 1).astype(np.int64)]
        large = count >= SMALL
        if large.any():
            out[large] = _log_gamma(count[large] + add)
        return out

    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - log_gamma(zeros + ones, 1.0) - np.log(np.pi)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte counts to the (zeros, ones) of the 255 binary decisions, the first bit first."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, -1).sum(3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def _next_one(counts: np.ndarray) -> np.ndarray:
    """KT probability that the next decision is a one."""
    zeros, ones = _bits(counts)
    return (ones + 0.5) / (zeros + ones + 1)


def _blocked(of, rows: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """``of`` a few rows at a time, so that its intermediate arrays stay small."""
    return np.concatenate([of(rows[i : i + 2048]).astype(kind) for i in range(0, len(rows), 2048)])


def _byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 of all 256 byte probabilities from the 255 probabilities of a one."""
    out = np.zeros((len(one), 1))
    for level in range(8):
        first = (1 << level) - 1
        p = one[:, first : first + (1 << level)]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], 2).reshape(len(one), -1)
    return out


@dataclass
class ContextTree:
    """``child[node, byte]`` leads from a context to the one with one byte more before it; a negative number n ends in
    the row ~n of ``logs``, log10 of the mixed probability of each byte there."""

    child: np.ndarray
    logs: np.ndarray

    def ends(self, stream: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The row in which each place's path of preceding bytes ends."""
        node = np.zeros(len(place), np.int32)
        active = np.arange(len(place))
        for k in range(1, DEPTH + 1):
            node[active] = self.child[node[active], stream[place[active] - k]]
            active = active[node[active] >= 0]
        return ~node

    def text_scores(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """log10 probability of each text, byte by byte after the bytes before."""
        stream, place = _stream(at, raw)
        values = self.logs[self.ends(stream, place), stream[place]].astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[at[1:]] - sums[at[:-1]]


@dataclass
class Shape:
    """The contexts that are nodes, shortest first: depth, bytes, parent, and whether longer ones follow."""

    depth: np.ndarray
    context: np.ndarray
    parent: np.ndarray
    inner: np.ndarray

    def walker(self) -> ContextTree:
        inside = np.flatnonzero(self.inner)
        number = np.full(len(self.depth), -1)
        number[inside] = np.arange(len(inside))
        child = np.repeat(~(inside if len(inside) else np.zeros(1, int))[:, None], 256, 1).astype(np.int32)
        some = np.flatnonzero(self.parent >= 0)
        far = (self.context[some] >> (8 * (self.depth[some] - 1)).astype(np.uint64)).astype(np.int64) & 255
        child[number[self.parent[some]], far] = np.where(self.inner[some], number[some], ~some)
        return ContextTree(child, np.empty((0, 256), np.float32))


def tree_shape(depth: np.ndarray, context: np.ndarray) -> Shape:
    """From the depth and bytes of all contexts; any suffix of one is one, the empty one is added."""
    if not (depth == 0).any():
        depth, context = np.append(depth, 0), np.append(context, np.uint64(0))
    order = np.lexsort((context, depth))
    depth, context = depth[order].astype(int), context[order].astype(np.uint64)
    parent = np.full(len(depth), -1)
    for d in range(1, DEPTH + 1):
        mine, above = np.flatnonzero(depth == d), np.flatnonzero(depth == d - 1)
        if len(mine):
            parent[mine] = above[np.searchsorted(context[above], context[mine] & np.uint64((1 << 8 * (d - 1)) - 1))]
    inner = np.zeros(len(depth), bool)
    inner[parent[parent >= 0]] = True
    return Shape(depth, context, parent, inner)


def build_tree(shape: Shape, ended: np.ndarray) -> ContextTree:
    """The weighted tree from the byte counts (nodes x 256) at the places whose path ends in each node; the dense form
    of small trees, which tests hold ``pair_logs`` against.

    Every context and binary decision has a KT estimate of its own counts. A context's weighted probability is
    half its KT probability and half the product of those of the contexts one byte longer; training text
    whose longer context is no node makes one more part, a leaf. The trained tree is then read as a fixed
    model: a decision's probability is the mixture, over all depths of its path, of the KT predictions
    with the posterior weight of the path ending there.
    """
    depth, parent, inner = shape.depth, shape.parent, shape.inner
    nodes, rest, counts = len(depth), ended, ended.copy()
    for d in range(DEPTH, 0, -1):
        mine = np.flatnonzero(depth == d)
        np.add.at(counts, parent[mine], counts[mine])
    log_kt, log_rest = _blocked(lambda c: _log_kt(*_bits(c)), counts), _blocked(lambda c: _log_kt(*_bits(c)), rest)
    weighted = log_kt.copy()
    for d in range(DEPTH - 1, -1, -1):
        mine = np.flatnonzero((depth == d) & inner)
        below = np.flatnonzero(depth == d + 1)
        product = log_rest[mine]
        where = np.full(nodes, -1)
        where[mine] = np.arange(len(mine))
        np.add.at(product, where[parent[below]], weighted[below])
        weighted[mine] = np.logaddexp(log_kt[mine], product) - np.log(2)
    stop = np.where(inner[:, None], np.exp(log_kt - np.log(2) - weighted), 1.0)
    del log_kt, log_rest, weighted
    predict, predict_rest = _blocked(_next_one, counts), _blocked(_next_one, rest)
    del counts, rest
    said, left = np.zeros((nodes, 255)), np.ones((nodes, 255))
    for d in range(1, DEPTH + 1):
        mine = np.flatnonzero(depth == d)
        up = parent[mine]
        said[mine] = said[up] + left[up] * stop[up] * predict[up]
        left[mine] = left[up] * (1 - stop[up])
    # Ends of paths: contexts without longer ones, and of the others the part without a node.
    ended = said + left * np.where(inner[:, None], stop * predict + (1 - stop) * predict_rest, predict)
    del said, left, stop, predict, predict_rest
    logs = _blocked(_byte_logs, ended, np.float32)
    return ContextTree(shape.walker().child, logs)


def _decisions(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs x 8) of each pair: its context and the number of the binary decision in the lowest byte, and the bit decided."""
    byte, level = (value & np.uint64(255)).astype(np.int64)[:, None], np.arange(8)
    number = (1 << level) - 1 + (byte >> 8 - level)
    return (value & ~np.uint64(255))[:, None] | number.astype(np.uint64), (byte >> 7 - level & 1).astype(bool)


def _above(key: np.ndarray, depth: int) -> np.ndarray:
    """The keys (context, decision) with the last ``depth`` bytes of their contexts."""
    return key & np.uint64((1 << 64) - (1 << 8 * (8 - depth)) | 255)


@dataclass
class Level:
    """Decisions in the contexts of one length: keys, weight of ending there, KT prediction of a one, place in the level above."""

    key: np.ndarray
    stop: np.ndarray
    predict: np.ndarray
    up: np.ndarray | None = None

    def mixed(self, said: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the path has said up to here, and the weight left to longer contexts."""
        return said + left * self.stop * self.predict, left * (1 - self.stop)


def _climb(depth: int, top: int, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray, np.ndarray]:
    """Levels from ``depth`` to ``top``, and zeros, ones and log weighted probability of those of ``top``.

    ``product`` is the sum of the log weighted probabilities of the contexts one byte longer. A decision without
    counts, as of a context that training never saw, weighs 1 and predicts a half.
    """
    levels = []
    for d in range(depth, top - 1, -1):
        log_kt = _log_kt(zeros, ones)
        weighted = log_kt if d == DEPTH else np.logaddexp(log_kt, product) - np.log(2)
        stop = np.ones(len(key)) if d == DEPTH else np.exp(log_kt - np.log(2) - weighted)
        levels.append(Level(key, stop, (ones + 0.5) / (zeros + ones + 1)))
        if d > top:
            key, up = np.unique(_above(key, d - 1), return_inverse=True)
            levels[-1].up = up
            zeros, ones, product = (np.bincount(up, x, len(key)) for x in (zeros, ones, weighted))
    return levels, zeros, ones, weighted


def _subtree(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Level], np.ndarray, np.ndarray, np.ndarray]:
    """The levels below TOP of whole subtrees, with each pair's decisions as (places in the lowest level, bits)."""
    key, bit = _decisions(value)
    key, place = np.unique(key.ravel(), return_inverse=True)
    place, count = place.ravel(), np.repeat(n, 8)
    ones = np.bincount(place, count * bit.ravel(), len(key))
    zeros = np.bincount(place, count, len(key)) - ones
    return place.reshape(bit.shape), bit, *_climb(DEPTH, TOP + 1, key, zeros, ones, np.zeros(len(key)))


def _sums(value: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values and the sums of their counts."""
    value, place = np.unique(value, return_inverse=True)
    return value, *(np.bincount(place, c, len(value)).astype(np.int64) for c in counts)


def _packed(rows: np.ndarray, value: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    """Rising values and columns beside them in packs of so many rows: differences of values, all by byte planes, compressed."""
    end = np.cumsum(rows)
    first = (end - rows)[rows > 0]
    step = np.diff(value, prepend=value[:1])
    step[first] = value[first]
    planes = np.concatenate([c.view(np.uint8).reshape(len(c), c.itemsize).T for c in (step, *columns)])
    codec = pa.Codec("zstd", compression_level=1)
    return [codec.compress(planes[:, e - n : e].tobytes(), asbytes=True) for n, e in zip(rows.tolist(), end.tolist())]


def _unpacked(rows: int, pack: bytes, *kinds: type) -> tuple[np.ndarray, ...]:
    sizes = [8, *(np.dtype(k).itemsize for k in kinds)]
    body = pa.Codec("zstd").decompress(pack, rows * sum(sizes))
    planes, out, at = np.frombuffer(body, np.uint8).reshape(-1, rows), [], 0
    for size, kind in zip(sizes, (np.uint64, *kinds)):
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(kind).ravel())
        at += size
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _subtrees(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subtrees of sorted pairs, the last TOP + 1 bytes of their contexts, and how many pairs each has."""
    tree = value >> np.uint64(8 * (7 - TOP))
    first = np.flatnonzero(np.diff(tree, prepend=~tree[:1]))
    return tree[first], np.diff(first, append=len(tree))


def _by_bucket(value: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Buckets of sorted pairs, their numbers of rows and their packs."""
    tree, size = _subtrees(value)
    bucket = (mixed(tree) >> np.uint64(64 - BUCKETS)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    moved = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(value))
    bucket, first = np.unique(bucket[order], return_index=True)
    rows = np.add.reduceat(size, first) if len(first) else size
    return bucket, rows, _packed(rows, value[moved], *(c[moved] for c in columns))


PACK = {"bucket": "int", "learned": "boolean", "scored": "boolean", "rows": "int", "pack": "binary"}


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often pairs are in learned and in scored texts: a pack of (value, count) per chunk, kind of text and bucket."""
    held: dict[tuple[bool, bool], list[np.ndarray]] = {}
    size = 0

    def packs() -> Iterator[pa.RecordBatch]:
        for kind in list(held):
            yield _packs(*kind, held.pop(kind))
            give_back()

    for batch in batches:
        flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("learned", "scored")]
        for first, at, raw in utf8_steps(batch.column("text")):
            value = _pairs(at, lowered(raw))
            learned, scored = (np.repeat(f[first : first + len(at) - 1], np.diff(at)) for f in flags)
            for kind in ((True, True), (True, False), (False, True)):
                part = value[(learned == kind[0]) & (scored == kind[1])]
                if len(part):
                    held.setdefault(kind, []).append(part)
                    size += len(part)
            if size >= CHUNK:
                yield from packs()
                size = 0
    yield from packs()


def _packs(learned: bool, scored: bool, parts: list[np.ndarray]) -> pa.RecordBatch:
    value, end = np.empty(sum(map(len, parts)), np.uint64), 0
    while parts:
        part = parts.pop()
        value[end : end + len(part)] = part
        end += len(part)
    value.sort()
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(first, append=len(value)).astype(np.uint32)
    value = value[first]
    del first
    bucket, rows, packs = _by_bucket(value, count)
    columns = [pa.array(bucket), pa.array([learned] * len(rows)), pa.array([scored] * len(rows)), pa.array(rows, pa.int32()), pa.array(packs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=list(PACK))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(value, n, seen) of whole subtrees, merged from packs sorted by bucket: about RUN_PAIRS pairs at a time, or one larger subtree."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, last, look = 0, None, 8 * RUN_PAIRS
    for batch in batches:
        for bucket, learned, scored, size, pack in zip(*(batch.column(c).to_pylist() for c in PACK)):
            if bucket != last and rows >= RUN_PAIRS:
                yield from _cut(*_sums(*map(np.concatenate, zip(*held))))
                held, rows, look = [], 0, 8 * RUN_PAIRS
            value, count = _unpacked(size, pack, np.uint32)
            held.append((value, count * np.int64(learned), count * np.int64(scored)))
            rows, last = rows + size, bucket
            if rows >= look:  # the same pairs of many chunks
                held = [_sums(*map(np.concatenate, zip(*held)))]
                rows = len(held[0][0])
                look = max(8 * RUN_PAIRS, 2 * rows)
    if held:
        yield from _cut(*_sums(*map(np.concatenate, zip(*held))))


def _cut(value: np.ndarray, n: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    end = np.cumsum(_subtrees(value)[1])
    at = 0
    while at < len(value):
        to = max(np.searchsorted(end, at + RUN_PAIRS, "right") - 1, np.searchsorted(end, at, "right"))
        yield value[at : end[to]], n[at : end[to]], seen[at : end[to]]
        at = int(end[to])


SIZES = 8 * 64  # classes of how often a pair is seen, eight to each power of two


def _size(seen: np.ndarray) -> np.ndarray:
    """The class; pairs that no scored text holds are in class -1."""
    return np.where(seen > 0, np.floor(8 * np.log2(np.maximum(seen, 1))), -1).astype(np.int64)


SUMS = {"key": "long", "zeros": "double", "ones": "double", "weighted": "double", "sizes": "long"}
RUN = "rows int, pack binary, " + ", ".join(f"{c} array<{t}>" for c, t in SUMS.items())
LOGS = "bucket int, rows int, pack binary"


def _list(column: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.array(column))


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a run: the merged pairs, the sums (key, zeros, ones, weighted) of the decisions in the contexts of TOP bytes, and
    the number of pairs of each size class."""
    for value, n, seen in _runs(batches):
        _, _, levels, *counts = _subtree(value, n)
        key, up = np.unique(_above(levels[-1].key, TOP), return_inverse=True)
        size = _size(seen)
        columns = [signed(key), *(np.bincount(up, x, len(key)) for x in counts), np.bincount(size[size >= 0], minlength=SIZES)]
        pack = pa.array(_packed(np.array([len(value)]), value, n, seen), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([len(value)], pa.int32()), pack, *map(_list, columns)], names=["rows", "pack", *SUMS])


def _down(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """log10 of the probability of the byte in its context for the pairs of scored texts: a pack (value, log) of the frequent ones
    without a bucket, of the others one per bucket."""
    keys, top_said, top_left, least = shared.value
    for batch in batches:
        for rows, pack in zip(batch.column("rows").to_pylist(), batch.column("pack").to_pylist()):
            value, n, seen = _unpacked(rows, pack, np.int64, np.int64)
            place, bit, levels, *_ = _subtree(value, n)
            at = np.searchsorted(keys, _above(levels[-1].key, TOP))
            said, left = levels[-1].mixed(top_said[at], top_left[at])
            for level in reversed(levels[:-1]):
                said, left = level.mixed(said[level.up], left[level.up])
            one = said[place]
            logs = np.log10(np.where(bit, one, 1 - one)).sum(1).astype(np.float32)
            size = _size(seen)
            near, far = size >= least, (size >= 0) & (size < least)
            bucket, rows, packs = _by_bucket(value[far], logs[far])
            packs += _packed(np.array([near.sum()]), value[near], logs[near])
            columns = [pa.array([*bucket.tolist(), None], pa.int32()), pa.array([*rows.tolist(), near.sum()], pa.int32()), pa.array(packs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "pack"])


def pair_logs(texts: DataFrame) -> DataFrame:
    """Every distinct pair of a context of DEPTH bytes and the byte after it in the scored texts of ``texts(text, learned,
    scored)``, with log10 of the byte's probability under the tree of the learned texts: packs (bucket, rows,
    pack), those without a bucket of at most HEAD_PAIRS frequent ones.

    Every context that they hold is a node. Pairs are counted map-side first, sorted and packed; subtrees of the last TOP + 1
    bytes are merged and weighted in tasks, some whole ones at a time, and written so; the shorter contexts are weighted on
    the driver. A scored pair that was never learned has a count of 0, so it needs no search for its longest known context.
    """
    counted = texts.mapInArrow(_pair_counts, ", ".join(f"{c} {t}" for c, t in PACK.items()))
    runs = stage(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_up, RUN), "context-trees")
    sums = ("zeros", "ones", "weighted")
    top = runs.select(F.explode(F.arrays_zip("key", *sums)).alias("r")).select("r.*").groupBy("key").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    key = unsigned(top["key"].to_numpy())
    order = np.argsort(key)
    levels, *_ = _climb(TOP, 0, key[order], *(top[c].to_numpy()[order] for c in sums))
    said, left = levels[-1].mixed(np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key)))
    for level in reversed(levels[:-1]):
        said, left = level.mixed(said[level.up], left[level.up])
    held = np.zeros(SIZES, np.int64)
    for r in runs.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        held[r["pos"]] = r["n"]
    least = SIZES - int((np.cumsum(held[::-1]) <= HEAD_PAIRS).sum())
    shared = texts.sparkSession.sparkContext.broadcast((levels[0].key, said, left, least))
    return stage(runs.select("rows", "pack").mapInArrow(lambda b: _down(b, shared), LOGS), "pair-logs")


class PairTable:
    """Logarithms of pairs in an open hash table, at most half full."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)  # no pair, as no UTF-8 text has such bytes

    def __init__(self, pairs: int) -> None:
        self.bits = max(2 * pairs - 1, 1).bit_length()
        self.value, self.log = np.full(1 << self.bits, self.FREE), np.zeros(1 << self.bits, np.float32)

    def add(self, value: np.ndarray, log: np.ndarray) -> None:
        slot = self._slot(value)
        while len(value):
            free = self.value[slot] == self.FREE
            self.value[slot[free]] = value[free]
            left = self.value[slot] != value
            self.log[slot[~left]] = log[~left]
            value, log, slot = value[left], log[left], slot[left] + 1 & len(self.value) - 1

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return ((value ^ value >> np.uint64(29)) * np.uint64(BASE) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms, 0 for those not in the table, and which are in it."""
        slot = self._slot(value)
        held = self.value[slot]
        found = held == value
        logs = np.where(found, self.log[slot], np.float32(0)).astype(np.float64)
        todo = np.flatnonzero(~found & (held != self.FREE))
        slot, value = slot[todo], value[todo]
        while len(todo):
            slot = slot + 1 & len(self.value) - 1
            held = self.value[slot]
            hit = held == value
            logs[todo[hit]], found[todo[hit]] = self.log[slot[hit]], True
            more = ~hit & (held != self.FREE)
            todo, slot, value = todo[more], slot[more], value[more]
        return logs, found


def _head_pairs(packs: list[tuple[int, bytes]]) -> PairTable:
    """The table of packs, which are dropped one by one."""
    table = PairTable(sum(n for n, _ in packs))
    while packs:
        table.add(*_unpacked(*packs.pop(), np.float32))
    give_back()
    return table


ROW = {"_row": pa.int64(), "key": None, "n_tokens": pa.int64(), "head_known": pa.int64(), "head_log": pa.float64(), "tail": pa.list_(pa.int64()),
       "near": pa.float64(), "n_bytes": pa.int64(), "bucket": pa.int32(), "rows": pa.int32(), "pack": pa.binary()}


def _scored(batches: Iterator[pa.RecordBatch], shared, key: str) -> Iterator[pa.RecordBatch]:
    """Per text: log sum of head pairs, and of its words the tokens, known tokens and log sum of head words, the others as a list.
    In rows of their own, packs by bucket of (value, _row) of the pairs beyond the head."""
    hashes, counts, packs, unpacked = shared.value
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    names = [key if c == "key" else c for c in ROW]

    def asks(kind: pa.DataType) -> pa.RecordBatch:
        value, row = map(np.concatenate, zip(*asked))
        asked.clear()
        order = np.argsort(value)
        bucket, rows, packs = _by_bucket(value[order], row[order])
        nulls = [pa.nulls(len(rows), t or kind) for t in list(ROW.values())[:-3]]
        return pa.RecordBatch.from_arrays([*nulls, pa.array(bucket), pa.array(rows, pa.int32()), pa.array(packs, pa.binary())], names=names)

    if not unpacked:  # once a worker
        unpacked.append(_head_pairs(packs))
    table, hasher = unpacked[0], SpanHasher()
    seen = np.zeros(1 << 22, bool)
    seen[hashes & np.uint64((1 << 22) - 1)] = True
    log_count = np.log10(counts + 0.5)
    for batch in batches:
        for first, at, raw in utf8_steps(batch.column("text")):
            raw = lowered(raw)
            texts = len(at) - 1
            starts, ends, text = word_spans(at, raw)
            words = hasher(raw, starts, ends)
            maybe = np.flatnonzero(seen[words & np.uint64((1 << 22) - 1)])
            spot = np.minimum(np.searchsorted(hashes, words[maybe]), max(len(hashes) - 1, 0))
            hit = hashes[spot] == words[maybe] if len(hashes) else np.zeros(len(maybe), bool)
            head, spot = maybe[hit], spot[hit]
            tail = np.ones(len(words), bool)
            tail[head] = False
            cut = np.searchsorted(text[tail], np.arange(texts + 1)).astype(np.int32)
            pairs = _pairs(at, raw)
            logs, found = table.find(pairs)
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            number = batch.column("_row").slice(first, texts)
            asked.append((pairs[~found], np.repeat(number.to_numpy(), np.diff(at))[~found]))
            columns = [
                number,
                batch.column(key).slice(first, texts),
                pa.array(np.bincount(text, minlength=texts) + 1),
                pa.array(np.bincount(text[head], minlength=texts)),
                pa.array(np.bincount(text[head], log_count[spot], texts).astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(signed(words[tail]))),
                pa.array(sums[at[1:]] - sums[at[:-1]]),
                pa.array(np.diff(at)),
                *(pa.nulls(texts, t) for t in list(ROW.values())[-3:]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if sum(len(a[0]) for a in asked) >= FAR:
                yield asks(batch.column(key).type)
    if any(len(a[0]) for a in asked):
        yield asks(batch.column(key).type)


def _row_sums(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    row, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return row, np.bincount(place, np.concatenate([h[1] for h in held]), len(row))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs sorted by bucket, first of (value, log), then of asked (value, _row): packs of (_row, sum of logs), some texts each."""
    known: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = table = None
    size = 0

    def packs() -> pa.RecordBatch:
        row, log = _row_sums(held)
        held.clear()
        texts, rows = np.unique(row >> TEXTS, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(rows, pa.int32()), pa.array(_packed(rows, unsigned(row), log), pa.binary())], names=["texts", "rows", "pack"])

    for batch in batches:
        for bucket, asks, rows, pack in zip(*(batch.column(c).to_pylist() for c in ("bucket", "asks", "rows", "pack"))):
            if bucket != last:
                known, last, table = [], bucket, None
            if not asks:
                known.append(_unpacked(rows, pack, np.float32))
                continue
            if table is None:
                values, logs = map(np.concatenate, zip(*known))
                order = np.argsort(values)
                table = values[order], logs[order]
            value, row = _unpacked(rows, pack, np.int64)
            held.append((row, table[1][np.searchsorted(table[0], value)]))
            size += rows
            if size >= FAR:
                yield packs()
                size = 0
    if held:
        yield packs()


def _far_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, look = 0, FAR
    for batch in batches:
        for rows, pack in zip(batch.column("rows").to_pylist(), batch.column("pack").to_pylist()):
            value, log = _unpacked(rows, pack, np.float64)
            held.append((signed(value), log))
            size += rows
            if size >= look:
                held = [_row_sums(held)]
                size = len(held[0][0])
                look = max(FAR, 2 * size)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _row_sums(held)], names=["_row", "far_log"])


def score_documents(documents: DataFrame, training: DataFrame, key: str = "doc_id", learned: Column | None = None) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, n_bytes) for every row of ``documents(key, text)``.

    ``score`` is log10 of the text's probability under the context tree of ``training(text)``, over the UTF-8
    bytes with A-Z in lower case; ``-score * log2(10) / n_bytes`` is the code length per byte. ``base_score`` is the
    word unigram's: the words and one end, each (c + 0.5) / (N + 0.5 * (V + 1)).

    Word counts: the HEAD_WORDS most frequent are sent to the tasks, all rarer words are joined by hash (64
    bits), so every count is exact whatever the vocabulary. So it is with the logarithms of the tree: those of
    at most HEAD_PAIRS frequent pairs of a context and a byte are sent, all others are asked for and answered in packs. If ``training`` is
    the rows of ``documents`` where ``learned`` holds, both are counted in one pass. A null text is an empty one: one token, score
    0. A null key stays null, repeated rows are scored each, an empty table gives no rows, other columns are
    not read. Without training rows every byte has the probability of an untrained tree, 1/256.
    """
    spark = documents.sparkSession
    texts = training.select("text")
    counts = texts.mapInArrow(lambda b: _counts(b, _words(), "word"), "word long, n long")
    counts = stage(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    lines = texts.count()
    n, distinct = (n or 0) + lines, distinct + (lines > 0)
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    head = top.toArrow()
    hashes = unsigned(head["word"].to_numpy())
    order = np.argsort(hashes)
    if learned is None:
        both = texts.select("text", F.lit(True).alias("learned"), F.lit(False).alias("scored")).union(documents.select("text", F.lit(False), F.lit(True)))
    else:
        both = documents.select("text", F.coalesce(learned, F.lit(False)).alias("learned"), F.lit(True).alias("scored"))
    pairs = pair_logs(both)
    packs = [(r["rows"], bytes(r["pack"])) for r in pairs.where("bucket is null and rows > 0").select("rows", "pack").collect()]
    shared = spark.sparkContext.broadcast((hashes[order], head["n"].to_numpy()[order], packs, []))
    numbered = documents.select(F.monotonically_increasing_id().alias("_row"), key, "text")
    schema = keyed_schema(documents, key, "n_tokens long, head_known long, head_log double, tail array<long>, near double, n_bytes long, bucket int, rows int, pack binary")
    schema = StructType([*StructType.fromDDL("_row long").fields, *schema.fields])
    # Written once, so a row keeps its number.
    written = stage(numbered.mapInArrow(lambda b: _scored(b, shared, key), schema), "scored")
    rows = written.where("bucket is null").drop("bucket", "rows", "pack")
    tail = rows.select("_row", F.explode("tail").alias("word")).join(counts, "word", "left")
    sums = tail.groupBy("_row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("tail_log"), F.count("n").alias("tail_known"))
    asked = written.where("bucket is not null").select("bucket", F.lit(True).alias("asks"), "rows", "pack")
    asked = pairs.where("bucket is not null").select("bucket", F.lit(False).alias("asks"), "rows", "pack").union(asked)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", "asks").mapInArrow(_answers, "texts long, rows int, pack binary")
    far = answers.repartition("texts").mapInArrow(_far_sums, "_row long, far_log double")
    out = rows.drop("tail").join(sums, "_row", "left").join(far, "_row", "left")
    score = F.col("near") + F.coalesce("far_log", F.lit(0.0))
    space = float(np.log10(n + 0.5 * (distinct + 1)))
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + F.lit(float(np.log10(lines + 0.5))) - F.col("n_tokens") * F.lit(space)
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(lines > 0))
    return out.select(key, "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), "n_bytes")


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 1
    scored = score_documents(documents, documents.where(~held_out), learned=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
