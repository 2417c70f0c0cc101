"""Alignment of two tokenizers' tokens over the same bytes, by an associative composition of fragments.

A fragment stands for a byte range of one document. It holds an *open prefix* (tokens up to the first byte at
which tokens of both sides end), *closed groups*, and an *open suffix* (tokens after the last such byte); without
such a byte all its tokens are open. A token belongs to the range that holds its last byte. Two neighbours compose
by closing the group that the left suffix and the right prefix form, so fragments may be composed in any
grouping: within a task, and for very long documents as a tree across tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deskweave.llm.bpe import Codec, vocabulary_path
from deskweave.llm.common import read
from deskweave.llm.pieces import Pieces, Table, model_path, ragged
from deskweave.operators.staging import stage

SPAN = 1 << 16  # characters; a longer text is cut before spaces into spans of about this size, which any task may encode
CHUNK = 1 << 14  # bytes of a range that a fragment of a long span begins with
FAN = 8  # fragments that one step of the tree composes
STEP = 1 << 20  # bytes of short texts aligned at once
HEAD = 1 << 20  # pairs of ids whose counts every task gets; counts of all others are joined
MERGE = 1 << 19  # distinct pairs that a task holds before it hands their counts on

NO_IDS = np.empty(0, np.int64)


@dataclass(frozen=True)
class Fragment:
    """Ids of open tokens by side, and of the closed groups: their text, distinct pairs of linked ids with how often."""

    cut: bool = False
    first_a: np.ndarray = field(default_factory=lambda: NO_IDS)
    first_b: np.ndarray = field(default_factory=lambda: NO_IDS)
    last_a: np.ndarray = field(default_factory=lambda: NO_IDS)
    last_b: np.ndarray = field(default_factory=lambda: NO_IDS)
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: NO_IDS)
    times: np.ndarray = field(default_factory=lambda: NO_IDS)
    n_groups: int = 0
    n_links: int = 0
    n_a: int = 0
    n_b: int = 0
    same: bool = True  # both sides' bytes are the text's


FRAGMENT = "cut boolean, first_a binary, first_b binary, last_a binary, last_b binary, groups binary, pairs binary, times binary, n_groups long, n_links long, n_a long, n_b long, same boolean"
ARRAYS = ("first_a", "first_b", "last_a", "last_b", "pairs", "times")


class Aligner:
    """Both tokenizers and what follows from their vocabularies; made once per task."""

    def __init__(self, ranks: bytes, model: bytes) -> None:
        self.a, self.b = Codec.of(ranks), Pieces.of(model)
        self.width = self.b.size  # a pair of ids is a * width + b
        self.bytes_a = Table(self.a.bytes)
        most = max(len(self.a.bytes), self.b.size)
        self.text = Table([b"%d%s" % (i, s) for i in range(most) for s in (b",", b"|", b";")])

    def encoded(self, spans: Sequence[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of spans that begin with a space."""
        return [self.a.plain(s.decode()).astype(np.int64) for s in spans], [x.astype(np.int64) for x in self.b.parts(spans)]

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.bytes_a.length[a]), np.cumsum(self.b.surface.length[b])

    def same(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return self.bytes_a.joined(a).tobytes() == data and self.b.surface.joined(b).tobytes() == data

    def links(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, end, closing) of every link in order of bytes: an A and a B token overlap in exactly one stretch between
        neighbouring ends of either side. ``closing`` marks ends of both."""
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends, "left"), np.searchsorted(ends_b, ends, "left")
        both = (ends_a[np.minimum(at_a, len(ends_a) - 1)] == ends) & (ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends)
        return a[at_a] * self.width + b[at_b], ends, both

    def written(self, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text of ``n`` groups, each ``a1,a2|b1,b2;``, and the length of each; groups_* tell the group of each token."""
        many_a, many_b = np.bincount(groups_a, minlength=n), np.bincount(groups_b, minlength=n)
        through_a, through_b = np.cumsum(many_a), np.cumsum(many_b)
        items = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + (through_b - many_b)[groups_a]
        place_b = np.arange(len(b)) + through_a[groups_b]
        items[place_a], items[place_b] = a * 3, b * 3
        items[place_a[through_a - 1]] += 1
        items[place_b[through_b - 1]] += 2
        sizes = self.text.length[items]
        ends = np.cumsum(sizes)
        last = place_b[through_b - 1]
        return self.text.joined(items), np.diff(np.concatenate([[0], ends[last]]))

    # --- Fragments ------------------------------------------------------------------------------

    def fragment(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
        """The fragment of a range from the ids and ends of the tokens that end in it."""
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            return Fragment(first_a=a, first_b=b, n_a=len(a), n_b=len(b))
        low_a, low_b = np.searchsorted(ends_a, common[0]) + 1, np.searchsorted(ends_b, common[0]) + 1
        high_a, high_b = np.searchsorted(ends_a, common[-1]) + 1, np.searchsorted(ends_b, common[-1]) + 1
        out = Fragment(True, a[:low_a], b[:low_b], a[high_a:], b[high_b:], n_a=len(a), n_b=len(b))
        return replace(out, **self.closed(a[low_a:high_a], b[low_b:high_b], ends_a[low_a:high_a], ends_b[low_b:high_b]))

    def closed(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> dict:
        """What tokens between two common ends add to a fragment."""
        if not len(a):
            return {}
        pair, ends, both = self.links(a, b, ends_a, ends_b)
        common = ends[both]
        text, _ = self.written(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common))
        pairs, times = np.unique(pair, return_counts=True)
        return {"groups": text.tobytes(), "pairs": pairs, "times": times, "n_groups": len(common), "n_links": len(pair)}

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        """The fragment of both ranges; associative, and an empty fragment is neutral."""
        same = left.same and right.same
        sums = {"n_a": left.n_a + right.n_a, "n_b": left.n_b + right.n_b, "same": same}
        joined = lambda x, y: np.concatenate([x, y])
        if not right.cut:
            if not left.cut:
                return replace(left, first_a=joined(left.first_a, right.first_a), first_b=joined(left.first_b, right.first_b), **sums)
            return replace(left, last_a=joined(left.last_a, right.first_a), last_b=joined(left.last_b, right.first_b), **sums)
        if not left.cut:
            return replace(right, first_a=joined(left.first_a, right.first_a), first_b=joined(left.first_b, right.first_b), **sums)
        a, b = joined(left.last_a, right.first_a), joined(left.last_b, right.first_b)
        # Sides of other bytes than the text's have no tokens in the end; they need not close.
        between = Fragment(**self.closed(a, b, *self.ends(a, b))) if same and len(a) and len(b) else Fragment()
        parts = (left, between, right)
        pairs, times = merged([(x.pairs, x.times) for x in parts])
        return Fragment(
            True, left.first_a, left.first_b, right.last_a, right.last_b, b"".join(x.groups for x in parts), pairs, times,
            sum(x.n_groups for x in parts), sum(x.n_links for x in parts), **sums,
        )

    def folded(self, parts: Sequence[Fragment]) -> Fragment:
        """All parts in order, halves first."""
        while len(parts) > 1:
            parts = [reduce(self.compose, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else Fragment()

    def whole(self, fragment: Fragment) -> Fragment:
        """A document's fragment between its two ends, which are ends of both sides: all groups closed."""
        if not fragment.same:
            return Fragment(same=False)
        end = Fragment(True)
        return self.folded([end, fragment, end])

    def of_span(self, data: bytes, a: np.ndarray, b: np.ndarray) -> Fragment:
        """The fragment of a span from those of its byte ranges."""
        if not self.same(data, a, b):
            return Fragment(same=False)
        ends_a, ends_b = self.ends(a, b)
        borders = np.arange(CHUNK, len(data) + CHUNK, CHUNK)
        cut_a, cut_b = np.searchsorted(ends_a, borders, "right"), np.searchsorted(ends_b, borders, "right")
        parts, done_a, done_b = [], 0, 0
        for to_a, to_b in zip(cut_a.tolist(), cut_b.tolist()):
            parts.append(self.fragment(a[done_a:to_a], b[done_b:to_b], ends_a[done_a:to_a], ends_b[done_b:to_b]))
            done_a, done_b = to_a, to_b
        return self.folded(parts)

    # --- Many short texts -----------------------------------------------------------------------

    def of_texts(self, texts: Sequence[bytes]) -> list[Fragment]:
        """``whole`` of many texts that begin with a space; each is one range, and all are closed side by side."""
        ids_a, ids_b = self.encoded(texts)
        good = [i for i, (t, a, b) in enumerate(zip(texts, ids_a, ids_b)) if self.same(t, a, b)]
        out = [Fragment(same=False)] * len(texts)
        if not good:
            return out
        a, b = np.concatenate([ids_a[i] for i in good]), np.concatenate([ids_b[i] for i in good])
        ends_a, ends_b = self.ends(a, b)
        at = np.cumsum([len(texts[i]) for i in good])  # the end of a text is an end of both sides
        pair, ends, both = self.links(a, b, ends_a, ends_b)
        common = ends[both]
        raw, sizes = self.written(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common))
        through = np.searchsorted(common, at, "right")
        bytes_to = np.cumsum(sizes)[through - 1].tolist()
        links_to = np.searchsorted(ends, at, "right")
        space = self.width * len(self.a.bytes)
        owner = np.repeat(np.arange(len(good)), np.diff(np.concatenate([[0], links_to])))
        keys, times = np.unique(owner * space + pair, return_counts=True)
        pairs_to = np.searchsorted(keys, (np.arange(len(good)) + 1) * space).tolist()
        pairs = keys % space
        text = raw.tobytes()
        groups, links = np.diff(np.concatenate([[0], through])).tolist(), np.diff(np.concatenate([[0], links_to])).tolist()
        low, low_pair = 0, 0
        for k, i in enumerate(good):
            out[i] = Fragment(True, groups=text[low : bytes_to[k]], pairs=pairs[low_pair : pairs_to[k]], times=times[low_pair : pairs_to[k]],
                              n_groups=groups[k], n_links=links[k], n_a=len(ids_a[i]), n_b=len(ids_b[i]))
            low, low_pair = bytes_to[k], pairs_to[k]
        return out


def merged(counts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


# --- Rows ---------------------------------------------------------------------------------------

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def _packed_ids(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _packed_pairs(pairs: np.ndarray) -> bytes:
    """Sorted pairs as differences, compressed."""
    return len(pairs).to_bytes(8, "little") + pa.compress(np.diff(pairs, prepend=0).astype("<u4").tobytes(), "zstd", asbytes=True)


def _pairs(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), "<u4").astype(np.int64)) if n else NO_IDS


def _packed_times(times: np.ndarray) -> bytes:
    """One byte a count; larger ones are 255 there and follow in eight bytes each."""
    large = times >= 255
    return np.where(large, 255, times).astype(np.uint8).tobytes() + times[large].astype("<i8").tobytes()


def _times(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], "<i8")
    return out


def _aligned_columns(parts: Sequence[Fragment]) -> list[pa.Array]:
    longs = [pa.array([getattr(f, c) for f in parts], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return [*longs, pa.array([f.groups[:-1].decode() for f in parts], pa.string()),
            pa.array([_packed_pairs(f.pairs) for f in parts], pa.binary()), pa.array([_packed_times(f.times) for f in parts], pa.binary())]


ALIGNED_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
FRAGMENT_NAMES = [f.name for f in fields(Fragment)]


def _fragment_columns(parts: Sequence[Fragment]) -> list[pa.Array]:
    def column(name: str) -> pa.Array:
        values = [getattr(f, name) for f in parts]
        if name in ARRAYS:
            return pa.array([_packed_ids(x) for x in values], pa.binary())
        return pa.array(values, {"cut": pa.bool_(), "same": pa.bool_(), "groups": pa.binary()}.get(name, pa.int64()))

    return [column(name) for name in FRAGMENT_NAMES]


def _fragments(table: pa.Table | pa.RecordBatch) -> list[Fragment]:
    return [
        Fragment(**{k: np.frombuffer(v, "<i8").astype(np.int64) if k in ARRAYS else v for k, v in row.items()})
        for row in table.select(FRAGMENT_NAMES).to_pylist()
    ]


def _align_short(batches: Iterator[pa.RecordBatch], ranks, model) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(ranks.value, model.value)
    for batch in batches:
        for first, some in _runs(batch.column("text")):
            data = [f" {t}".encode() if t else b"" for t in some]
            full = [i for i, t in enumerate(data) if t]
            found = dict(zip(full, aligner.of_texts([data[i] for i in full])))
            parts = [found.get(i, Fragment()) for i in range(len(data))]
            kept = batch.slice(first, len(parts)).select(["row", "key"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *_aligned_columns(parts)], names=["row", "key", *ALIGNED_NAMES])


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of about STEP bytes, with the number of the first."""
    sizes = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(sizes[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + STEP, "right")))
        yield first, texts.slice(first, last - first).to_pylist()
        first = last


def spans_of(text: str, limit: int = SPAN) -> Iterator[str]:
    """Space + text, cut before spaces that follow a visible character: both sides have a token's end there."""
    data, begin = f" {text}", 0
    border = re.compile(r"(?<=\S) ")
    while len(data) - begin > limit:
        found = border.search(data, begin + limit)
        if not found:
            break
        yield data[begin : found.start()]
        begin = found.start()
    yield data[begin:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, key, text in zip(*(batch.column(c) for c in ("row", "key", "text"))):
            for first, spans in _few(spans_of(text.as_py())):
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * n, pa.int64()), pa.array([key.as_py()] * n, batch.schema.field("key").type),
                     pa.array(range(first, first + n), pa.int64()), pa.array(spans, pa.string())], names=["row", "key", "part", "span"])


def _few(items: Iterator[str], n: int = 16) -> Iterator[tuple[int, list[str]]]:
    some: list[str] = []
    first = 0
    for item in items:
        some.append(item)
        if len(some) == n:
            yield first, some
            first, some = first + n, []
    if some:
        yield first, some


def _align_spans(batches: Iterator[pa.RecordBatch], ranks, model) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(ranks.value, model.value)
    for batch in batches:
        for i in range(batch.num_rows):
            span = batch.column("span")[i].as_py().encode()
            (a,), (b,) = aligner.encoded([span])
            kept = batch.slice(i, 1).select(["row", "key", "part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *_fragment_columns([aligner.of_span(span, a, b)])], names=["row", "key", "part", *FRAGMENT_NAMES])


def align(documents: DataFrame, key: str = "doc_id", ranks_path: str | None = None, model: str | None = None) -> DataFrame:
    """One row per row of ``documents(key, text)``: (row, key, n_a, n_b, n_groups, n_links, groups, pairs, times).

    A is the byte-level vocabulary of ``ranks_path`` over space + text, B the piece model over text. ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct linked pairs a * (size of B) + b and ``times`` how often each is
    linked (``pairs_of`` unpacks both). ``row`` is unique.

    Short texts are aligned where they are read. Long ones are cut into spans that are dealt out, and the spans'
    fragments are composed as a tree, eight at a time, across tasks. Texts that are null or empty, or whose bytes one
    side does not give back, have zeros and an empty text. Null keys stay null, repeated rows are aligned each, an
    empty table gives no rows, other columns are not read.
    """
    spark = documents.sparkSession
    sent = []
    for path in (ranks_path or vocabulary_path(), model or model_path()):
        with open(path, "rb") as file:
            sent.append(spark.sparkContext.broadcast(file.read()))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "text")
    is_long = F.coalesce(F.length("text") > SPAN, F.lit(False))
    short = rows.where(~is_long).withColumn("row", F.col("row") * 2)
    head = StructType([StructField("row", LongType()), short.schema["key"]])
    aligned = short.mapInArrow(lambda b: _align_short(b, *sent), StructType([*head.fields, *StructType.fromDDL(ALIGNED).fields]))

    part = StructField("part", LongType())
    cut = rows.where(is_long).withColumn("row", F.col("row") * 2 + 1).mapInArrow(_cut, StructType([*head.fields, part, *StructType.fromDDL("span string").fields]))
    spans = stage(cut, "spans")
    most = spans.agg(F.max("part")).first()[0] or 0
    fragment = StructType([*head.fields, part, *StructType.fromDDL(FRAGMENT).fields])
    tree = spans.repartition("row", "part").mapInArrow(lambda b: _align_spans(b, *sent), fragment)

    def composed(table: pa.Table) -> pa.Table:
        aligner = Aligner(*(s.value for s in sent))
        table = table.sort_by("part")
        one = table.slice(0, 1)
        columns = [one["row"], one["key"], pa.array([one["part"][0].as_py() // FAN], pa.int64()), *_fragment_columns([aligner.folded(_fragments(table))])]
        return pa.Table.from_arrays(columns, names=["row", "key", "part", *FRAGMENT_NAMES])

    while most > 0:
        tree = tree.groupBy("row", F.expr(f"part div {FAN}").alias("_up")).applyInArrow(composed, fragment)
        most //= FAN

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*(s.value for s in sent))
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                done = [aligner.whole(f) for f in _fragments(one)]
                yield pa.RecordBatch.from_arrays([*one.select(["row", "key"]).columns, *_aligned_columns(done)], names=["row", "key", *ALIGNED_NAMES])

    return aligned.union(tree.mapInArrow(finished, aligned.schema))


# --- Counts over the corpus ---------------------------------------------------------------------


def pairs_of(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = _pairs(pairs)
    return found, _times(times, len(found))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs with the number of rows that hold each, summed over as many rows as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def handed() -> pa.RecordBatch:
        keys, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        for data in batch.column("pairs"):
            found = _pairs(data.as_py())
            held.append((found, np.ones(len(found), np.int64)))
            size += len(found)
            if size > MERGE:
                held = [merged(held)]
                size = len(held[0][0])
                if size > MERGE // 2:
                    yield handed()
                    held, size = [], 0
    if held:
        yield handed()


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): rows that hold the pair linked, and whether no pair of the same A id is in more.

    Pairs of one A id are at most as many as B has ids, so a window by A id stays small.
    """
    counts = aligned.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {width}"))))


def _level(n):
    return F.floor(F.log2(n) * 8)


def head_counts(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, n, best) of the commonest pairs, ``most`` at most: all from the lowest level of n on that keeps to it."""
    levels = counts.groupBy(_level("n").alias("level")).count().orderBy(F.desc("level")).collect()
    total, lowest = 0, None
    for level, n in levels:
        total += n
        if total > most:
            break
        lowest = level
    found = counts.where(F.lit(False) if lowest is None else _level("n") >= lowest).orderBy("pair").toArrow()
    return tuple(found[c].to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))


def _summed(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    keys, n, best = head.value
    tail = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
    for batch in batches:
        sums: list[tuple[int, int]] = []
        rest: list[list[dict]] = []
        for pairs, times in zip(batch.column("pairs"), batch.column("times")):
            found, often = pairs_of(pairs.as_py(), times.as_py())
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
            at, known = at[hit], often[hit]
            sums.append((int(known[best[at]].sum()), int((known * n[at]).sum())))
            rest.append([{"pair": p, "times": t} for p, t in zip(found[~hit].tolist(), often[~hit].tolist())])
        kept = batch.drop_columns(["pairs", "times"])
        columns = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns, pa.array(rest, tail)], names=[*kept.schema.names, "n_best", "count_sum", "tail"])


def with_counts(aligned: DataFrame, counts: DataFrame, most: int = HEAD) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times.

    Counts of the commonest pairs go to all tasks; rows ask for the others by a join. A pair that is joined is in few
    rows, so no key of that join is hot.
    """
    head = aligned.sparkSession.sparkContext.broadcast(head_counts(counts, most))
    schema = StructType([f for f in aligned.schema if f.name not in ("pairs", "times")])
    more = StructType.fromDDL("n_best long, count_sum long, tail array<struct<pair: bigint, times: bigint>>")
    rows = stage(aligned.mapInArrow(lambda b: _summed(b, head), StructType([*schema.fields, *more.fields])), "summed")
    asked = rows.select("row", F.inline("tail")).join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    joined = rows.drop("tail").join(asked, "row", "left")
    return joined.select(*schema.names, *[(F.col(c) + F.coalesce(d, F.lit(0))).alias(c) for c, d in (("n_best", "_best"), ("count_sum", "_sum"))])


def digests(documents: DataFrame) -> DataFrame:
    """Counts, digest of the groups, and how common the links of each document are in the whole corpus."""
    with open(model_path(), "rb") as file:
        width = Pieces.of(file.read()).size
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = stage(align(documents).withColumn("groups_sha256", groups).drop("groups"), "aligned")
    counts = stage(pair_counts(aligned, width), "pair-counts")
    return with_counts(aligned, counts).select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
