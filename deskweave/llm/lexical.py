"""Ranked lexical search over posting lists cut into geometric blocks.

Documents are gathered into segments. Within a segment every posting list longer than a block is clustered by the
similarity of its documents; a block keeps the greatest impact of every term among its documents. A question walks
its terms' lists from the greatest possible contribution down. A block is left out only when its summary, an
upper bound of what any of its documents can score, is below the score of the question's k-th document so far; so
the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from deskweave.llm.common import SpanHasher, lowered, read, utf8_steps, word_spans
from deskweave.llm.pieces import Table, ragged
from deskweave.operators.staging import stage

SEGMENT = 2048  # documents of a segment at most
CELLS = 1 << 23  # documents x terms of a segment at most, for one document's worth of slack
POSTINGS = 1 << 21  # entries of a segment at most, beyond its last document
BLOCK = 96  # documents of a block at most; a list that is not longer has no summaries
SKETCH = 32  # dimensions in which documents are compared to make blocks
SKETCHED = 256  # documents whose vectors are laid out at once
GROUP_BYTES = 1 << 20  # questions are sent to the tasks in groups of about this size
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _of_term() -> np.ndarray:
    """Which of the 256 bytes belong to a term: digits, letters, and all bytes of characters beyond ASCII."""
    table = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = True
    return table


def terms_in(text: str | None) -> list[bytes]:
    raw = lowered(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = word_spans(np.array([0, len(raw)]), raw, _of_term())
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


@dataclass(frozen=True)
class Vocabulary:
    """The terms of a group of questions; a term's id is its place."""

    terms: list[bytes]

    def finder(self) -> TermFinder:
        return TermFinder(self.terms)


class TermFinder:
    def __init__(self, terms: Sequence[bytes]) -> None:
        self.table, self.hasher, self.of_term = Table(list(terms)), SpanHasher(), _of_term()
        hashes = self.hasher(self.table.raw, self.table.start, self.table.start + self.table.length)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(terms):
            raise ValueError("Two terms have one hash; split the questions into other groups.")

    def __call__(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the known terms in texts, and how many terms of any kind each text has."""
        raw = lowered(raw)
        starts, ends, owner = word_spans(at, raw, self.of_term)
        n = np.bincount(owner, minlength=len(at) - 1)
        if not len(self.hashes) or not len(starts):
            return *(np.empty(0, np.int64),) * 3, n
        hashes = self.hasher(raw, starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        term = self.order[place]
        hit = np.flatnonzero((self.hashes[place] == hashes) & (self.table.length[term] == ends - starts))
        term, starts, owner, size = term[hit], starts[hit], owner[hit], (ends - starts)[hit]
        if len(hit):
            # Equal hashes are held against the terms' bytes.
            other = self.table.joined(term) != raw[ragged(starts, size)]
            if other.any():
                good = ~np.logical_or.reduceat(other, np.cumsum(size) - size)
                term, owner = term[good], owner[good]
        keys, counts = np.unique(owner * len(self.hashes) + term, return_counts=True)
        return keys // len(self.hashes), keys % len(self.hashes), counts, n


# --- Postings and statistics --------------------------------------------------------------------

POSTED = "lengths binary, entries binary, terms binary, counts binary, n_docs long, n_terms long"


def _posted(batches: Iterator[pa.RecordBatch], terms, key: str) -> Iterator[pa.RecordBatch]:
    finder = TermFinder(terms.value)
    most = max(1, min(SEGMENT, CELLS // max(1, len(terms.value))))
    held: list[tuple] = []
    docs = entries = n_docs = n_terms = 0

    def segment() -> pa.RecordBatch:
        keys = pa.concat_arrays([h[0] for h in held])
        columns = [np.concatenate([h[i] for h in held]) for i in range(1, 5)]
        packed = [pa.array([_squeezed(c)], pa.binary()) for c in columns]
        docs_column = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        sums = [pa.array([x], pa.int64()) for x in (n_docs, n_terms)]
        return pa.RecordBatch.from_arrays([docs_column, *packed, *sums], names=["docs", "lengths", "entries", "terms", "counts", "n_docs", "n_terms"])

    for batch in batches:
        for first, at, raw in utf8_steps(batch.column("text")):
            text, term, count, n = finder(at, raw)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            each = np.bincount(text, minlength=len(n))
            kept = np.flatnonzero(each)
            ends = np.cumsum(each)
            # As many documents as the segment has room for, then a new one.
            while len(kept):
                room = kept[: most - docs]
                low, high = ends[room[0]] - each[room[0]], ends[room[-1]]
                held.append((batch.column(key).slice(first, len(n)).take(pa.array(room)), n[room], each[room], term[low:high], count[low:high]))
                docs, entries, kept = docs + len(room), entries + int(high - low), kept[len(room) :]
                if docs >= most or entries >= POSTINGS:
                    yield segment()
                    held, docs, entries, n_docs, n_terms = [], 0, 0, 0, 0
            if not held and (n_docs or n_terms):
                held.append((batch.column(key).slice(0, 0), *(np.empty(0, np.int64),) * 4))
    if held:
        yield segment()


def _squeezed(values: np.ndarray) -> bytes:
    data = pa.py_buffer(np.ascontiguousarray(values if values.dtype == np.uint8 else values.astype("<i4")))
    return data.size.to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _bytes(data: pa.Buffer | bytes) -> bytes:
    data = pa.py_buffer(data)
    return pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), "zstd", asbytes=True)


def _ints(data: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(_bytes(data), "<i4").astype(np.int64)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms in batch.column("terms"):
            n = np.bincount(_ints(terms.as_py()))
            term = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n[term], pa.int64())], names=["term", "df"])


@dataclass(frozen=True)
class Statistics:
    n: int
    total: int
    weight: np.ndarray  # of each term of the vocabulary

    def length_norm(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths * self.n) // max(self.total, 1)


def statistics(posted: DataFrame, size: int) -> Statistics:
    """Counts over all documents; the vocabulary's document frequencies come to the driver, eight bytes a term."""
    n, total = posted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = posted.select("terms").mapInArrow(_term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {r["term"]: r["df"] for r in found}
    n, total = n or 0, total or 0
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)]
    return Statistics(n, total, np.array(weight, np.int64))


# --- Blocks -------------------------------------------------------------------------------------

INDEX = "entries binary, terms binary, impacts binary, lists binary, members binary, blocks binary, sizes binary, tops binary, summaries binary"
INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]


class Segment:
    """Forward rows, blocked lists and summaries of some documents; ``size`` terms in all."""

    def __init__(self, entries: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int) -> None:
        self.entries, self.terms, self.impacts, self.size = entries, terms, impacts, size
        self.starts = np.cumsum(entries) - entries

    @classmethod
    def built(cls, lengths: np.ndarray, entries: np.ndarray, terms: np.ndarray, counts: np.ndarray, known: Statistics) -> Segment:
        m = known.length_norm(lengths)
        doc = np.repeat(np.arange(len(entries)), entries)
        impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * m[doc])
        self = cls(entries, terms, impacts, len(known.weight))
        turn = np.argsort(terms, kind="stable")
        members = doc[turn]
        self.lists = np.bincount(terms, minlength=self.size)
        begin = np.cumsum(self.lists) - self.lists
        self.tops = np.zeros(self.size, np.int64)
        np.maximum.at(self.tops, terms, impacts)
        # Documents as vectors of what they can add to a question; in a few random directions, at length one.
        value = (impacts * known.weight[terms]).astype(np.float32)
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (self.size, SKETCH))
        sketch = np.empty((len(entries), SKETCH), np.float32)
        ends = self.starts + entries
        for low in range(0, len(entries), SKETCHED):
            high = min(low + SKETCHED, len(entries))
            own = slice(self.starts[low], ends[high - 1])
            dense = np.zeros((high - low, self.size), np.float32)
            dense[doc[own] - low, terms[own]] = value[own]
            sketch[low:high] = dense @ signs
        sketch /= np.linalg.norm(sketch, axis=1, keepdims=True) + 1e-9
        # Impacts in steps of a 255th of the term's greatest, rounded up, so that summaries stay upper bounds.
        steps = np.zeros((len(entries), self.size), np.uint8)
        steps[doc, terms] = -(-255 * impacts // np.maximum(self.tops[terms], 1))
        del value, doc
        sizes: list[np.ndarray] = []
        self.blocks = np.zeros(self.size, np.int64)
        long = np.flatnonzero(self.lists > BLOCK).tolist()
        for t in long:
            some = members[begin[t] : begin[t] + self.lists[t]]
            some[:], size = blocked(some, sketch, t)
            sizes.append(size)
            self.blocks[t] = len(size)
        # All summaries have their place before the first is made: no second copy of them is held.
        self.summaries = np.empty((int(self.blocks.sum()), self.size), np.uint8)
        first = 0
        for t, size in zip(long, sizes):
            at = begin[t]
            for n in size.tolist():
                np.max(steps[members[at : at + n]], axis=0, out=self.summaries[first])
                at, first = at + n, first + 1
        self.members = members
        self.sizes = np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)
        return self.placed()

    def placed(self) -> Segment:
        self.list_at = np.cumsum(self.lists) - self.lists
        self.block_at = np.cumsum(self.blocks) - self.blocks
        return self

    def packed(self) -> list[bytes]:
        return [_squeezed(getattr(self, name)) for name in INDEX_NAMES]

    @classmethod
    def unpacked(cls, columns: Sequence[bytes], size: int) -> Segment:
        values = {name: _ints(c) for name, c in zip(INDEX_NAMES[:-1], columns)}
        self = cls(values["entries"], values["terms"], values["impacts"], size)
        for name in ("lists", "members", "blocks", "sizes", "tops"):
            setattr(self, name, values[name])
        self.summaries = np.frombuffer(_bytes(columns[-1]), np.uint8).reshape(len(self.sizes), size)
        return self.placed()

    # --- Questions ------------------------------------------------------------------------------

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = self.entries[docs]
        at = ragged(self.starts[docs], n)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], np.cumsum(n) - n) if len(docs) else np.empty(0, np.int64)

    def answer(self, question: Question, keys: np.ndarray, missing: np.ndarray) -> None:
        """Bring the question's best documents up to date with this segment's."""
        terms, weights = question.terms, question.weights
        reach = weights * self.tops[terms]
        turn = np.argsort(-reach, kind="stable")
        turn = turn[reach[turn] > 0]
        rest = np.cumsum(reach[turn][::-1])[::-1]
        dense = np.zeros(self.size, np.int64)
        dense[terms] = weights
        done = np.zeros(len(self.entries), bool)

        def take(docs: np.ndarray) -> None:
            docs = docs[~done[docs]]
            done[docs] = True
            if len(docs):
                question.offer(self.scores(docs, dense), keys[docs], missing[docs])

        for i, term in enumerate(terms[turn].tolist()):
            # Documents not met so far hold none of the lists before this one.
            if rest[i] < question.least:
                question.skipped += int(self.blocks[terms[turn[i:]]].sum())
                break
            docs = self.members[self.list_at[term] : self.list_at[term] + self.lists[term]]
            if not self.blocks[term]:
                take(docs)
                continue
            later = terms[turn[i:]]
            own = slice(self.block_at[term], self.block_at[term] + self.blocks[term])
            most = -(-(self.summaries[own][:, later].astype(np.int64) * self.tops[later]) // 255)
            bounds = most @ weights[turn[i:]]
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            best = np.argsort(-bounds, kind="stable")
            low, width = 0, 1
            while low < len(best) and bounds[best[low]] >= question.least:
                some = best[low : low + width]
                some = some[bounds[some] >= question.least]
                take(docs[ragged(ends[some] - sizes[some], sizes[some])])
                question.visited += len(some)
                low, width = low + len(some), width * 2
            question.skipped += len(best) - low


def blocked(docs: np.ndarray, sketch: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A list's documents block by block, and the sizes of the blocks: each document goes to the most similar of some
    drawn from the list; what gathers more than a block is cut."""
    pivots = np.random.default_rng(seed).choice(docs, -(-len(docs) // BLOCK), replace=False)
    nearest = (sketch[docs] @ sketch[pivots].T).argmax(axis=1)
    turn = np.argsort(nearest, kind="stable")
    n = np.bincount(nearest)
    n = n[n > 0]
    sizes = [np.array([BLOCK] * (x // BLOCK) + [x % BLOCK] * (x % BLOCK > 0)) for x in n.tolist()]
    return docs[turn], np.concatenate(sizes)


class Question:
    """Terms with weights, repeats included, and the best k documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, k: int) -> None:
        self.terms, self.weights, self.k = terms, weights, k
        self.scores, self.keys, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.least = 1  # scores below it cannot be among the best
        self.visited = self.skipped = 0

    def offer(self, scores: np.ndarray, keys: np.ndarray, missing: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, keys, missing = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.keys, keys[good]), (self.missing, missing[good])))
        best = np.lexsort((keys, missing, -scores))[: self.k]
        self.scores, self.keys, self.missing = scores[best], keys[best], missing[best]
        if len(best) == self.k:
            self.least = max(1, int(self.scores[-1]))


def _indexed(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            if not len(batch.column("docs")[i]):
                continue
            segment = Segment.built(*(_ints(batch.column(c)[i].as_buffer()) for c in ("lengths", "entries", "terms", "counts")), known.value)
            packed = segment.packed()
            del segment
            yield pa.RecordBatch.from_arrays([batch.column("docs").slice(i, 1), *(pa.array([x], pa.binary()) for x in packed)], names=["docs", *INDEX_NAMES])
            pa.default_memory_pool().release_unused()


def _answered(batches: Iterator[pa.RecordBatch], asked, known, k: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of each question among all segments of a task."""
    weight = known.value.weight
    questions = []
    for number, terms, often in asked.value:
        good = weight[terms] > 0
        questions.append((number, Question(terms[good], (weight[terms] * often)[good], k)))
    for batch in batches:
        for i in range(batch.num_rows):
            segment = Segment.unpacked([batch.column(c)[i].as_buffer() for c in INDEX_NAMES], len(weight))
            keys = batch.column("docs")[i].values
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            values = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for _, question in questions:
                segment.answer(question, values, missing)
    for number, q in questions:
        if len(q.scores):
            docs = pa.array(q.keys, pa.int64(), mask=q.missing)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(q.scores), pa.int64()), docs, pa.array(q.scores)], names=["_q", "doc", "score"])


def block_index(documents: DataFrame, vocabulary: Vocabulary, key: str) -> tuple[DataFrame, Statistics]:
    """The written index of all documents for the terms of a vocabulary, one row a segment, and the statistics."""
    context = documents.sparkSession.sparkContext
    terms = context.broadcast(vocabulary.terms)
    docs = StructField("docs", ArrayType(documents.schema[key].dataType))
    rows = documents.select(key, "text")
    posted = stage(rows.mapInArrow(lambda b: _posted(b, terms, key), StructType([docs, *StructType.fromDDL(POSTED).fields])), "postings")
    known = statistics(posted, len(vocabulary.terms))
    sent = context.broadcast(known)
    index = posted.mapInArrow(lambda b: _indexed(b, sent), StructType([docs, *StructType.fromDDL(INDEX).fields]))
    return stage(index, "block-index"), known


def search(documents: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(item, rank, doc, score): for every row of ``items(item, text)`` its k best rows of ``documents(key, text)``.

    Items are worked off in groups of about a megabyte of text, each against an index of the terms it uses; the index
    is written once per group and is in proportion to the postings of these terms. Per group the driver holds the
    questions and the statistics of their terms.

    Null texts have no terms; an item without terms, or whose terms no document holds, has no rows. Equal scores go by
    ascending key, null keys last. Repeated rows of documents and of items count each by itself. Very long texts are
    one document of one segment. Empty tables give no rows; other columns are not read. ``key`` is an integer column.
    """
    spark = documents.sparkSession
    asked = stage(items.select(F.monotonically_increasing_id().alias("_q"), F.col(item).alias("_item"), "text"), "questions")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // GROUP_BYTES)
    found = [_searched(documents, asked.where(F.pmod(F.xxhash64("_q"), F.lit(g_n)) == g), k, key) for g_n in [max(groups, 1)] for g in range(groups)]
    if not found:
        return spark.createDataFrame([], StructType([items.schema[item], *StructType.fromDDL("rank int, doc long, score long").fields]))
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("_q", "_item"), "_q").select(F.col("_item").alias(item), "rank", "doc", "score")


def _searched(documents: DataFrame, asked: DataFrame, k: int, key: str) -> DataFrame:
    context = documents.sparkSession.sparkContext
    texts = {r["_q"]: terms_in(r["text"]) for r in asked.toLocalIterator()}
    vocabulary = Vocabulary(sorted({t for terms in texts.values() for t in terms}))
    place = {t: i for i, t in enumerate(vocabulary.terms)}
    questions = []
    for number, terms in texts.items():
        ids, often = np.unique(np.array([place[t] for t in terms], np.int64), return_counts=True)
        questions.append((number, ids, often))
    index, known = block_index(documents, vocabulary, key)
    sent, stats = context.broadcast(questions), context.broadcast(known)
    return index.mapInArrow(lambda b: _answered(b, sent, stats, k), "_q long, doc long, score long")


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("doc", "doc_id")


OP11_SQL = r"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sums AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, coalesce(sum(len(terms)), 0)::BIGINT AS total FROM low
), tf AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM low) GROUP BY row_no, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN sums GROUP BY term, docs
), asked AS (
  SELECT item_id, row_number() OVER () AS item_no,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), items AS (
  SELECT item_no, item_id, term, count(*) AS times FROM asked GROUP BY item_no, item_id, term
), norms AS (
  SELECT row_no, doc_id, 100 - 25 + (25 * len(terms) * docs) // total AS m FROM low CROSS JOIN sums WHERE len(terms) > 0
), scored AS (
  SELECT item_no, item_id, doc_id, row_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (row_no) GROUP BY item_no, item_id, doc_id, row_no
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
