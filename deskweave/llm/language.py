"""Language identification with n-gram filters whose slots hold one bit per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskweave.llm.common import fold, keyed_schema, mixed, read, signed, texts_of, unsigned, utf8_steps

GRAM = 4  # bytes
HASHES = 3
SHARE = 0.5  # of its highest rate in any language that a gram needs to count as one of a language
LEAST = 2  # times that a gram must occur in a language
SLOTS_PER_GRAM = 8
MOST_SLOTS = 1 << 22  # bound of what is sent to the tasks: 8 bytes a slot and 62 languages
PLANE_BITS = 62
UNDETERMINED = "und"
LEAST_SCORE = 0.2  # of a text that counts as written in a language; half-mixed texts have 0.4


def _grams(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All grams with a letter, and their texts' numbers. Case of A-Z is dropped; a run of other bytes that
    are no letters is white space; each text has white space on both sides."""
    kind = np.full(256, 0x20, np.uint8)
    kind[0x61:0x7B] = np.arange(0x61, 0x7B)
    kind[0x41:0x5B] = np.arange(0x61, 0x7B)
    kind[0x80:] = np.arange(0x80, 0x100)
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    stream = np.full(len(raw) + GRAM * len(size) + GRAM, 0x20, np.uint8)
    stream[np.arange(len(raw)) + GRAM * text + 1] = kind[raw]
    packed = np.zeros(len(stream) - GRAM, np.uint64)
    for k in range(GRAM):
        packed |= stream[k : k + len(packed)].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(size)), size + GRAM)
    within = np.arange(len(packed)) - np.repeat(at[:-1] + GRAM * np.arange(len(size)), size + GRAM)
    good = (within <= np.repeat(size, size + GRAM)) & (packed != np.uint64(int.from_bytes(b" " * GRAM, "little")))
    return packed[good], owner[good]


def _slots(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (mixed(grams + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(slots - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, lang, n): counts of a task, merged before they leave it."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, at, raw in utf8_steps(batch.column("text")):
            grams, text = _grams(at, raw)
            named = langs[first : first + len(at) - 1]
            for lang in set(named):
                mine = grams[(named == lang)[text]]
                held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
                if len(held[lang]) >= 16:
                    held[lang] = [merge(held[lang])]
    for lang, parts in held.items():
        grams, n = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array([lang] * len(grams), pa.string()), pa.array(n)], names=["gram", "lang", "n"])


def _slot_rows(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = unsigned(batch.column("gram").to_numpy())
        for at in _slots(grams, slots):
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("plane"), batch.column("mask")], names=["slot", "plane", "mask"])


@dataclass
class LanguageFilters:
    """Slots of all languages' Bloom filters side by side: one read gives all languages of a slot."""

    langs: list[str]
    planes: np.ndarray  # planes x slots
    usual: int  # the language with most training text

    def miss_rates(self) -> np.ndarray:
        """Probability that a gram of no language passes a language's filter."""
        filled = [((self.planes[i // PLANE_BITS] >> (i % PLANE_BITS)) & 1).mean() for i in range(len(self.langs))]
        return np.array(filled) ** HASHES

    def hits(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and how many of them each language's filter holds (texts x languages)."""
        grams, text = _grams(at, raw)
        texts = len(at) - 1
        total = np.bincount(text, minlength=texts)
        out = np.zeros((texts, len(self.langs)))
        slots = list(_slots(grams, self.planes.shape[1]))
        for p, plane in enumerate(self.planes):
            found = plane[slots[0]]
            for more in slots[1:]:
                found &= plane[more]
            for i in range(p * PLANE_BITS, min(len(self.langs), (p + 1) * PLANE_BITS)):
                out[:, i] = np.bincount(text[(found >> (i % PLANE_BITS)) & 1 == 1], minlength=texts)
        return total, out


def fit_filters(documents: DataFrame) -> LanguageFilters:
    """Learn from all rows of ``documents(text, lang)`` with both; grams are counted map-side first.

    A gram is one of a language if it occurs there ``LEAST`` times and at ``SHARE`` or more of the rate of the
    language in which it is most usual. The filter has ``SLOTS_PER_GRAM`` slots a gram, ``MOST_SLOTS`` at most;
    beyond that it is only fuller, and the correction for false positives grows.
    """
    known = documents.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInArrow(_counted, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = sorted(counts.groupBy("lang").agg(F.sum("n").alias("words")).collect())
        langs = [r["lang"] for r in totals]
        if not langs:
            return LanguageFilters([], np.zeros((1, 1), np.int64), 0)
        spark = documents.sparkSession
        # From Arrow: a table of Python rows would go through Python workers of another kind, which stay beside those of the tasks.
        names = {"lang": langs, "plane": [i // PLANE_BITS for i in range(len(langs))], "mask": [1 << (i % PLANE_BITS) for i in range(len(langs))], "words": [float(r["words"]) for r in totals]}
        kinds = pa.schema([("lang", pa.string()), ("plane", pa.int64()), ("mask", pa.int64()), ("words", pa.float64())])
        rated = counts.join(F.broadcast(spark.createDataFrame(pa.table(names, kinds))), "lang")
        rated = rated.withColumn("rate", F.col("n") / F.col("words"))
        rated = rated.withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
        rated = rated.where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("best"))).groupBy("gram", "plane").agg(F.bit_or("mask").alias("mask"))
        slots = 1 << (max(counts.select("gram").distinct().count() * SLOTS_PER_GRAM, 2) - 1).bit_length()
        slots = min(slots, MOST_SLOTS)
        rows = rated.mapInArrow(lambda b: _slot_rows(b, slots), "slot long, plane long, mask long")
        rows = rows.groupBy("slot", "plane").agg(F.bit_or("mask").alias("mask")).toArrow()
    finally:
        counts.unpersist()
    planes = np.zeros((len(langs) // PLANE_BITS + 1, slots), np.int64)
    planes[rows["plane"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return LanguageFilters(langs, planes, int(np.argmax([r["words"] for r in totals])))


def _judged(batches: Iterator[pa.RecordBatch], shared, extra: list[str]) -> Iterator[pa.RecordBatch]:
    filters = LanguageFilters(**shared.value)
    miss = filters.miss_rates()
    names = np.array([*filters.langs, UNDETERMINED], object)
    plain = np.zeros(256, bool)
    plain[0x41:0x5B] = plain[0x61:0x7B] = True
    for batch in batches:
        texts = texts_of(batch)
        for first, at, raw in utf8_steps(texts):
            total, hits = filters.hits(at, raw)
            n = np.maximum(total, 1)
            if filters.langs:
                true = np.clip((hits - total[:, None] * miss) / np.maximum(1 - miss, 1e-9), 0, None) / n[:, None]
                best = true.argmax(1)
                score = np.minimum(true[np.arange(len(n)), best], 1.0)
                best[score <= 0] = filters.usual
            else:
                best, score = np.zeros(len(n), int), np.zeros(len(n))
            lettered = np.add.reduceat(np.append(plain[raw], False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) > 0
            for i in np.flatnonzero(~lettered):
                text = texts[first + int(i)].as_py()
                if not any(map(str.isalpha, text or "")):
                    best[i], score[i] = len(filters.langs), 0.0
            kept = [batch.column(c).slice(first, len(n)) for c in extra]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*extra, "lang_pred", "score"])


def identify(documents: DataFrame, filters: LanguageFilters, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row: the language whose filter holds most of the text's grams.

    Counts are corrected for each filter's false positives; ``score`` is the corrected share of all grams.
    Only the whole text is read, in steps, so long texts need little memory. ``und`` and score 0 if the text is
    null or has no letter. A text with letters but without a known gram gets the language with most
    training text and score 0. Ties go to the language that sorts first. A null key stays null; repeated rows
    are judged each; an empty table gives no rows; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(filters))
    schema = keyed_schema(documents, key, "lang_pred string, score double")
    columns = [key] if key == "_row" else [key, "text"]
    return documents.select(*columns).mapInArrow(lambda b: _judged(b, shared, [key]), schema)


def in_known_language(documents: DataFrame, filters: LanguageFilters, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all columns, whose text is in a learned language: not ``und``, and a share of ``least`` of
    the grams, or more, known to the language."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"))
    judged = identify(rows, filters, "_row")
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("_row.*")


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(fold(F.col("doc_id"), 5) != 0)


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    judged = identify(documents, fit_filters(training_rows(documents)))
    return judged.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
