"""Toxicity scores from a logistic model that is penalised for reacting to swapped identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm.common import SpanHasher, fold, keyed_schema, lowered, mixed, read, signed, texts_of, unsigned, utf8_steps, word_spans

# Bounds of what the model is fitted on and of the model itself; the corpus is never sampled for scoring.
MOST_LABELLED = 20_000  # rows of each class, those with the smallest hash of doc_id
MOST_FEATURES = 8_192
LEAST_TEXTS = 3  # of the sample that must hold a feature
PREFIXES = (4, 5, 6, 8)  # bytes of a word's beginning that are features beside the whole word
ROUNDS = 150
RIDGE = 1.0  # divided by the number of rows, as a prior of fixed strength
SWAP_PENALTY = 1.0
THRESHOLD = 0.7

# Groups of terms that may stand for each other; a swap replaces a term by the next one of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"),
    ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"),
    ("chrétien", "musulman", "juif", "athée"), ("homme", "femme"), ("hommes", "femmes"),
    ("christ", "moslem", "jude", "atheist"), ("mann", "frau"), ("männer", "frauen"),
    ("cristiano", "musulmán", "judío", "ateo"), ("hombre", "mujer"), ("hombres", "mujeres"),
)


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


class Featurizer:
    """Hashes of a text's words and of their beginnings."""

    def __init__(self) -> None:
        self.hasher = SpanHasher()
        self.letters = _letters()

    def features(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = lowered(raw)
        starts, ends, text = word_spans(at, raw, self.letters)
        found, owner = [self.hasher(raw, starts, ends)], [text]
        for n in PREFIXES:
            long = ends - starts >= n
            found.append(mixed(self.hasher(raw, starts[long], starts[long] + n) + np.uint64(n)))
            owner.append(text[long])
        return np.concatenate(found), np.concatenate(owner)

    def of(self, text: str) -> np.ndarray:
        data = text.encode()
        return np.unique(self.features(np.array([0, len(data)]), np.frombuffer(data, np.uint8))[0])


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> dict[str, str]:
    """Each term's replacement: the next one of its group."""
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, texts): in how many of the task's labelled texts a feature occurs."""
    make = Featurizer()
    parts: list[np.ndarray] = []
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        for first, at, raw in utf8_steps(batch.column("text")):
            hashes, text = make.features(at, raw)
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, mine = hashes[new], toxic[first + text[new]]
            values, inverse = np.unique(hashes, return_inverse=True)
            parts.append(np.stack([values, np.bincount(inverse, mine, len(values)).astype(np.uint64), np.bincount(inverse, ~mine, len(values)).astype(np.uint64)]))
            if len(parts) >= 16:
                parts = [_merged(parts)]
    if parts:
        values, yes, no = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(signed(yes)), pa.array(signed(no))], names=["feature", "yes", "no"])


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    values, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate([p[k] for p in parts]).astype(float), len(values)).astype(np.uint64) for k in (1, 2)]
    return np.stack([values, *sums])


class Vocabulary:
    """Positions of the model's features among any hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once."""
        size = max(len(self.hashes), 1)
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = self.seen[hashes & np.uint64((1 << 20) - 1)]
        hashes, owner = hashes[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), size - 1)
        hit = self.hashes[at] == hashes
        pairs = np.unique(owner[hit].astype(np.int64) * size + at[hit])
        return pairs // size, pairs % size


def _sparse(batches: Iterator[pa.RecordBatch], words: Vocabulary, swap: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The sample as rows (toxic, features, of the text with swapped identity terms or null)."""
    import re

    make = Featurizer()
    terms = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(swap, key=len, reverse=True))) + r")(?!\w)", re.IGNORECASE) if swap else None
    for batch in batches:
        toxic, texts = batch.column("toxic").to_pylist(), batch.column("text")
        rows: list[list] = [[], [], []]
        for first, at, raw in utf8_steps(texts):
            owner, found = words.find(*make.features(at, raw))
            cut = np.searchsorted(owner, np.arange(len(at)))
            for i in range(len(at) - 1):
                text = texts[first + i].as_py() or ""
                other = terms.sub(lambda m: swap[m.group().lower()], text) if terms else text
                rows[0].append(int(toxic[first + i]))
                rows[1].append(found[cut[i] : cut[i + 1]])
                hashes = make.of(other) if other != text else None
                rows[2].append(None if hashes is None else words.find(hashes, np.zeros(len(hashes), np.int64))[1])
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.int64()))], names=["toxic", "found", "swapped"])


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, words: Vocabulary, at: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        text, found = words.find(hashes, owner)
        z = self.bias + np.bincount(text, self.weights[found], len(at) - 1) if len(self.hashes) else np.full(len(at) - 1, self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _solve(rows: pa.Table, width: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weighted logistic loss plus ridge plus ``penalty`` times the mean square of the change that swapping makes.

    Each step is scaled per feature by the curvature's diagonal bound, with momentum.
    """
    y = rows["toxic"].to_numpy().astype(float)
    weight = rows["weight"].to_numpy()
    weight = weight / weight.sum()
    lists = rows["found"].combine_chunks()
    col = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    # Differences of the swapped texts: +1 where a feature goes, -1 where one comes.
    d_row, d_col, d_val = [], [], []
    pairs, ridge = 0, RIDGE / max(len(y), 1)
    for mine, other in zip(rows["found"].to_pylist(), rows["swapped"].to_pylist()):
        if other is not None:
            gone, come = set(mine) - set(other), set(other) - set(mine)
            d_row += [pairs] * (len(gone) + len(come))
            d_col += [*gone, *come]
            d_val += [1.0] * len(gone) + [-1.0] * len(come)
            pairs += 1
    d_row, d_col, d_val = np.array(d_row, int), np.array(d_col, int), np.array(d_val)
    w, b = np.zeros(width), float(np.log((weight @ y + 1e-6) / (weight @ (1 - y) + 1e-6)))
    per_row = np.bincount(row, minlength=len(y))
    scale = 0.25 * np.bincount(col, (weight * np.sqrt(per_row + 1))[row], width) + ridge
    if pairs:
        touched = np.bincount(d_row, np.abs(d_val), pairs)
        scale += penalty * 2 * np.bincount(d_col, touched[d_row], width) / pairs
    b_scale = 0.25 * float(weight @ np.sqrt(per_row + 1))
    w_old, b_old = w, b
    for t in range(ROUNDS):
        pull = t / (t + 3)
        wy, by = w + pull * (w - w_old), b + pull * (b - b_old)
        z = by + np.bincount(row, wy[col], len(y))
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        slope = np.bincount(col, miss[row], width) + ridge * wy
        if pairs:
            change = np.bincount(d_row, d_val * wy[d_col], pairs)
            slope += penalty * 2 * np.bincount(d_col, d_val * change[d_row], width) / pairs
        w_old, b_old = w, b
        w, b = wy - slope / scale, by - miss.sum() / b_scale
    return w, b


def fit_toxicity(documents: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Fit on texts of ``documents(doc_id, text)`` with a label in ``labels(doc_id, toxic)``.

    At most ``MOST_LABELLED`` rows of each class are used, those with the smallest hash of doc_id (one
    sample whatever the partitioning); classes weigh as all labelled rows do. A doc_id with several labels is
    toxic if one says so; null labels and doc_ids are ignored. Features are the ``MOST_FEATURES`` words
    and beginnings whose presence tells most, and those of the identity terms. Every sampled text with an identity term
    gets a copy with all terms swapped; the squared change of the linear score is added to the loss.
    Without any labelled row every score is 0.
    """
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = labelled.withColumn("toxic", F.col("toxic") > 0).persist()
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labelled.where("toxic").orderBy(*order).limit(MOST_LABELLED).union(labelled.where("not toxic").orderBy(*order).limit(MOST_LABELLED))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counts = texts.mapInArrow(_counted, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    n = {k: max(min(v, MOST_LABELLED), 1) for k, v in {True: 0, False: 0, **sizes}.items()}
    rate = lambda c, k: (F.col(c) + 0.5) / F.lit(n[k] + 1.0)
    gap = F.abs(rate("yes", True) - rate("no", False)) / F.sqrt(rate("yes", True) + rate("no", False))
    top = counts.where(F.col("yes") + F.col("no") >= LEAST_TEXTS).orderBy(gap.desc(), "feature").limit(MOST_FEATURES).select("feature")
    make = Featurizer()
    swap = swaps(groups)
    hashes = unsigned(np.array([r["feature"] for r in top.collect()], np.int64))
    hashes = np.unique(np.concatenate([hashes, *(make.of(term) for term in swap)]))
    words = Vocabulary(hashes)
    rows = texts.mapInArrow(lambda b: _sparse(b, words, swap), "toxic long, found array<long>, swapped array<long>").toArrow()
    labelled.unpersist()
    if not rows.num_rows:
        return ToxicityModel(hashes[:0], np.empty(0), -35.0)
    each = {k: sizes.get(k, 0) / max(min(sizes.get(k, 0), MOST_LABELLED), 1) for k in (True, False)}
    toxic = rows["toxic"].to_numpy()
    rows = rows.append_column("weight", pa.array(np.where(toxic > 0, each[True], each[False])))
    weights, bias = _solve(rows, len(hashes), penalty)
    return ToxicityModel(hashes, weights, bias)


def _scored(batches: Iterator[pa.RecordBatch], shared, key: str) -> Iterator[pa.RecordBatch]:
    model = ToxicityModel(**shared.value)
    words, make = Vocabulary(model.hashes), Featurizer()
    for batch in batches:
        for first, at, raw in utf8_steps(texts_of(batch)):
            score = model.scores(words, at, *make.features(at, raw))
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, len(score)), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])


def score_toxicity(documents: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) for every row: the whole text counts, a feature once however often it occurs.

    Null and empty texts get the model's score of a text without features. A null key stays null, repeated rows
    are scored each, an empty table gives no rows, other columns are not read. Only the model (bounded by
    ``MOST_FEATURES`` and the identity terms) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    schema = keyed_schema(documents, key, "score double, predicted int")
    columns = [key] if key == "_row" else [key, "text"]
    return documents.select(*columns).mapInArrow(lambda b: _scored(b, shared, key), schema)


def without_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all columns, that the model does not predict to be toxic."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"))
    return score_toxicity(rows, model, "_row").where("predicted = 0").select("_row.*")


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit_toxicity(documents, training_labels(read(spark, sf_dir, "labels")))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
