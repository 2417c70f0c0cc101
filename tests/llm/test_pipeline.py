"""Which rows each pipeline stage keeps, against plain versions on the stage's own input."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from deskweave.llm import bpe, common, jaccard, language, mixing, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def survivors(rows):
    """doc_id and text of one row of each linked group, the smallest doc_id; rows without words all stay."""
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i]:
            key = (r["doc_id"] is None, r["doc_id"] or 0)
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted([k[1] if not k[0] else None for k in least.values()] + [r["doc_id"] for i, r in enumerate(rows) if not sets[i]], key=str)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    near = " ".join(f"word{i}" for i in range(60))
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t", "en", None, 3), (9004, near, "en", "s", 8), (9005, near + " tail", "en", "s", 8), (9006, "lead " + near, "en", "s", 8),
           (9007, "the same text once more today", "en", "s", 9), (9007, "the same text once more today", "en", "s", 9), (None, "the same text once more today", "en", "t", 9), (9008, "too short", "en", "t", 9)]
    return base.unionByName(spark.createDataFrame(odd, SCHEMA)).persist()


def test_language_keeps_what_the_filters_know(spark, docs):
    kept = pipeline.known_language(spark, docs, SF).collect()
    judged = language.identify(docs, language.fit_filters(language.training_rows(docs))).collect()
    assert ids(kept) == ids([r for r in judged if r["lang_pred"] != "und" and r["score"] >= language.LEAST_SCORE])
    letters = [r for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert set(ids(kept)) <= set(ids(letters)) and len(kept) >= 0.98 * len(letters)


def test_toxicity_drops_predicted(spark, docs):
    kept = pipeline.not_toxic(spark, docs, SF).collect()
    labels = toxicity.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert ids(kept) == ids([r for r in scored if r["predicted"] == 0])
    assert Counter(ids(kept)) <= Counter(ids(docs.collect())) and len(kept) >= 0.8 * docs.count()


def test_one_of_each_group_stays(spark, docs):
    kept = pipeline.no_near_duplicates(spark, docs, SF).collect()
    assert ids(kept) == survivors(docs.collect())
    assert Counter(tuple(r) for r in kept) <= Counter(tuple(r) for r in docs.collect())


def test_doubtful_keys_with_several_texts(spark):
    """A doc_id that loses with one text stays with another."""
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "q r s t u v w", "z"), (3, "q r s t u v w", "w"), (None, "a b c d e f g", "n"), (None, "h i j k l m", "m"), (4, None, "o"), (4, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    assert sorted(((r["doc_id"], r["text"], r["_h"]) for r in jaccard.one_per_component(df).collect()), key=str) == sorted(
        [(1, "a b c d e f g", "x"), (2, "q r s t u v w", "z"), (None, "h i j k l m", "m"), (4, None, "o"), (4, None, "o")], key=str)


def test_rows_that_stay_do_not_go_through_python(spark):
    rows = [(i, f"{'a b c d e' if i % 10 == 0 else f'w{i} x{i} y{i} z{i} v{i}'} f", "x") for i in range(60)] + [(None, "", "n"), (7, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _words string")
    kept = jaccard.one_per_component(df)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r["doc_id"] is None or r["doc_id"] % 10 or r["doc_id"] == 0)
    # What is left are the doubtful rows: once for those that are joined, once for those without words.
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_filter_agrees_with_its_python_form(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 600)
    rows = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    words = common.bit_filter(spark.createDataFrame([(int(h),) for h in hashes[:200]], "h long"), "h", 1 << 10)
    outside, inside = (sorted(r["h"] for r in part.collect()) for part in common.by_filter(rows, "h", words))
    hit = common.in_filter(hashes.view(np.uint64), words)
    assert inside == sorted(hashes[hit]) and outside == sorted(hashes[~hit]) and 200 <= len(inside) < 600


def test_workers_give_freed_memory_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda give=common.give_back: given.append(give()))
    batches = [pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["a b c d e f", None])}) for _ in range(3)]
    rows = [r for b in jaccard._signed_sets(iter(batches), "doc_id") for r in b.to_pylist()]
    assert [r["n_shingles"] for r in rows] == [2, 0] * 3 and len(given) == 3


def test_each_python_step_of_tokens_has_one_worker(spark, docs):
    plan = bpe.encode_repeated(docs.where("doc_id < 3"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [i for i, line in enumerate(plan) if "MapInArrow" in line]
    assert len(steps) == 3 and not any(b - a == 1 for a, b in zip(steps, steps[1:]))


def test_a_task_gives_back_what_it_held_to_its_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(alive)))
    alive = []

    def steps():
        alive.append(held := np.zeros(1))
        yield held
        alive.clear()

    assert len(list(common.giving_back(steps()))) == 1 and given == [0]


def test_languages_are_named_without_python_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(type(spark), "_createFromLocal", lambda *a: pytest.fail("rows through Python workers"))
    assert language.fit_filters(language.training_rows(docs)).langs


def test_counts_of_shingles_that_several_sets_hold():
    text = " ".join(f"w{i}" for i in range(40))
    batch = pa.record_batch({"text": pa.array([text, text + " tail", text, "a b c d e f", None])})
    got = Counter()
    for b in jaccard._bucket_counts(iter([batch, batch])):
        got.update(dict(zip(b["bucket"].to_pylist(), b["n"].to_pylist())))
    sets = {frozenset(s.tolist()) for at, raw in [(a, r) for _, a, r in common.utf8_steps(batch.column("text"))] for s in jaccard.Shingler().sets(at, raw) if len(s)}
    counts = Counter(m for s in sets for m in s)
    want = Counter()
    for m, n in counts.items():
        if n > 1:
            want[int(jaccard._bucket(np.array([m], np.uint64))[0])] += n
    assert got == want and sum(want.values()) == 72


def test_mix_repeats_documents(spark, docs):
    named = docs.selectExpr("*", "7 AS _copies", "'d' AS _d", "1 AS _s", "77 AS _copy", "3 AS _row", "2 AS of")
    taken = Counter(tuple(r) for r in mixing.repeated_documents(named).collect())
    copies = Counter()
    for r in mixing.mix_sources(docs).collect():
        copies[r["doc_id"], r["source"]] += r["copies"]
    want = Counter()
    for key, n in taken.items():
        want[key[0], key[3]] += n
    assert +copies == +want and all(k[-3:] == (77, 3, 2) for k in taken)
    assert mixing.repeated_documents(docs.where("false")).count() == 0


def test_tokens_repeat_with_documents(spark, docs):
    mixed = pipeline.mixed_sources(spark, docs, SF).persist()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in pipeline.token_ids(spark, mixed, SF).collect())
    with open(bpe.vocabulary_path(), "rb") as file:
        codec = bpe.Codec.of(file.read())
    want = Counter()
    for r in mixed.collect():
        encoded = codec.encode(r["text"] or "")
        want[r["doc_id"], len(encoded), np.asarray(encoded, "<u4").tobytes()] += 1
    assert got == want
    assert pipeline.token_ids(spark, mixed.where("false"), SF).count() == 0


def test_stages_take_empty_tables(spark, docs):
    none = docs.where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
        if name != "bpe":
            assert out.columns == none.columns
