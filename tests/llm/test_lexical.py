"""Blocked search against a plain scorer, its bounds, and its odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from deskweave.llm import lexical

SF = "/root/testdata/sf0.001"
WORDS = ["river", "Stone", "été", "x1", "日本", "the", "of", "and", "Blue", "7"]


def terms(text):
    return re.findall(lexical.TERM_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, items, k=20):
    docs = [(key, Counter(terms(text))) for key, text in documents]
    n = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in docs:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(str(item), rank, key, -s) for rank, (s, _, key) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([(str(r["item_id"]), r["rank"], r["doc"], r["score"]) for r in df.collect()], key=str)


def frames(spark, documents, items):
    return spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def rows():
    random.seed(4)
    docs = [(i, " ".join(random.choices(WORDS, weights=range(1, 11), k=random.randrange(1, 40)))) for i in range(900)]
    docs += [(1000, None), (1001, ""), (1002, "-- ..."), (None, "river stone"), (1003, "river stone"), (1003, "river stone"), (1004, "the river " * 50_000)]
    docs += [(2000 + i, "copy of one text: blue river, blue stone") for i in range(300)]
    items = [(1, "River stone, river"), (2, None), (3, ""), (4, "nothing known here"), (None, "blue 7"), (5, "the of and"), (6, "été 日本"), (6, "été 日本"), (7, "X1 " * 500)]
    return docs, items


def test_equals_plain(spark, rows, with_clashes):
    documents, items = frames(spark, *rows)
    assert got(lexical.search(with_clashes(documents), with_clashes(items))) == plain(*rows)


def test_small_blocks_segments_and_groups(spark, rows, monkeypatch):
    """Tiny blocks and segments, and questions in several groups, change nothing."""
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "SEGMENT", 50)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 600)
    documents, items = frames(spark, *rows)
    assert got(lexical.search(documents, items, k=5)) == plain(*rows, k=5)


def test_documents_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = [(str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in lexical.op11_geometric_blocks(spark, SF).collect()]
    assert sorted(found, key=str) == plain(docs, items)


def test_empty_tables(spark, rows):
    none, some = frames(spark, [], rows[1])
    assert lexical.search(none, some).count() == 0
    assert lexical.search(*frames(spark, rows[0], [])).count() == 0
    assert lexical.search(*frames(spark, [(1, None)], [(1, "a")])).count() == 0


def test_bounds_are_upper_bounds_and_blocks_are_skipped():
    rng = np.random.default_rng(2)
    entries = rng.integers(5, 30, 2000)
    # Documents of forty topics: similar ones share terms.
    topic = rng.integers(0, 40, 2000)
    chosen = [np.unique(np.concatenate([rng.integers(0, 20, e // 3 + 1), 20 + 10 * t + rng.integers(0, 10, e)])) for e, t in zip(entries, topic)]
    entries = np.array([len(c) for c in chosen])
    listed = np.concatenate(chosen)
    counts = rng.integers(1, 5, len(listed))
    df = np.bincount(listed, minlength=420)
    known = lexical.Statistics(2000, int(counts.sum()), np.floor(1000 * np.log(4002 / (2 * df + 1))).astype(np.int64))
    segment = lexical.Segment.built(entries * 2, entries, listed, counts, known)
    again = lexical.Segment.unpacked(segment.packed(), 420)
    assert all(np.array_equal(getattr(segment, k), getattr(again, k)) for k in lexical.INDEX_NAMES)
    assert segment.sizes.max() <= lexical.BLOCK and sorted(segment.members[: segment.lists[0]]) == sorted(np.repeat(np.arange(2000), entries)[listed == 0])
    visited = skipped = 0
    for t in range(20, 420, 10):
        ids = np.array([0, 1, 2, t, t + 1, t + 3])
        q = lexical.Question(ids, known.weight[ids], 20)
        segment.answer(q, np.arange(2000), np.zeros(2000, bool))
        dense = np.zeros(420, np.int64)
        dense[ids] = known.weight[ids]
        scores = segment.scores(np.arange(2000), dense)
        best = np.lexsort((np.arange(2000), -scores))[:20]
        assert q.keys.tolist() == best.tolist() and q.scores.tolist() == scores[best].tolist()
        visited, skipped = visited + q.visited, skipped + q.skipped
    assert skipped > visited


def test_a_segment_is_built_without_a_second_copy_of_its_summaries():
    import tracemalloc

    rng = np.random.default_rng(5)
    n, size, each = 1024, 4000, 60
    terms = np.concatenate([np.sort(rng.choice(400, each, replace=False)) for _ in range(n)])
    known = lexical.Statistics(n, n * each, np.full(size, 3000, np.int64))
    tracemalloc.start()
    segment = lexical.Segment.built(np.full(n, each), np.full(n, each), terms, np.ones(n * each, np.int64), known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(segment.summaries) == segment.blocks.sum() and peak < segment.summaries.nbytes + 4 * n * size
