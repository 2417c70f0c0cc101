"""Odd vectors in the operators on embeddings: other lengths, extreme components, ties, repeats, clashing columns."""

import numpy as np

from deskweave.llm import hilbert, near_vectors, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("_row", "part", "n", "lead", "curve", "block", "key", "least", "score", "rank")])


def test_scaling_is_exact():
    rows = np.array([[1e-200, 2e-200], [1e200, -3e200], [0.1, 0.3], [5e-324, 0.0], [1.7e308, 1.7e308]])
    got = vectors.scaled(rows)
    assert np.isfinite(got).all() and (np.abs(got).max(1) >= 0.5).all() and (np.abs(got).max(1) < 1).all()
    assert (got[2] * 2.0 ** np.frexp(0.3)[1] == rows[2]).all()
    assert np.allclose(np.linalg.norm(vectors.units(rows), axis=1), 1)


def test_near_vectors_of_any_length_and_size(spark):
    rows = [(0, [1.0, 2.0, 3.0, 4.0], 1), (1, [-1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, -4.0], 1), (3, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (5, [2.0, 4.0], 2),
            (6, [1e-200] * 4, 3), (7, [2e-200] * 4, 3), (8, [1e200, 2e200, 0.0, 0.0], 3), (9, [1.0, 2.0, 0.0, 0.0], 3), (10, [5e-324, 0.0, 0.0, 0.0], 3), (11, [7.0, 0.0, 0.0, 0.0], 3),
            (12, [3.0], 4), (12, [4.0], 4), (13, [-3.0], 4), (14, [9.0], 4)]
    got = {}
    for r in near_vectors.near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA))).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    alone = {i: {(0, i, True)} for i in (0, 1, 2, 5, 13)}
    assert got == {**alone, 3: {(1, 3, True)}, 4: {(1, 3, False)}, 6: {(1, 6, True)}, 7: {(1, 6, False)}, 8: {(1, 8, True)}, 9: {(1, 8, False)},
                   10: {(1, 10, True)}, 11: {(1, 10, False)}, 12: {(2, 12, True)}, 14: {(2, 12, False)}}


def test_nearest_ties_repeats_and_lengths(spark):
    rows = [(20, [1.0, 0.0], 0), (1, [2.0, 1.0], 0), (2, [2.0, 5.0], 0), (3, [1.0, 1.0], 0), (3, [3.0, 0.0], 0), (40, [1.0, 1.0, 1.0], 0), (5, [1.0, 1.0, 1.0], 0), (20, [0.0, 1.0], 0),
            (60, [1e-200] * 4, 0), (6, [1.0] * 4, 0), (7, [1e200] * 4, 0)]
    table = clashing(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in hilbert.nearest(table.where("vec_id % 20 = 0"), table, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    # A repeated query or candidate counts once, with its best score.
    assert got[20] == [(1, 2, 5.0), (2, 3, 3.0), (3, 1, 2.0)]
    assert got[40] == [(1, 5, 3.0)]
    assert [v for _, v, _ in got[60]] == [7, 6] and got[60][0][2] == 4.0


def test_recall_at_several_sizes(spark):
    """At least nine tenths of the true neighbours, whatever the size; the lower bound of the first blocks loses none."""
    random = np.random.default_rng(8)
    for n in (300, 1500, 6000):
        points = random.standard_normal((n, 16))
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
        found = hilbert.nearest(table.where("vec_id % 20 = 0"), table).collect()
        scores = points @ points.T
        np.fill_diagonal(scores, -np.inf)
        asked = range(0, n, 20)
        best = {q: set(np.argsort(-scores[q])[:20].tolist()) for q in asked}
        assert sum(r["vec_id"] in best[r["query_id"]] for r in found) >= 0.9 * 20 * len(asked)
        assert len(found) == 20 * len(asked)
