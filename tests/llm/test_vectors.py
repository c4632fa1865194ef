"""Nearest vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from larkspur.llm.nearest_vectors import CentroidGraph, brute_force, nearest_vectors, recall

SCHEMA = "id long, embedding array<float>, v string, list int, m long"


def frame(spark, ids, rows):
    return spark.createDataFrame([(int(i), None if r is None else [float(x) for x in r], "x", 1, 2) for i, r in zip(ids, rows)], SCHEMA)


def clustered(n, dimension=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dimension))
    rows = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, dimension))
    return rows * rng.uniform(0.1, 9, size=(n, 1))


def exact(rows, k):
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    similar = units @ units.T
    np.fill_diagonal(similar, -2)
    return similar, np.argsort(-similar, axis=1)[:, :k]


def test_recall_of_close_pairs_and_of_all(spark):
    rows = clustered(3000)
    vectors = frame(spark, range(3000), rows)
    similar, top = exact(rows, 10)
    want = {(i, int(j)) for i in range(3000) for j in top[i] if similar[i, j] >= 0.8}
    got = nearest_vectors(vectors, least_similarity=0.8, list_size=60).collect()
    found = {(r.id, r.other) for r in got}
    assert len(found) == len(got) and all(similar[i, j] >= 0.8 - 1e-5 for i, j in found)
    assert len(found & want) >= 0.97 * len(want)
    measured = recall(vectors, nearest_vectors(vectors, list_size=60)).first()
    assert measured.n_true == 300 and measured.recall >= 0.9


def test_grid_of_blocks_gives_the_same(spark):
    vectors = frame(spark, range(600), clustered(600, seed=1))
    whole = {(r.id, r.other) for r in nearest_vectors(vectors, list_size=100).collect()}
    cut = {(r.id, r.other) for r in nearest_vectors(vectors, list_size=100, list_rows=60).collect()}
    assert whole == cut and len(whole) == 6000


def test_large_lists_are_split_level_by_level(spark):
    rows = clustered(3000, seed=8)
    vectors = frame(spark, range(3000), rows)
    similar, top = exact(rows, 10)
    want = {(i, int(j)) for i in range(3000) for j in top[i] if similar[i, j] >= 0.8}
    # Three lists of a small sample, each split into lists of about forty, some of them again.
    got = nearest_vectors(vectors, least_similarity=0.8, list_size=40, sample_rows=50, split_rows=150).collect()
    found = {(r.id, r.other) for r in got}
    assert len(found) == len(got) and len(found & want) >= 0.97 * len(want)


def test_odd_rows(spark):
    rows = [[1, 0, 0], [1, 0.1, 0], None, [0, 0, 0], [float("nan"), 1, 0], [1, 0], [0, 1, 0], [2, 0, 0], [float("inf"), 0, 0], []]
    vectors = frame(spark, range(10), rows).unionByName(frame(spark, [0, 6], [rows[0], rows[6]]))
    got = {(r.id, r.other): round(r.similarity, 4) for r in nearest_vectors(vectors, k=2).collect()}
    assert {i for i, _ in got} == {0, 1, 6, 7}
    assert got[0, 7] == 1 and got[7, 0] == 1 and got[0, 1] == round(1 / np.sqrt(1.01), 4)
    assert len(got) == 8


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    got = nearest_vectors(frame(spark, range(n), [[1.0, 2.0]] * n)).collect()
    assert sorted((r.id, r.other) for r in got) == ([(0, 1), (1, 0)] if n == 2 else [])


def test_many_copies_are_not_paired_with_each_other(spark):
    rng = np.random.default_rng(3)
    rows = [[1.0, 2.0, 3.0]] * 400 + [[1.0, 2.0, 3.0001]] * 3 + list(rng.normal(size=(800, 3)))
    got = nearest_vectors(frame(spark, range(len(rows)), rows), k=5, list_size=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert all(len(v) == 5 for v in by.values()) and len(by) == 1203
    assert all(r.similarity > 0.9999 for i in range(400) for r in by[i])
    near = by[400]
    assert {r.other for r in near} >= {401, 402} and all(r.similarity > 0.9999 for r in near)


def test_graph_search_finds_the_nearest_centroids():
    rows = clustered(4000, seed=5)
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    graph = CentroidGraph(rows, 200)
    beam, distance = graph.near(rows[:500], 32, 1.1)
    best = (rows[:500] @ graph.centroids.T).argmax(axis=1)
    assert (beam[:, 0] == best).mean() > 0.97
    assert (np.diff(np.where(np.isfinite(distance), distance, 9), axis=1) >= 0).all()
    assert np.bincount((rows @ graph.centroids.T).argmax(axis=1)).max() < 6 * len(rows) / len(graph.centroids)


def test_brute_force_asks_for_every_id_divisible(spark):
    rows = clustered(240, seed=6)
    got = {(r.id, r.other) for r in brute_force(frame(spark, range(240), rows), k=3).collect()}
    _, top = exact(rows, 3)
    assert got == {(i, int(j)) for i in (0, 100, 200) for j in top[i]}
