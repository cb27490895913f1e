"""Neighbour search by pivots and cells, against brute force."""

import math

import numpy as np
import pytest

from tessera.operators import neighbors as NB
from tessera.operators import pivots as PV


def clustered(rng, n, d, centres):
    middle = rng.normal(size=(centres, d)) * 20
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d))


def brute(ids, x, k, power=2):
    out = set()
    for i, v in zip(ids, x):
        d = (np.abs(x - v) ** power).sum(1) ** (1 / power)
        near = sorted((round(float(e), 9), j) for e, j in zip(d, ids) if j != i)[:k]
        out |= {(i, j, e, r + 1) for r, (e, j) in enumerate(near)}
    return out


def rows(frame):
    return {(r["id"], r["nbr"], round(r["dist"], 9), r["rank"]) for r in frame.collect()}


def frame_of(spark, ids, x, kind="long"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"id {kind}, v array<double>")


@pytest.mark.parametrize("tile,pivots", [(40, 1024), (30, 6), (5000, 8)])
def test_pruned_is_exact(spark, tile, pivots):
    x = clustered(np.random.default_rng(1), 600, 12, 9)
    df = frame_of(spark, range(600), x)
    got = rows(PV.knn_pruned(df, "id", "v", 6, tile_rows=tile, max_pivots=pivots))
    assert got == brute(range(600), x, 6)


def test_pruned_manhattan_without_clusters(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    got = rows(PV.knn_pruned(frame_of(spark, range(300), x), "id", "v", 4, "manhattan", tile_rows=25))
    assert got == brute(range(300), x, 4, 1)


def test_pruned_ties_copies_and_text_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(240, 3)).astype(float)                  # 27 places, all with ties
    x[:80] = 1.0                                                          # a third on one place
    ids = [f"é{i:03d}" if i % 2 else f"a{i:03d}" for i in range(240)]
    want = brute(ids, x, 5)
    df = frame_of(spark, ids, x, "string")
    assert rows(PV.knn_pruned(df, "id", "v", 5, tile_rows=20, max_pivots=10)) == want
    assert rows(NB.knn(df, "id", "v", 5, tile_rows=50)) == want


def test_pruned_odd_rows(spark):
    data = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
            (None, [0.0, 0.0]), (7, [5.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in data], "id long, v array<double>, _vec int, _cell int")
    want = {(1, 2, 1.0, 1), (1, 7, 5.0, 2), (2, 1, 1.0, 1), (2, 7, 4.0, 2), (7, 2, 4.0, 1), (7, 1, 5.0, 2)}
    assert rows(PV.knn_pruned(df, "id", "v", 3)) == want
    assert PV.knn_pruned(df.limit(0), "id", "v", 3).collect() == []
    assert PV.knn_pruned(df.where("id = 1"), "id", "v", 3).collect() == []
    assert NB.knn(df.where("id IN (1, 2, 3, 7)"), "id", "v", 2).count() == 6
    assert NB.knn(df.limit(0), "id", "v", 2).collect() == []
    with pytest.raises(ValueError):
        PV.knn_pruned(df, "id", "v", 3, "cosine")


def test_visits_skip_most_tiles(spark):
    x = clustered(np.random.default_rng(4), 3000, 24, 30)
    df = frame_of(spark, range(3000), x)
    assert PV.visit_share(df, "id", "v", 5, tile_rows=50) < 0.5
    assert PV.visit_share(df.limit(0), "id", "v", 5) == 0.0


def test_probes_recall(spark):
    x = np.random.default_rng(5).normal(size=(1500, 6))
    df = frame_of(spark, range(1500), x)
    want = {r[:2] for r in brute(range(1500), x, 5)}
    got = {(r["id"], r["nbr"]) for r in PV.knn_pruned(df, "id", "v", 5, tile_rows=60, probes=20).collect()}
    assert 0.9 <= len(got & want) / len(want)
