"""Operators mended in round 5: the work grows with the rows, the results stay."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import relevance as R


def test_spearman_reads_its_rows_once(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float("nan") if i % 9 == 0 else float(a * b)) for i, (a, b) in enumerate(rng.integers(0, 30, (400, 2)))]
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(rows, "x double, z double, y double").mapInPandas(count, "x double, z double, y double")
    got = {r["feature"]: r["corr"] for r in R.spearman(df, ["x", "z"], "y").collect()}
    assert seen.value == 400
    full = spark.createDataFrame(rows, "x double, z double, y double").toPandas().dropna().rank()
    assert got == {c: pytest.approx(full[c].corr(full["y"])) for c in ("x", "z")}


def dbscan_by_brute_force(x, ids, eps, m):
    """{id: cluster}: a repeated id counts the neighbours of all its rows, and all its rows are one node."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    n = {i: near[ids == i].sum() for i in set(ids.tolist())}
    core = np.array([n[i] >= m for i in ids.tolist()])
    link = near | (ids[:, None] == ids[None])
    lab = np.where(core, ids, -1)
    while True:
        new = np.array([min(lab[core & link[r]]) if core[r] else -1 for r in range(len(x))])
        if (new == lab).all():
            break
        lab = new
    names = {c: k for k, c in enumerate(sorted(set(lab[core].tolist())))}
    out = {}
    for r, i in enumerate(ids.tolist()):
        seen = [lab[r]] if core[r] else lab[core & near[r]].tolist()
        out[i] = min([out.get(i, 1 << 60)] + [names[c] for c in seen])
    return {i: -1 if c == 1 << 60 else c for i, c in out.items()}


@pytest.mark.parametrize("dims,eps,m,seed", [(1, 0.3, 4, 0), (2, 0.35, 5, 1), (2, 1.5, 12, 2), (3, 0.8, 6, 3)])
def test_dbscan_by_cells(spark, monkeypatch, dims, eps, m, seed):
    from tessera.operators import cluster as K
    from tessera.operators import dbscan_cells
    monkeypatch.setattr(dbscan_cells, "PAIRS", 200)
    rng = np.random.default_rng(seed)
    # two crowded places, a line of points exactly one radius apart, scattered ones, copies
    x = np.concatenate([rng.normal(0, 0.2, (150, dims)), rng.normal(3, 0.6, (80, dims)), rng.uniform(-4, 7, (90, dims)),
                        np.outer(np.arange(20), np.eye(dims)[0]) * eps + 9, np.full((15, dims), -6.0)])
    ids = np.arange(len(x)) * 3 + 5
    ids[-25:-20] = ids[:5]
    rows = [(int(i), *map(float, v)) for i, v in zip(ids, x)] + [(2, None, *[0.0] * (dims - 1)), (1, float("nan"), *[0.0] * (dims - 1))]
    cols = [f"x{t}" for t in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    got = K.dbscan(df, cols, "id", eps, m, tile_rows=2).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["Cluster"] for r in got} == dbscan_by_brute_force(x, ids, eps, m) | {1: -1, 2: -1}


def test_dbscan_compares_no_crowded_cells(spark, monkeypatch):
    """Points that all lie within the radius need no distance at all."""
    from tessera.functions import pairs
    from tessera.operators import cluster as K

    def refuse(*_):
        raise AssertionError("a block of distances")

    monkeypatch.setattr(K, "within", refuse)
    monkeypatch.setattr(pairs, "euclidean", refuse)
    df = spark.range(3000).select("id", (F.rand(1) / 10).alias("x"), (F.rand(2) / 10).alias("y"))
    assert K.dbscan(df, ["x", "y"], "id", 0.5, 10).groupBy("Cluster").count().collect() == [(0, 3000)]


def test_tune_gmm_computes_distances_once(spark):
    from tessera.operators import cluster as K
    from tessera.operators import cluster_quality as Q
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    want = {}
    for k in (2, 3, 4):
        labels = K.gmm(df, ["x", "y"], "id", k=k, seed=42)
        want[k] = Q.silhouette(df.join(labels, "id"), ["x", "y"], "Cluster", "id").first()[0]
    calls, whole = [], Q.apply_tiles
    Q.apply_tiles = lambda *a, **kw: calls.append(1) or whole(*a, **kw)
    try:
        got = K.tune_gmm(df, ["x", "y"], "id", k_range=range(2, 5))
    finally:
        Q.apply_tiles = whole
    assert len(calls) == 1
    best = max(want, key=want.get)
    assert got["n_components"] == best and got["score"] == pytest.approx(want[best], rel=1e-12)
    one = df.withColumn("a", F.lit(1)).withColumn("b", F.col("id") % 2)
    assert Q.silhouettes(one, ["x", "y"], ["a", "b"], "id") == [None, pytest.approx(Q.silhouette(one, ["x", "y"], "b", "id").first()[0])]


def test_nearest_rows_hold_few_distances(spark, monkeypatch):
    from tessera.functions import blocks
    rng = np.random.default_rng(5)
    d = rng.integers(0, 6, (50, 40)).astype(float)
    for x in (d, rng.random((50, 40)), np.zeros((3, 40)), np.where(d > 4, np.inf, d), d[:, :3]):
        assert (blocks._least(x, 3) == np.argsort(x, axis=1, kind="stable")[:, :3]).all()
    assert blocks.AT_ONCE <= 1 << 20


def test_cuts_are_scored_without_shuffling_sums(spark, monkeypatch):
    """Stripes of few points, points on one place, an id in three rows: the average of the points' silhouettes,
    and a row a cut and stripe is all that leaves the pass over the pairs."""
    from tessera.operators import linkage as L
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.3, (60, 6)) for m in (0, 1.5, 4)] + [np.full((20, 6), 9.0)])
    ids = np.arange(len(x))
    ids[[7, 90]] = 3
    leaf = np.array([int(v[0] * 2) % 12 for v in x])
    leaf[[7, 90]] = leaf[3]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, x array<double>")
    labels = spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, leaf)], "id long, Cluster int")
    merges = [(0, j, float(j)) for j in range(11, 0, -1)]
    trees = {"ward": L.MergeTree(labels, "id", 12, merges)}
    stripes = L._stripe_scores
    made = []

    def few(*args):
        out = stripes(*args, stripe_rows=50, tile_rows=16)
        made.append(out.count())
        return out

    monkeypatch.setattr(L, "_stripe_scores", few)
    got = L.cut_scores(df, "x", trees, [1, 2, 3, 5])
    assert got[("ward", 1)] is None and max(made) <= 3 * 8
    rows = [(i, v, c) for i, v in zip(ids, x) for j, c in zip(ids, leaf) if i == j]                 # the join by id
    i, v, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for k in (2, 3, 5):
        g = np.array(trees["ward"].groups(k))
        one = np.eye(k)[g[c]]
        s, n = d @ one, one.sum(0) - one
        s, n = (np.stack([y[i == a].sum(0) for a in i]) for y in (s, n))
        mean = s / np.where(n, n, np.nan)
        each = []
        for a, own in zip(ids, g[leaf]):
            m = mean[np.flatnonzero(i == a)[0]].copy()
            mine, m[own] = m[own], np.nan
            each.append(0.0 if np.isnan(mine) else (np.nanmin(m) - mine) / max(mine, np.nanmin(m)))
        assert got[("ward", k)] == pytest.approx(np.mean(each), abs=1e-9), k
