"""Operators that do their whole job since round 6."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import blockgraph
from tessera.operators import reduce as D
from tessera.operators import tsne as T


def affinities(x, perplexity, k):
    """Symmetric affinities of all rows that add up to 1, from the k nearest by Manhattan distance."""
    d = np.abs(x[:, None] - x[None]).sum(-1)
    p = np.zeros(d.shape)
    for i, row in enumerate(d):
        near = sorted((v, j) for j, v in enumerate(row) if j != i)[:k]
        d2 = np.array([v for v, _ in near]) ** 2
        low, high = 0.0, 1e6
        for _ in range(200):
            beta = (low + high) / 2
            q = np.exp(-(d2 - d2.min()) * beta)
            q /= q.sum()
            low, high = (beta, high) if -(q[q > 0] * np.log(q[q > 0])).sum() > math.log(perplexity) else (low, beta)
        p[i, [j for _, j in near]] = q
    return (p + p.T) / p.sum() / 2


def descended(p, y, plan, rate):
    """The layout from plain sums over all pairs, for a plan of (steps, exaggeration, momentum)."""
    for steps, more, momentum in plan:
        update, gains = np.zeros(y.shape), np.ones(y.shape)
        for _ in range(steps):
            gap = y[:, None] - y[None]
            w = 1 / (1 + (gap ** 2).sum(-1))
            np.fill_diagonal(w, 0)
            grad = 4 * (((more * p - w / w.sum()) * w)[:, :, None] * gap).sum(1)
            gains = np.maximum(np.where(update * grad < 0, gains + 0.2, gains * 0.8), 0.01)
            update = momentum * update - rate * gains * grad
            y = y + update
    return y


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_tsne_descends(spark, monkeypatch, block_rows):
    monkeypatch.setattr(T, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(D, "EXAGGERATED", 12)
    monkeypatch.setattr(D, "STEPS", 30)
    monkeypatch.setattr(T, "CUT", 7)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20, 4)) + c for c in (0, 8, -9)])
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(x)] + [(1, None), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: (r["TSNE1"], r["TSNE2"]) for r in D.tsne_layout(df, "v", "id", perplexity=5.0, learning_rate=10.0).collect()}
    assert got.pop(1) == got.pop(None) == (None, None)
    y = np.array([got[i * 3] for i in range(60)])
    centred = x - x.mean(0)
    start = centred @ D._sign_fix(np.linalg.svd(centred)[2][:2].T)
    want = descended(affinities(x, 5.0, 16), start / start[:, 0].std() * 1e-4, [(12, 12.0, 0.5), (18, 1.0, 0.8)], 10.0)
    assert np.abs(want).max() > 0.5 and np.abs(y - want).max() < 1e-3 * np.abs(want).max()


def test_tsne_separates(spark):
    rng = np.random.default_rng(1)
    group = np.repeat([0, 1, 2], 25)
    x = rng.normal(size=(75, 5)) + np.array([0, 30, -30])[group][:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "id long, v array<double>")
    found = D.tsne_layout(df, "v", "id", perplexity=8.0, learning_rate=20.0).orderBy("id").collect()
    assert [r["id"] for r in found] == [0, *range(75)] and found[0] == found[1]
    y = np.array([(r["TSNE1"], r["TSNE2"]) for r in found[1:]])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    same = group[:, None] == group[None]
    np.fill_diagonal(d, np.inf)
    assert all(group[d.argmin(1)] == group)
    np.fill_diagonal(d, 0)
    assert d[same].mean() < d[~same].mean() / 2


@pytest.mark.parametrize("dims,spread", [(1, 5), (2, 0.01), (2, 4), (3, 1)])
def test_push_from_the_grid(monkeypatch, dims, spread):
    rng = np.random.default_rng(dims)
    y, mass = rng.normal(size=(3000, dims)) * spread, rng.integers(1, 3, 3000).astype(float)
    own = y[:40]
    dof = max(dims - 1, 1)
    near = 1 + ((y[:, None] - y[None]) ** 2).sum(-1) / dof
    w = near ** (-(dof + 1) / 2) * mass[:, None] * mass
    gap = own[:, None] - y[None]
    want = (gap * (near[:40] ** (-(dof + 3) / 2) * mass)[:, :, None]).sum(1)
    exact, z = T._pair_push(own, y, mass)
    assert np.allclose(exact, want) and z == pytest.approx(w.sum() - mass.sum())
    monkeypatch.setattr(T, "_pair_push", None)
    got, z = T.push(own, y, mass)
    assert np.abs(got - want).max() < 0.02 * np.abs(want).max() and z == pytest.approx(w.sum() - mass.sum(), rel=2e-3)


def test_a_shuffle_puts_one_block_in_a_partition(spark):
    for n in (1, 5, 8, 32):
        keys = blockgraph.block_keys(spark, n)
        at = spark.createDataFrame([(k,) for k in keys], "key int").select(F.pmod(F.hash("key"), F.lit(n)).alias("p")).collect()
        assert sorted(r["p"] for r in at) == list(range(n))


def _by_definition(x, eps, m):
    """DBSCAN labels: clusters by smallest core, a border point in the smallest adjacent one, -1 for noise."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    lab = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.array([lab[core & near[i]].min() if core[i] else len(x) for i in range(len(x))])
        if (new == lab).all():
            break
        lab = new
    name = {c: k for k, c in enumerate(sorted(set(lab[core].tolist())))} | {len(x): -1}
    return np.array([name[int(lab[core & near[i]].min(initial=len(x)))] for i in range(len(x))])


def _silhouette(x, lab):
    if len(set(lab.tolist())) < 2:
        return None
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("dims,radii", [(2, [0.1, 0.4, 60.0]), (3, [0.8])])
def test_dbscan_grid_in_cells(spark, dims, radii):
    from tessera.operators.dbscan_grid import Grid
    rng = np.random.default_rng(dims + 5)
    x = np.concatenate([rng.normal(size=(70, dims)) * 0.3 + c for c in (0, 5)] + [rng.uniform(-4, 9, (25, dims)), np.full((12, dims), 2.5)])
    cols = ["a", "b", "c"][:dims]
    df = spark.createDataFrame([(i * 2, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    counts = [2, 4, 10, 60]
    grid = Grid(df, cols, "id", radii, counts, tile_rows=20)
    assert grid.in_cells
    for eps in radii:
        sets = grid.core_sets(eps)
        asked = sorted(set(sets.values()))
        got = {(r["id"], r["m"]): r["Cluster"] for r in grid.labels(eps, asked).collect()} if asked else {}
        scores = grid.scores(eps, asked) if asked else {}
        for m in counts:
            want = _by_definition(x, eps, m)
            if m not in sets:
                assert set(want.tolist()) == {-1}
                continue
            assert [got[i * 2, sets[m]] for i in range(len(x))] == want.tolist()
            s = _silhouette(x, want)
            assert scores[sets[m]] == (None if s is None else pytest.approx(s, abs=1e-9))


def test_tune_dbscan_searches_the_whole_grid(spark):
    from tessera.operators.cluster import tune_dbscan
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.05, rng.normal(size=(30, 2)) * 0.05 + 6, rng.normal(size=(30, 2)) * 0.05 + [0, 6],
                        [[3.0, 3.0], [20.0, 20.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    radii, counts = [0.04, 1.0, 40.0], [2, 3, 4, 5, 6, 7]
    scored = {(e, m): _silhouette(x, lab) for e in radii for m in counts for lab in [_by_definition(x, e, m)] if (lab >= 0).any()}
    best = max((s for s in scored.values() if s is not None))
    found = tune_dbscan(df, ["a", "b"], "id", eps_values=radii, min_samples_values=counts)
    assert found["score"] == pytest.approx(best) and found["eps"] == 1.0
    early = tune_dbscan(df, ["a", "b"], "id", eps_values=radii, min_samples_values=counts, patience=2)
    assert early["score"] < best
