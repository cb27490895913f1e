"""Groups of tiles, distances from products, and the blocks that use them, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tessera.functions import pairs as P
from tessera.operators import cluster_quality as Q
from tessera.operators import embedding_quality as V
from tessera.operators import neighbors as NB
from tessera.operators import pivots as PV
from tessera.operators.cluster import dbscan


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>")


def brute(x, k, metric="euclidean"):
    n = len(x)
    d = P.apart(x, x, *[q.ravel() for q in np.indices((n, n))], metric).reshape(n, n)
    np.fill_diagonal(d, np.inf)
    at = np.lexsort((np.broadcast_to(np.arange(n), d.shape), d), axis=1)[:, :k]
    return {(i, r + 1): (int(j), d[i, j]) for i in range(n) for r, j in enumerate(at[i]) if np.isfinite(d[i, j])}


def cloud(n=300, d=7):
    x = np.random.default_rng(3).normal(size=(n, d))
    x[50:80] = x[10]                                             # copies
    return x


def test_many_tiles_lie_in_few_groups(spark):
    x = cloud()

    def block(a, b, same):
        return pd.DataFrame({"n": [len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)], "rows": [len(a) + (0 if same else len(b))]})

    got = P.apply_tiles(frame(spark, x), "id", block, "n long, rows long", 8, whole=True).toPandas()
    assert got["n"].sum() == 300 * 299 // 2
    assert len(got) <= 19 * 20 // 2                               # 38 tiles gave 741 groups
    assert got["rows"].sum() <= 300 * 19                          # every row was copied to 38
    parts = P.apply_tiles(frame(spark, x), "id", block, "n long, rows long", 8).toPandas()
    assert parts["n"].sum() == 300 * 299 // 2 and parts["rows"].max() <= 16 + 16


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_neighbours_over_groups_of_tiles(spark, metric):
    x = cloud()
    got = NB.knn(frame(spark, x), "id", "v", 6, metric, tile_rows=8).collect()
    want = brute(x, 6, metric)
    assert {(r["id"], r["rank"]): r["nbr"] for r in got} == {k: v[0] for k, v in want.items()}
    assert max(abs(r["dist"] - want[r["id"], r["rank"]][1]) for r in got) < 1e-12


def test_far_from_the_origin(spark):
    x = cloud(120, 6) + 1e6
    x[0] += 1e8
    want = brute(x, 5)
    assert {(r["id"], r["rank"]): r["nbr"] for r in NB.knn(frame(spark, x), "id", "v", 5, tile_rows=4).collect()} == {k: v[0] for k, v in want.items()}
    assert {(r["id"], r["rank"]): r["nbr"] for r in PV.knn_pruned(frame(spark, x), "id", "v", 5, tile_rows=4).collect()} \
        == {k: v[0] for k, v in want.items()}


def test_numbers_that_are_not_finite_keep_their_rows(spark):
    x = cloud(40, 6)
    x[3, 0] = np.nan
    got = NB.knn(frame(spark, x), "id", "v", 39, tile_rows=8).collect()
    assert len(got) == 40 * 39 and {r["dist"] is None for r in got if r["id"] == 3} == {True}


def test_radius_met_exactly():
    g = np.stack(np.meshgrid(*[np.arange(4.0)] * 5), -1).reshape(-1, 5) + 1e5
    assert (P.within(g, g, 1.0) == (P.euclidean(g, g) <= 1.0)).all() and P.within(g, g, 1.0).sum(1).max() == 11
    d = P.euclidean_products(g, g)
    assert np.abs(d - P.euclidean(g, g)).max() < 1e-8 and (np.diag(d) == 0).all()


def test_quality_over_groups_of_tiles(spark):
    x = cloud(150, 6)
    y, lab = x[:, :2], np.arange(150) % 3
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), int(lab[i])) for i in range(150)], "id long, x array<double>, y array<double>, lab long")
    dx, dy = P.euclidean(x, x), P.euclidean(y, y)
    iu = np.triu_indices(150, 1)
    sums = V.pair_sums(df, "id", "x", "y", tile_rows=4).first()
    assert sums["n"] == len(iu[0]) and abs(sums["sdd"] - ((dy - dx)[iu] ** 2).sum()) < 1e-8 and abs(sums["sxy"] - (dx * dy)[iu].sum()) < 1e-8
    per = {(r["_id"], r["_c"]): (r["_sum"], r["_cnt"]) for r in Q.cluster_distance_sums(df, "x", "lab", "id", tile_rows=4).collect()}
    for i in (0, 10, 55, 149):
        for c in range(3):
            assert abs(per[i, c][0] - dx[i, lab == c].sum()) < 1e-9 and per[i, c][1] == (lab == c).sum() - (lab[i] == c)
    ranks = NB.knn(df, "id", "y", 4)
    got = {(r["id"], r["nbr"]): r["rank"] for r in V._rank_missing(df, "id", "x", ranks, tile_rows=4).collect()}
    place = {(i, v[0]): r for (i, r), v in brute(x, 149).items()}
    assert len(got) == 600 and all(place[k] == v for k, v in got.items())


def test_dbscan_of_crowded_vectors(spark):
    """Copies, lattice points a radius apart, border points of two clusters."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 5)) * .2 + c for c in (0, 3, 6)] + [np.zeros((40, 5)), np.eye(5) + 12.0, rng.uniform(-9, 9, (20, 5))])
    near = P.euclidean(x, x) <= 0.5
    core = near.sum(1) >= 4
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min(comp[near[i] & core], default=i) if core[i] else i for i in range(len(x))])
    roots = sorted(set(comp[core]))
    want = [roots.index(comp[i]) if core[i] else min((roots.index(c) for c in comp[near[i] & core]), default=-1) for i in range(len(x))]
    got = {r["id"]: r["Cluster"] for r in dbscan(frame(spark, x), "v", "id", 0.5, 4, tile_rows=6).collect()}
    assert [got[i] for i in range(len(x))] == want


def test_edges_out_of_components_over_groups_of_tiles(spark):
    """The nearest row outside of every open component, ties to the smaller ids, copies included."""
    from tessera.operators.linkage import _outward
    x = np.round(cloud(150, 5), 1)
    comp = np.random.default_rng(5).integers(0, 6, 150)
    df = spark.createDataFrame([(i, x[i].tolist(), int(comp[i]), bool(comp[i] != 2)) for i in range(150)],
                               "_id long, _vec array<double>, comp long, open boolean")
    got = P.apply_tiles(df, "_id", _outward("euclidean", 4), "c1 long, dist double, a long, b long, c2 long", 4, whole=True).toPandas()
    got = got.sort_values(["dist", "a", "b"]).groupby("c1").first()
    d = P.apart(x, x, *[q.ravel() for q in np.indices((150, 150))]).reshape(150, 150)
    for c in (0, 1, 3, 4, 5):
        dist, a, b, _ = min((d[i, j], min(i, j), max(i, j), j) for i in np.flatnonzero(comp == c) for j in np.flatnonzero(comp != c))
        assert (got.loc[c, "dist"], got.loc[c, "a"], got.loc[c, "b"]) == (dist, a, b)
        assert {got.loc[c, "c2"], c} == {comp[a], comp[b]}
    assert 2 not in got.index
