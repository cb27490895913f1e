"""Nearest-neighbour information, exact single linkage, merge trees, neighbour
imputation and shared tuning, against brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.functions import blocks, planar
from tessera.functions.numbers import digamma_sql
from tessera.operators import linkage as L
from tessera.operators import relevance as R


def brute_kth(rows, k):
    out = {}
    for g in {r[0] for r in rows}:
        pts = np.array([r[1:] for r in rows if r[0] == g])
        for i, p in enumerate(pts):
            d = np.sort(np.delete(np.abs(pts - p).max(1), i))
            out[g, *p.tolist()] = d[k - 1] if len(d) >= k else math.inf
    return out


@pytest.mark.parametrize("tile", [15, 10_000])
def test_kth_distance(spark, tile):
    rng = np.random.default_rng(3)
    rows = [("normal", *rng.normal(size=2).tolist()) for _ in range(300)]
    rows += [("heavy", *(rng.standard_cauchy(2) * 10).tolist()) for _ in range(200)]
    rows += [("ties", float(rng.integers(0, 6)), float(rng.integers(0, 9))) for _ in range(250)]
    rows += [("hot x", 0.0 if i % 3 else float(rng.normal()), float(i % 70)) for i in range(250)]
    rows += [("few", 1.0, 2.0), ("few", 1.0, 3.0)]
    got = planar.kth_distance(spark.createDataFrame(rows, "g string, x double, y double"), 3, tile).collect()
    want = brute_kth(rows, 3)
    assert {(r["g"], r["x"], r["y"]): r["r"] for r in got} == want
    assert sum(r["w"] for r in got) == len(rows)
    assert planar.kth_distance(spark.createDataFrame([], "g string, x double, y double"), 3).count() == 0


def test_digamma(spark):
    got = spark.range(1, 60).selectExpr("id", digamma_sql("id") + " AS v").collect()
    harmonic = 0.0
    for r in got:
        assert r["v"] == pytest.approx(harmonic - 0.5772156649015329, abs=1e-13)
        harmonic += 1 / r["id"]


def test_information_of_gaussians(spark):
    rng = np.random.default_rng(1)
    n, rho = 1500, 0.8
    x = rng.normal(size=n)
    y = rho * x + math.sqrt(1 - rho ** 2) * rng.normal(size=n)
    z = rng.normal(size=n)
    rows = [(float(a), float(c), 1.0, float(b), float(-b)) for a, b, c in zip(x, y, z)]
    rows += [(None, 1.0, 1.0, 2.0, 3.0), (1.0, float("nan"), 1.0, 2.0, None), (2.0, 2.0, None, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, z double, constant double, y double, y2 double")
    got = {(r["feature"], r["target"]): r["mi"] for r in R.mutual_information_knn(df, ["y", "y2"], ["x", "z", "constant"]).collect()}
    assert len(got) == 6
    for t in ("y", "y2"):
        assert got["x", t] == pytest.approx(-0.5 * math.log(1 - rho ** 2), abs=0.08)
        assert got["z", t] < 0.06
        assert got["constant", t] < 0.06
    assert R.mutual_information_knn(df.limit(2), ["y"], ["x"]).first()["mi"] is None


def test_not_a_number_is_missing(spark):
    rows = [(float(i), float(i * i)) for i in range(9)] + [(9.0, float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double")
    assert R.spearman(df, ["x"], "y").first()["corr"] == pytest.approx(1.0)
    assert R.mutual_information(df, ["y"], ["x"], 3).first()["mi"] == pytest.approx(math.log(3))


# ------------------------------------------------------------------ linkage
def brute_tree(points):
    """Kruskal with edges ordered by (distance, ids)."""
    ids = sorted(points)
    edges = sorted((float(np.sqrt(((points[a] - points[b]) ** 2).sum())), a, b) for i, a in enumerate(ids) for b in ids[i + 1:])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for d, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, d))
    return out


def cloud(seed, n=160, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 3)) * 30                     # clumps, whose lists of neighbours end inside
    x = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 3))
    return {int(i) * 7: v for i, v in enumerate(np.round(x) if ties else x)}


def frame(spark, points):
    return spark.createDataFrame([(i, *v.tolist()) for i, v in points.items()], "id long, x double, y double, z double")


@pytest.mark.parametrize("ties,small", [(False, 10 ** 5), (True, 0)])
def test_spanning_tree(spark, monkeypatch, ties, small):
    monkeypatch.setattr(L, "SMALL_GRAPH", small)
    points = cloud(4, 120, ties)
    edges = L.spanning_edges(frame(spark, points), ["x", "y", "z"], "id", neighbours=3, tile_rows=40)
    got = sorted((r["a"], r["b"], r["dist"]) for r in edges.collect())
    assert got == [(a, b, pytest.approx(d)) for a, b, d in sorted(brute_tree(points))]


def test_single_linkage_of_few_points(spark):
    points = cloud(1, 6)
    df = frame(spark, points)
    for k in (1, 2, 6, 9):
        labels = {r["id"]: r["Cluster"] for r in L.single_linkage(df, ["x", "y", "z"], "id", k).collect()}
        kept = brute_tree(points)[:max(0, 6 - k)]
        want = {i: i for i in points}
        for a, b, _ in kept:
            want = {i: min(want[a], want[b]) if c in (want[a], want[b]) else c for i, c in want.items()}
        order = sorted(set(want.values()))
        assert labels == {i: order.index(c) for i, c in want.items()}
    assert L.single_linkage(df.limit(0), ["x", "y", "z"], "id", 3).count() == 0


def test_cuts_are_nested_and_scored(spark):
    from tessera.operators.cluster import agglomerative
    from tessera.operators.cluster_quality import silhouette
    points = cloud(2)
    df = frame(spark, points)
    trees = L.merge_trees(df, ["x", "y", "z"], "id", ["ward", "complete", "average"], micro=30)
    for tree in trees.values():
        finer = tree.groups(1)
        assert set(finer) == {0}
        for k in range(2, 31):
            coarser, finer = finer, tree.groups(k)
            assert len(set(finer)) == k
            assert len(set(zip(finer, coarser))) == k                 # each group lies in one group of the cut before
        heights = [h for _, _, h in tree.merges]
        assert heights == sorted(heights) and tree.table().count() == 29
    scores = L.cut_scores(df, ["x", "y", "z"], trees, [1, 2, 4, 9, 30])
    for (name, k), s in scores.items():
        labels = trees[name].cut(k)
        want = silhouette(df.join(labels, "id"), ["x", "y", "z"], "Cluster", "id").first()[0]
        assert s == (None if want is None else pytest.approx(want)), (name, k)
    again = agglomerative(df, ["x", "y", "z"], "id", 4, "ward", micro=30)
    assert again.join(trees["ward"].cut(4), ["id", "Cluster"]).count() == len(points)
    assert L.merge_trees(df.limit(0), ["x", "y", "z"], "id", ["ward"])["ward"].cut(3).count() == 0
    assert [r["Cluster"] for r in L.merge_trees(df.limit(1), ["x", "y", "z"], "id", ["ward"])["ward"].cut(3).collect()] == [0]


# ------------------------------------------------------------------ nearest rows
@pytest.mark.parametrize("numeric,text,block", [(2, 1, 20), (1, 0, 16), (0, 2, 16), (2, 1, 10_000)])
def test_nearest_rows(spark, monkeypatch, numeric, text, block):
    monkeypatch.setattr(blocks, "ASKING_ROWS", 25)
    rng = np.random.default_rng(numeric + text)

    def rows(n, first):
        # two thirds share one place on the axis
        return [(first + i, [0.0 if j == 0 and i % 3 else float(np.round(rng.normal() * 5, 1)) for j in range(numeric)],
                 [str(rng.integers(0, 3)) for _ in range(text)], str(rng.integers(0, 4))) for i in range(n)]

    have, want_rows = rows(150, 1000), rows(90, 0)
    scale = [2.0, 3.0][:numeric]
    searched = spark.createDataFrame(have, "id long, v array<double>, c array<string>, y string")
    asking = spark.createDataFrame([r[:3] for r in want_rows], "id long, v array<double>, c array<string>")
    got = {r["id"]: [(n["dist"], n["other"], n["y"]) for n in r["near"]] for r in blocks.nearest_rows(asking, searched, 4, scale, 0, block).collect()}
    assert len(got) == 90
    for i, v, c, _ in want_rows:
        near = sorted((math.sqrt(sum(((a - b) / s) ** 2 for a, b, s in zip(v, w, scale)) + sum(a != b for a, b in zip(c, e))), o, y)
                      for o, w, e, y in have)[:4]
        assert [n[1:] for n in got[i]] == [n[1:] for n in near]
        assert [n[0] for n in got[i]] == pytest.approx([n[0] for n in near])
    few = blocks.nearest_rows(asking, searched.where("id < 1002"), 4, scale, 0, block).collect()
    assert {len(r["near"]) for r in few} == {2}
    assert {len(r["near"]) for r in blocks.nearest_rows(asking, searched.limit(0), 4, scale, 0, block).collect()} == {0}


def test_knn_impute_odd_columns(spark):
    from tessera.operators.impute import knn_impute
    rows = [(i, float(i % 10) if i % 7 else float("nan"), None if i % 5 == 0 else "ab"[i % 2], i % 2 == 0 if i % 4 else None, float(i) if i % 3 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, t string, b boolean, y double")
    for col in ("x", "t", "b", "y"):
        out = knn_impute(df, "id", col, fraction=0.6)
        assert out.schema == df.schema and out.count() == 200
        assert out.where(F.col(col).isNull() | (F.isnan(col) if col in "xy" else F.lit(False))).count() == 0
        kept = {r["id"]: r[col] for r in df.collect()}
        assert all(r[col] == kept[r["id"]] for r in out.collect() if kept[r["id"]] is not None and kept[r["id"]] == kept[r["id"]])
    lost = knn_impute(df.withColumn("y", F.lit(None).cast("double")), "id", "y")
    assert lost.where("y IS NOT NULL").count() == 0
    assert knn_impute(df.limit(0), "id", "y").count() == 0


# ------------------------------------------------------------------ dbscan grid
def brute_dbscan(x, eps, m):
    """Labels by position: clusters numbered by first core point, border points in the smallest adjacent one."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    labels, number = np.full(len(x), -1), 0
    for i in np.nonzero(core)[0]:
        if labels[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if labels[j] < 0:
                    labels[j] = number
                    todo += np.nonzero(near[j] & core & (labels < 0))[0].tolist()
            number += 1
    for i in np.nonzero(~core)[0]:
        labels[i] = min(labels[near[i] & core], default=-1)
    return labels


def brute_silhouette(x, labels):
    names = sorted(set(labels.tolist()))
    if len(names) < 2:
        return None
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i, c in enumerate(labels):
        own = (labels == c).sum() - 1
        a = d[i][labels == c].sum() / own if own else None
        b = min(d[i][labels == o].mean() for o in names if o != c)
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("dims", [2, 4])
def test_dbscan_grid(spark, dims):
    from tessera.operators.cluster import tune_dbscan
    from tessera.operators.dbscan_grid import Grid
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(3, dims)) * 4
    x = np.concatenate([centres[rng.integers(0, 3, 90)] + rng.normal(size=(90, dims)) * 0.5, rng.uniform(-8, 8, (20, dims))])
    cols = ["a", "b", "c", "d"][:dims]
    df = spark.createDataFrame([(i * 5, *v.tolist()) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    features = cols if dims == 2 else "v"
    df = df.withColumn("v", F.array(*cols))
    radii, counts = ([0.05, 0.6, 1.5, 40.0], [2, 5, 9, 100]) if dims == 2 else ([1.5], [2, 9])
    grid = Grid(df, features, "id", radii, counts, tile_rows=40)
    best = (None, -np.inf)
    for eps in radii:
        sets = grid.core_sets(eps)
        got = {(r["id"], r["m"]): r["Cluster"] for r in grid.labels(eps, list(set(sets.values()))).collect()} if sets else {}
        scores = grid.scores(eps, list(set(sets.values()))) if sets else {}
        for m in counts:
            want = brute_dbscan(x, eps, m)
            if m not in sets:
                assert set(want) == {-1}
                continue
            assert [got[i * 5, sets[m]] for i in range(len(x))] == want.tolist()
            s = brute_silhouette(x, want)
            assert scores[sets[m]] == (None if s is None else pytest.approx(s))
            if s is not None and s > best[1] + 1e-12:
                best = ((eps, m), s)
    found = tune_dbscan(df, features, "id", eps_values=radii[-2:], min_samples_values=counts, patience=100)
    assert (found["eps"], found["min_samples"]) == best[0] and found["score"] == pytest.approx(best[1])


def test_several_targets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1, 10, 100] + [5, -3, 1000]
    y = np.stack([2 * x[:, 0] - x[:, 2] + rng.normal(size=200), x[:, 1] * 0.3 + 7], 1)
    rows = [tuple(map(float, (*a, 1.0, *b))) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, one double, y double, z double")
    centred, values = x - x.mean(0), y - y.mean(0)

    def found(**options):
        got = {(r["target"], r["term"]): r["coefficient"] for r in R.multi_target(df, ["y", "z"], ["a", "b", "c", "one"], **options).collect()}
        return got, np.array([[got[t, f] for t in ("y", "z")] for f in ("a", "b", "c")])

    got, w = found()
    want = np.linalg.lstsq(centred, values, rcond=None)[0]
    assert np.allclose(w, want, atol=1e-9) and got["y", "one"] == pytest.approx(0, abs=1e-9)
    assert got["z", "intercept"] == pytest.approx(y[:, 1].mean() - x.mean(0) @ want[:, 1], abs=1e-6)
    assert np.allclose(found(method="ridge", alpha=3.0)[1], np.linalg.solve(centred.T @ centred + 3 * np.eye(3), centred.T @ values))
    w = found(method="lasso", alpha=0.4)[1]
    slope = centred.T @ (values - centred @ w) / 200
    assert np.allclose(np.where(w != 0, slope - 0.4 * np.sign(w), 0), 0, atol=1e-7) and (abs(slope) <= 0.4 + 1e-7).all()
    none = R.multi_target(df.limit(0), ["y", "z"], ["a"]).collect()
    assert len(none) == 4 and {r["coefficient"] for r in none} == {None}
    with pytest.raises(ValueError):
        R.multi_target(df, ["y"], ["a"], method="huber")
