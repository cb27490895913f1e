"""Radius cells, silhouettes without pairs and leaf rows, against plain forms."""

import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.functions.cells import apply_cells
from tessera.operators import cluster as K
from tessera.operators import cluster_quality as Q
from tessera.operators import explain as X


def clustered(seed, n, d, centres):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, centres, n)
    return rng.normal(size=(centres, d))[at] * 15 + rng.normal(size=(n, d)), at


def frame_of(spark, x, labels=None):
    return spark.createDataFrame([(i, v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)],
                                 "id long, v array<double>, lab int")


@pytest.mark.parametrize("tile,pivots", [(30, 1024), (25, 3), (5000, 1024)])
def test_cells_meet_every_near_pair_once(spark, tile, pivots):
    x, _ = clustered(1, 400, 10, 8)
    x[:130] = x[0]                                                        # a third are copies

    def pairs(a, b, same):
        d = np.sqrt(((np.stack(a["_vec"])[:, None] - np.stack(b["_vec"])[None]) ** 2).sum(-1))
        i, j = np.nonzero(np.triu(d <= 4.0, 1) if same else d <= 4.0)
        one, two = a["_id"].to_numpy()[i], b["_id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    df = frame_of(spark, x).select(F.col("id").alias("_id"), F.col("v").alias("_vec"))
    got = [(r["a"], r["b"]) for r in apply_cells(df, "_id", 4.0, pairs, "a long, b long", tile, pivots).collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = set(zip(*(z.tolist() for z in np.nonzero(np.triu(d <= 4.0, 1)))))
    assert len(got) == len(want) and set(got) == want
    assert apply_cells(df.limit(0), "_id", 4.0, pairs, "a long, b long").collect() == []


def test_dbscan_in_many_dimensions(spark):
    x, at = clustered(2, 300, 12, 5)
    got = {r["id"]: r["Cluster"] for r in K.dbscan(frame_of(spark, x), "v", "id", eps=6.0, min_samples=4, tile_rows=40).collect()}
    first = {c: int(np.nonzero(at == c)[0].min()) for c in set(at.tolist())}
    order = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    assert got == {i: order[c] for i, c in enumerate(at.tolist())}


def test_silhouette_squared(spark):
    x, at = clustered(3, 120, 5, 4)
    at[7] = 9                                                             # alone
    x += np.random.default_rng(0).normal(size=x.shape) * 8
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        mean = {c: d[i, (at == c) & (np.arange(len(x)) != i)].mean() for c in set(at) if c != at[i] or (at == c).sum() > 1}
        a = mean.pop(at[i], None)
        s.append(0.0 if a is None else (min(mean.values()) - a) / max(a, min(mean.values())))
    df = frame_of(spark, x, at)
    assert math.isclose(Q.silhouette_squared(df, "v", "lab").first()[0], np.mean(s), rel_tol=1e-9)
    odd = df.unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 5, None)], df.schema))
    assert math.isclose(Q.silhouette_squared(odd, "v", "lab").first()[0], np.mean(s), rel_tol=1e-9)
    assert Q.silhouette_squared(df.where("lab = 1"), "v", "lab").first()[0] is None
    assert Q.silhouette_squared(df.limit(0), "v", "lab").first()[0] is None
    same = frame_of(spark, np.zeros((4, 2)), [0, 0, 1, 1])
    assert Q.silhouette_squared(same, "v", "lab").first()[0] == 0.0


def test_silhouette_anchored(spark):
    x, at = clustered(4, 900, 4, 3)
    x += np.random.default_rng(0).normal(size=x.shape) * 6
    df = frame_of(spark, x, at)
    exact = Q.silhouette(df, "v", "lab", "id").first()[0]
    whole = Q.silhouette_anchored(df, "v", "lab", "id", 1000).first()
    assert math.isclose(whole["silhouette"], exact, rel_tol=1e-9) and whole["error"] == 0.0
    part = Q.silhouette_anchored(df, "v", "lab", "id", 60).first()
    assert 0 < part["error"] < 0.2 and abs(part["silhouette"] - exact) < 2 * part["error"]
    assert Q.silhouette_anchored(df.limit(0), "v", "lab", "id").first()["silhouette"] is None


def test_leaf_rows_are_the_tree(spark):
    x, at = clustered(5, 400, 3, 4)
    names = ["plain", "with space", "tick`s"]
    df = spark.createDataFrame([(*v.tolist(), int(c)) for v, c in zip(x, at)],
                               "plain double, `with space` double, `tick``s` double, Cluster int")
    model = X.surrogate_tree(df.toDF("a", "b", "c", "Cluster"), ["a", "b", "c"], depth=3)
    leaves = X.leaf_rows(model, names, spark)
    got = X.leaf_profile(df, leaves).orderBy("leaf").collect()
    from pyspark.ml.feature import VectorAssembler
    said = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(df.toDF("a", "b", "c", "Cluster")))
    assert len(got) == (model.numNodes + 1) // 2
    assert sum(r["rows"] for r in got) == 400
    assert sum(r["hits"] for r in got) == said.where("prediction = Cluster").count()
    for r in got:
        assert df.where(r["condition"]).count() == r["rows"]
    missing = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 0)], df.schema))
    assert sum(r["rows"] for r in X.leaf_profile(missing, leaves).collect()) in (400, 401)
    flat = X.surrogate_tree(df.selectExpr("plain", "1 AS Cluster"), ["plain"])
    assert [tuple(r) for r in X.leaf_rows(flat, ["plain"], spark).collect()] == [(0, 0, "TRUE", 1)]
