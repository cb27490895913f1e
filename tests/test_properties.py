"""numpy property tests for operators without an exact SQL oracle, and
brute-force checks on small fixtures derived from the supplied tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import encode as E
from tessera.operators import neighbors as NB
from tessera.operators import reduce as D
from tessera.operators import relevance as R
from tessera.plans.fixtures import wide_numeric
from tessera.sources.tables import table

WIDE_FEATS = ["discount", "linenumber", "quantity", "tax"]


@pytest.fixture(scope="module")
def wide_np(spark, small_dir):
    pdf = wide_numeric(spark, small_dir).toPandas()
    return pdf, pdf[WIDE_FEATS].to_numpy(), pdf["extendedprice"].to_numpy()


def _ols(X, y):
    A = np.column_stack([X, np.ones(len(X))])
    return np.linalg.lstsq(A, y, rcond=None)[0]


def test_ols_matches_closed_form(spark, small_dir, wide_np):
    _, X, y = wide_np
    got = {r.term: r.coefficient for r in R.linear_regression(wide_numeric(spark, small_dir), "extendedprice",
                                                              WIDE_FEATS, summary=True).collect()}
    want = _ols(X, y)
    for i, f in enumerate(WIDE_FEATS):
        assert got[f] == pytest.approx(want[i], rel=1e-6, abs=1e-6)
    assert got["intercept"] == pytest.approx(want[-1], rel=1e-6, abs=1e-4)


def test_ridge_matches_closed_form(spark, small_dir, wide_np):
    _, X, y = wide_np
    alpha = 1.0
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    got = {r.term: r.coefficient for r in R.ridge(wide_numeric(spark, small_dir), "extendedprice",
                                                  WIDE_FEATS, alpha).collect()}
    for i, f in enumerate(WIDE_FEATS):
        assert got[f] == pytest.approx(w[i], rel=1e-4, abs=1e-3)


def test_lasso_zero_penalty_limit_is_ols(spark, small_dir, wide_np):
    _, X, y = wide_np
    got = {r.term: r.coefficient for r in R.lasso(wide_numeric(spark, small_dir), "extendedprice",
                                                  WIDE_FEATS, alpha=1e-9).collect()}
    want = _ols(X, y)
    assert got["quantity"] == pytest.approx(want[WIDE_FEATS.index("quantity")], rel=1e-3)


def test_polynomial_term_names():
    names = [n for n, _ in R.poly_terms(["a", "b"], 2)]
    assert names == ["a", "b", "a^2", "a b", "b^2"]


def test_pca_matches_svd(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    got = D.pca(e, "embedding", "vec_id", 2).orderBy("vec_id").toPandas()
    X = np.stack(e.orderBy("vec_id").toPandas()["embedding"].map(lambda v: np.asarray(v, float)).values)
    Xc = X - X.mean(0)
    _, _, Vt = np.linalg.svd(Xc, full_matrices=False)
    for j in range(2):
        v = Vt[j] * np.sign(Vt[j][np.argmax(np.abs(Vt[j]))])
        np.testing.assert_allclose(got[f"PC{j + 1}"].to_numpy(), Xc @ v, rtol=1e-6, atol=1e-8)


def test_factor_analysis_shapes(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    w = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(6)])
    fa = D.factor_analysis(w, [f"f{i}" for i in range(6)], "vec_id", 2).toPandas()
    assert list(fa.columns) == ["vec_id", "FA1", "FA2"] and len(fa) == e.count()
    assert np.isfinite(fa[["FA1", "FA2"]].to_numpy()).all()


def test_knn_matches_brute_force(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    got = NB.knn(e, "vec_id", "embedding", k=3, tile_rows=128).orderBy("id", "rank").toPandas()
    pdf = e.orderBy("vec_id").toPandas()
    X = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, float)).values)
    ids = pdf["vec_id"].to_numpy()
    Dm = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(Dm, np.inf)
    for r, i in enumerate(ids[:50]):
        want = ids[np.lexsort((ids, Dm[r]))[:3]]
        assert got[got.id == i].nbr.tolist() == want.tolist()


def _dbscan_brute(X, eps, min_samples):
    """Sequential DBSCAN in index order (the textbook expansion)."""
    n = len(X)
    Dm = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.nonzero(Dm[i] <= eps)[0] for i in range(n)]
    core = np.array([len(v) >= min_samples for v in nb])
    labels = np.full(n, -1)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = c
        stack = [i]
        while stack:
            p = stack.pop()
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return labels


@pytest.mark.parametrize("grid", [True, False])
def test_dbscan_matches_sequential(spark, small_dir, grid):
    e = table(spark, small_dir, "events")
    pts = e.select("event_id", (F.col("value") / 500.0).alias("x"),
                   ((F.hour("ts") + F.col("user_id") % 5) / 30.0).alias("y"))
    got = K.dbscan(pts, ["x", "y"], "event_id", eps=0.02, min_samples=4, tile_rows=200, grid=grid) \
        .orderBy("event_id").toPandas()
    pdf = pts.orderBy("event_id").toPandas()
    want = _dbscan_brute(pdf[["x", "y"]].to_numpy(), 0.02, 4)
    core_clusters = got.Cluster.to_numpy()
    # identical labels: clusters are numbered by their smallest core id and a
    # border point joins the smallest adjacent cluster, which is what the
    # sequential expansion in index order produces
    assert core_clusters.tolist() == want.tolist()


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "src long, dst long")
    verts = spark.createDataFrame([(i,) for i in [1, 2, 3, 5, 10, 11, 20]], "id long")
    got = {r.id: r.component for r in NB.connected_components(edges, verts).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 10: 10, 11: 10, 20: 20}


def test_kmeans_and_gmm_shapes(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    km = K.kmeans(e, "embedding", "vec_id", k=4)
    assert km.count() == e.count() and km.select("Cluster").distinct().count() == 4
    unknown = pytest.raises(ValueError)
    with unknown:
        K.run_clustering("NOPE", e, "embedding", "vec_id")


def test_agglomerative_lance_williams_single():
    C = np.array([[0.0], [1.0], [10.0], [11.0]])
    g = K._lance_williams(C, np.ones(4), 2, "single")
    assert g.tolist() == [0, 0, 1, 1]


def test_one_hot_null_column_and_minmax_constant(spark):
    df = spark.createDataFrame([(1, "b", 3.0), (2, None, 3.0), (3, "a", 3.0)], "id long, c string, v double")
    oh = E.one_hot(df, ["c"]).orderBy("id").collect()
    assert [r.c_a for r in oh] == [0.0, 0.0, 1.0] and [r.c_nan for r in oh] == [0.0, 1.0, 0.0]
    mm = E.minmax(df, ["v"]).collect()
    assert {r.v for r in mm} == {0.0}


def test_rank_helpers_on_hot_group(spark):
    from tessera.functions.ranking import group_row_number
    rows = [(i, "hot" if i % 3 else f"g{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = group_row_number(df, ["g"], "id", n_blocks=7).where("g = 'hot'").orderBy("id").collect()
    assert [r.rn for r in got] == list(range(1, 201))


def test_exact_quantiles(spark):
    from tessera.functions.quantiles import exact_quantiles
    vals = [float(v) for v in [5, 1, 9, 3, 3, 7, 2, 8]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_quantiles(df, [], "v", [0.25, 0.5, 0.9]).first()
    want = np.quantile(vals, [0.25, 0.5, 0.9])
    assert [r.q_0, r.q_1, r.q_2] == pytest.approx(list(want))
    assert not math.isnan(r.q_0)


def test_lle_weights_sum_to_one_and_layout(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    w = D.lle_weights(e, "embedding", "vec_id", k=6).toPandas()
    sums = w.groupby("i")["w"].sum().to_numpy()
    np.testing.assert_allclose(sums, 1.0, atol=1e-9)
    assert (w.groupby("i").size() == 6).all()
    lay = D.lle_layout(e, "embedding", "vec_id", 2, k=6).toPandas()
    assert list(lay.columns) == ["vec_id", "LLE1", "LLE2"] and len(lay) == e.count()
    assert np.isfinite(lay[["LLE1", "LLE2"]].to_numpy()).all()


def test_isomap_shapes(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    iso = D.isomap(e, "embedding", "vec_id", 2, k=5, landmarks=20).toPandas()
    assert list(iso.columns) == ["vec_id", "ISO1", "ISO2"] and len(iso) == e.count()
    assert np.isfinite(iso[["ISO1", "ISO2"]].to_numpy()).all()
