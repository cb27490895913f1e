"""Cases that earlier versions answered wrongly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scale import shorten_labels
from tessera.operators import cluster as K
from tessera.operators import profile as H
from tessera.operators import reduce as D
from tessera.operators import relevance as R
from tessera.sources import io as IO


def test_ward_uses_weights():
    groups = K._lance_williams(np.array([[0.0], [10.0], [14.0]]), np.array([1, 1000, 1000]), 2, "ward")
    assert groups[0] == groups[1] != groups[2]


def test_ward_equals_expanded_points():
    rng = np.random.default_rng(4)
    c, w = rng.normal(size=(7, 2)), rng.integers(1, 4, 7)
    expanded = np.repeat(np.arange(7), w)
    for k in (2, 3, 4):
        a = K._lance_williams(c, w, k, "ward")
        b = K._lance_williams(c[expanded], np.ones(len(expanded)), k, "ward")
        assert len({*zip(a[expanded].tolist(), b.tolist())}) == k


def test_factor_loadings_are_stationary():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(4000, 6)) * [0.5, 1, 0.7, 0.9, 1.2, 0.6]
    cov = np.cov(x.T, bias=True)
    load, noise = D.factor_loadings(cov, 2, 4000, tol=1e-12)
    model = load @ load.T + np.diag(noise)
    assert np.allclose(np.diag(model), np.diag(cov), rtol=1e-4)       # true at the maximum of the likelihood
    inverse = np.linalg.inv(model)
    slope = inverse @ (cov - model) @ inverse @ load
    assert np.abs(slope).max() < 1e-3
    weighted = load / np.sqrt(noise)[:, None]
    cross = weighted.T @ weighted
    assert abs(cross[0, 1]) < 1e-6 * cross[0, 0] and cross[0, 0] >= cross[1, 1]


def test_optimal_k_by_silhouette(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(c + rng.normal(0, 0.1)), float(-c)) for i, c in enumerate(np.repeat([0, 10, 20], 15))]
    out = R.optimal_k(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], max_k=5, id_col="id").collect()
    assert [r["k"] for r in out if r["best"]] == [3]


def test_correlation_skips_nan(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 6.0), (float("nan"), 1.0), (None, 3.0)]
    m = {(r["column_a"], r["column_b"]): r["corr"] for r in R.correlation_matrix(
        spark.createDataFrame(rows, "a double, b double")).collect()}
    assert m["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 6])[0, 1])


def test_short_labels_are_unique(spark):
    rows = list(enumerate(["abc", "abc", "abc(2)", "a long label for all", "a long label for some"]))
    out = [r["short_label"] for r in shorten_labels(spark.createDataFrame(rows, "i long, label string"), "label", "i").orderBy("i").collect()]
    assert out == ["abc", "abc(2)", "abc(2)(2)", "a long label fo...", "a long label fo...(2)"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'He said "hi"', "  pad "), ("2", "two\nlines, and; more", "x"), ("3", '"', "\ttab")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    IO.write_table(df, f"{tmp_path}/t")
    assert sorted(map(tuple, IO.read_table(spark, f"{tmp_path}/t", infer=False).collect())) == rows


def test_integers_of_any_length(spark):
    df = spark.createDataFrame([("12345678901234567890", "9" * 40, "7", "1.5"), ("-2", "1", " 8 ", "2")], "a string, b string, c string, d string")
    assert IO.inferred_types(df) == {"a": "decimal(38,0)", "b": "string", "c": "long", "d": "double"}
    assert [str(r["a"]) for r in IO.infer_types(df).collect()] == ["12345678901234567890", "-2"]


def test_char_issues_with_repeated_id(spark):
    df = spark.createDataFrame([(1, "a–b"), (1, "c–d"), (2, "e€f")], "id long, t string")
    out = H.char_issues(df, "id").groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.max("occurrences").alias("k")).collect()
    assert {r["ch"]: (r["n"], r["k"]) for r in out} == {"–": (1, 2), "€": (1, 1)}


def test_reduction_parameters():
    for method in D.DEFAULTS:
        assert isinstance(D.validate_params(method, {}), dict)
    with pytest.raises(ValueError):
        D.validate_params("PCA", {"no_such_parameter": 1})


def test_layout_eigenvectors_equal_dense(spark, small_dir):
    from tessera.functions.eigen import smallest_eigenvectors
    rng = np.random.default_rng(7)
    n = 60
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.2), 1)
    a = a + a.T
    lap = np.diag(a.sum(1)) - a
    i, j = np.nonzero(lap)
    edges = spark.createDataFrame([(int(x), int(y), float(lap[x, y])) for x, y in zip(i, j)], "i long, j long, a double")
    v, theta, residual = smallest_eigenvectors(edges, spark.range(n), 3)
    value, basis = np.linalg.eigh(lap)
    got = v.orderBy("id").toPandas()[["v1", "v2", "v3"]].to_numpy()
    assert residual <= 1e-4 and np.allclose(theta, value[:3], atol=1e-4)
    overlap = np.linalg.svd(np.linalg.qr(got)[0].T @ basis[:, :3])[1]
    assert overlap.min() > np.cos(np.radians(1))
