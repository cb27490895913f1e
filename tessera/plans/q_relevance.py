"""Feature-relevance queries (R1-R16) over the ``wide_numeric`` view of
lineitem and over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relevance as R
from tessera.plans import fixtures as FX
from tessera.plans.catalog import register

WIDE = ["quantity", "extendedprice", "discount", "tax", "linenumber"]
TARGET = "extendedprice"
FEATS = sorted(c for c in WIDE if c != TARGET)


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(WIDE):
        for b in WIDE[i:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 9) AS corr FROM w")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 9) FROM w")
    return f"WITH w AS {FX.view(FX.WIDE_NUMERIC_SQL)} " + " UNION ALL ".join(parts)


@register("correlation_pearson_wide", "R1", _pairs_sql())
def correlation_pearson_wide(spark, d):
    m = R.correlation_matrix(FX.wide_numeric(spark, d), WIDE)
    return m.select("column_a", "column_b", F.round("corr", 9).alias("corr"))


@register("target_correlation_pearson", "R1,A10", f"WITH w AS {FX.view(FX.WIDE_NUMERIC_SQL)} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{TARGET}' AS target, round(corr({f}, {TARGET}), 9) AS corr FROM w" for f in FEATS))
def target_correlation_pearson(spark, d):
    t = R.target_correlation(FX.wide_numeric(spark, d), [TARGET], FEATS, "pearson")
    return t.select("feature", "target", F.round("corr", 9).alias("corr"))


def _spearman_sql() -> str:
    parts = []
    for f in FEATS:
        parts.append(f"""SELECT '{f}' AS feature, '{TARGET}' AS target, round(corr(rx, ry), 9) AS corr FROM (
  SELECT rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY {TARGET}) + (count(*) OVER (PARTITION BY {TARGET}) - 1) / 2.0 AS ry FROM w)""")
    return f"WITH w AS {FX.view(FX.WIDE_NUMERIC_SQL)} " + " UNION ALL ".join(parts)


@register("target_correlation_spearman", "R2,F7", _spearman_sql())
def target_correlation_spearman(spark, d):
    t = R.target_correlation(FX.wide_numeric(spark, d), [TARGET], FEATS, "spearman")
    return t.select("feature", "target", F.round("corr", 9).alias("corr"))


@register("ols_single_feature", "R4", """
SELECT 'quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem
UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols_single_feature(spark, d):
    r = R.linear_regression(FX.wide_numeric(spark, d), TARGET, ["quantity"], summary=False)
    return r.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("ols_summary_wide", "R4")
def ols_summary_wide(spark, d):
    """Rows-only: OLS with standard errors, t, p and R^2 (numpy-tested)."""
    return R.linear_regression(FX.wide_numeric(spark, d), TARGET, FEATS, summary=True)


@register("polynomial_regression_wide", "R5")
def polynomial_regression_wide(spark, d):
    return R.polynomial_regression(FX.wide_numeric(spark, d), TARGET, ["discount", "quantity", "tax"], 2)


@register("ridge_wide", "R6")
def ridge_wide(spark, d):
    return R.ridge(FX.wide_numeric(spark, d), TARGET, FEATS, alpha=1.0)


@register("lasso_wide", "R7")
def lasso_wide(spark, d):
    return R.lasso(FX.wide_numeric(spark, d), TARGET, FEATS, alpha=0.01)


# the same operators on so few terms that the solution has a closed form
_S = """s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(t) AS mt,
  covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(z, y) AS zy,
  covar_pop(x, t) AS xt, covar_pop(t, t) AS tt, covar_pop(t, y) AS ty, covar_pop(y, y) AS yy
  FROM (SELECT l_quantity AS x, l_quantity * l_quantity AS t, l_discount AS z, l_extendedprice AS y FROM lineitem))"""


@register("ols_summary_quantity", "R4", f"""WITH {_S},
b AS (SELECT *, xy / xx AS b, yy * n - xy * xy / xx * n AS rss FROM s),
e AS (SELECT *, sqrt(rss / (n - 2) / (n * xx)) AS seb, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / (n * xx))) AS sea FROM b)
SELECT 'quantity' AS term, round(b, 5) AS coefficient, round(seb, 6) AS std_error, round(b / seb, 4) AS t_value, round(1 - rss / (n * yy), 8) AS r2 FROM e
UNION ALL SELECT 'intercept', round(my - b * mx, 5), round(sea, 6), round((my - b * mx) / sea, 4), round(1 - rss / (n * yy), 8) FROM e""")
def ols_summary_quantity(spark, d):
    r = R.linear_regression(FX.wide_numeric(spark, d), TARGET, ["quantity"], summary=True)
    return r.select("term", F.round("coefficient", 5).alias("coefficient"), F.round("std_error", 6).alias("std_error"),
                    F.round("t_value", 4).alias("t_value"), F.round("r2", 8).alias("r2"))


@register("polynomial_regression_quantity", "R5", f"""WITH {_S}
SELECT 'quantity' AS term, round((xy * tt - xt * ty) / (xx * tt - xt * xt), 4) AS coefficient FROM s
UNION ALL SELECT 'quantity^2', round((ty * xx - xt * xy) / (xx * tt - xt * xt), 4) FROM s""")
def polynomial_regression_quantity(spark, d):
    r = R.polynomial_regression(FX.wide_numeric(spark, d), TARGET, ["quantity"], 2)
    return r.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("ridge_quantity", "R6", f"""WITH {_S}, b AS (SELECT *, n * xy / (n * xx + 50000.0) AS b FROM s)
SELECT 'quantity' AS term, round(b, 4) AS coefficient FROM b UNION ALL SELECT 'intercept', round(my - b * mx, 4) FROM b""")
def ridge_quantity(spark, d):
    r = R.ridge(FX.wide_numeric(spark, d), TARGET, ["quantity"], alpha=50000.0)
    return r.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("lasso_quantity", "R7", f"""WITH {_S},
b AS (SELECT *, sign(xy) * greatest(abs(xy) - 1000.0, 0) / xx AS b FROM s)
SELECT 'quantity' AS term, round(b, 3) AS coefficient FROM b UNION ALL SELECT 'intercept', round(my - b * mx, 3) FROM b""")
def lasso_quantity(spark, d):
    r = R.lasso(FX.wide_numeric(spark, d), TARGET, ["quantity"], alpha=1000.0)
    return r.select("term", F.round("coefficient", 3).alias("coefficient"))


# two targets (price and tax) on two features, or on one where the method has a closed form for one only
_S2 = """s AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz,
  covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(x, t) AS xt, covar_pop(t, t) AS tt, covar_pop(t, y) AS ty,
  avg(t) AS mt, target FROM (
  SELECT l_quantity AS x, l_discount AS z, l_quantity * l_quantity AS t, l_extendedprice AS y, 'extendedprice' AS target FROM lineitem
  UNION ALL SELECT l_quantity, l_discount, l_quantity * l_quantity, l_tax, 'tax' FROM lineitem) GROUP BY target)"""


def _two_features(penalty: str) -> str:
    return f"""WITH {_S2}, d AS (SELECT *, xx + {penalty} AS a, zz + {penalty} AS c FROM s),
b AS (SELECT *, (xy * c - xz * zy) / (a * c - xz * xz) AS bx, (zy * a - xz * xy) / (a * c - xz * xz) AS bz FROM d)
SELECT target, 'quantity' AS term, round(bx, 7) AS coefficient FROM b UNION ALL SELECT target, 'discount', round(bz, 6) FROM b
UNION ALL SELECT target, 'intercept', round(my - bx * mx - bz * mz, 6) FROM b"""


def _two_targets(spark, d, features, **options):
    r = R.multi_target(FX.wide_numeric(spark, d), [TARGET, "tax"], features, **options)
    return r.select("target", "term", F.when(F.col("term").startswith("quantity"), F.round("coefficient", 7))
                    .otherwise(F.round("coefficient", 6)).alias("coefficient"))


@register("ols_two_targets", "R4", _two_features("0"))
def ols_two_targets(spark, d):
    return _two_targets(spark, d, ["quantity", "discount"])


@register("ridge_two_targets", "R6", _two_features("50000.0 / n"))
def ridge_two_targets(spark, d):
    return _two_targets(spark, d, ["quantity", "discount"], method="ridge", alpha=50000.0)


@register("lasso_two_targets", "R7", f"""WITH {_S2}, b AS (SELECT *, sign(xy) * greatest(abs(xy) - 0.0005, 0) / xx AS b FROM s)
SELECT target, 'quantity' AS term, round(b, 7) AS coefficient FROM b UNION ALL SELECT target, 'intercept', round(my - b * mx, 6) FROM b""")
def lasso_two_targets(spark, d):
    return _two_targets(spark, d, ["quantity"], method="lasso", alpha=0.0005)


@register("polynomial_two_targets", "R5", f"""WITH {_S2}, b AS (SELECT *, (xy * tt - xt * ty) / (xx * tt - xt * xt) AS bx,
  (ty * xx - xt * xy) / (xx * tt - xt * xt) AS bt FROM s)
SELECT target, '1' AS term, 0.0::DOUBLE AS coefficient FROM b
UNION ALL SELECT target, 'quantity', round(bx, 7) FROM b UNION ALL SELECT target, 'quantity^2', round(bt, 7) FROM b
UNION ALL SELECT target, 'intercept', round(my - bx * mx - bt * mt, 6) FROM b""")
def polynomial_two_targets(spark, d):
    return _two_targets(spark, d, ["quantity"], method="polynomial", bias=True)


@register("causal_effect_discount", "R12", f"""WITH {_S}, b AS (SELECT (xy * zz - xz * zy) / (xx * zz - xz * xz) AS b FROM s)
SELECT 'quantity' AS treatment, round(b, 4) AS effect FROM b UNION ALL SELECT 'all_treatments', round(b, 4) FROM b""")
def causal_effect_discount(spark, d):
    r = R.causal_effect(FX.wide_numeric(spark, d), TARGET, ["quantity"], ["discount"])
    return r.select("treatment", F.round("effect", 4).alias("effect"))


@register("poisson_quantity", "R8")
def poisson_quantity(spark, d):
    return R.poisson(FX.wide_numeric(spark, d), "quantity", ["discount", "linenumber", "tax"])


@register("gradient_boosting_wide", "R9")
def gradient_boosting_wide(spark, d):
    return R.gradient_boosting(FX.wide_numeric(spark, d), TARGET, FEATS, n_trees=10, max_depth=5)


@register("random_forest_wide", "R10")
def random_forest_wide(spark, d):
    return R.random_forest(FX.wide_numeric(spark, d), TARGET, FEATS, n_trees=20, max_depth=8)


def _mi_sql(bins: int = 10) -> str:
    probs = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    cols = FEATS + [TARGET]
    cuts = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {probs}))) AS c_{c}" for c in cols)
    binned = ", ".join(f"len(list_filter(c_{c}, lambda x: x <= {c})) AS b_{c}" for c in cols)
    joint = " UNION ALL ".join(f"SELECT '{f}' AS feature, b_{f} AS bx, b_{TARGET} AS bt FROM b" for f in FEATS)
    return f"""
WITH w AS {FX.view(FX.WIDE_NUMERIC_SQL)},
cuts AS (SELECT {cuts} FROM w),
b AS (SELECT {binned} FROM w, cuts),
j AS (SELECT feature, bx, bt, count(*) AS nxy FROM ({joint}) GROUP BY feature, bx, bt),
px AS (SELECT feature, bx, sum(nxy) AS nx FROM j GROUP BY feature, bx),
py AS (SELECT feature, bt, sum(nxy) AS ny FROM j GROUP BY feature, bt),
t AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY feature)
SELECT j.feature, '{TARGET}' AS target,
       round(sum((nxy / n) * ln((nxy * n) / (nx * ny))), 9) AS mi
FROM j JOIN px USING (feature, bx) JOIN py USING (feature, bt) JOIN t USING (feature)
GROUP BY j.feature"""


@register("mutual_information_wide", "R11", _mi_sql())
def mutual_information_wide(spark, d):
    mi = R.mutual_information(FX.wide_numeric(spark, d), [TARGET], FEATS, bins=10)
    return mi.select("feature", "target", F.round("mi", 9).alias("mi"))


#: p_size with gaps of both kinds.
GAPPY_SIZE = "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END"


def _mi_knn_sql(k=3):
    from tessera.functions.numbers import digamma_sql
    columns = {"p_partkey": "CAST(p_partkey AS DOUBLE)", "p_size": GAPPY_SIZE}
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, p_partkey AS id, {c} AS x, p_retailprice AS y FROM part" for f, c in columns.items())
    tol = "1e-12 * (abs({v}) + r + 1)"
    half = {v: f"greatest(r - {tol.format(v='a.' + v)}, {tol.format(v='a.' + v)})" for v in "xy"}
    return f"""
WITH u AS (SELECT * FROM ({parts}) WHERE x IS NOT NULL AND NOT isnan(x)),
p AS (SELECT feature, id, x / stddev_pop(x) OVER (PARTITION BY feature) AS x, y / stddev_pop(y) OVER (PARTITION BY feature) AS y FROM u),
r AS (SELECT a.feature, a.id, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k})[{k}] AS r
      FROM p a JOIN p b ON a.feature = b.feature AND a.id <> b.id GROUP BY a.feature, a.id),
q AS (SELECT p.*, r FROM p JOIN r USING (feature, id)),
c AS (SELECT a.feature, a.id, count(*) FILTER (abs(b.x - a.x) < {half['x']}) AS nx, count(*) FILTER (abs(b.y - a.y) < {half['y']}) AS ny
      FROM q a JOIN p b ON a.feature = b.feature GROUP BY a.feature, a.id)
SELECT feature, 'p_retailprice' AS target,
       round(greatest(0, {digamma_sql('count(*)')} + {digamma_sql(str(k))} - avg({digamma_sql('nx')} + {digamma_sql('ny')})), 9) AS mi
FROM c GROUP BY feature"""


@register("mutual_information_knn_part", "R11", _mi_knn_sql())
def mutual_information_knn_part(spark, d):
    from tessera.sources.tables import table
    part = table(spark, d, "part").withColumn("p_size", F.expr(GAPPY_SIZE))
    mi = R.mutual_information_knn(part, ["p_retailprice"], ["p_partkey", "p_size"])
    return mi.select("feature", "target", F.round("mi", 9).alias("mi"))


@register("causal_effect_single", "R12", """
SELECT 'quantity' AS treatment, round(regr_slope(l_extendedprice, l_quantity), 4) AS effect FROM lineitem
UNION ALL SELECT 'all_treatments', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def causal_effect_single(spark, d):
    r = R.causal_effect(FX.wide_numeric(spark, d), TARGET, ["quantity"])
    return r.select("treatment", F.round("effect", 4).alias("effect"))


@register("causal_effect_confounded", "R12")
def causal_effect_confounded(spark, d):
    return R.causal_effect(FX.wide_numeric(spark, d), TARGET, ["quantity"], ["discount", "tax"])


@register("rfe_wide", "R13")
def rfe_wide(spark, d):
    return R.rfe(FX.wide_numeric(spark, d), TARGET, FEATS, max_features=2, n_trees=5)


@register("top_features_pearson", "R16,A10,A11", f"""
WITH w AS {FX.view(FX.WIDE_NUMERIC_SQL)},
s AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, {TARGET})) AS importance FROM w" for f in FEATS)})
SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank
FROM s ORDER BY importance DESC, feature LIMIT 3""")
def top_features_pearson(spark, d):
    t = R.target_correlation(FX.wide_numeric(spark, d), [TARGET], FEATS, "pearson") \
        .select("feature", F.abs("corr").alias("importance"))
    names = R.top_features(t, 3)
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank long")


@register("kendall_part", "R3", """
WITH t AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS S FROM t a, t b),
n AS (SELECT count(*) AS n FROM t),
tx AS (SELECT sum(c * (c - 1) / 2) AS n1 FROM (SELECT count(*) AS c FROM t GROUP BY x)),
ty AS (SELECT sum(c * (c - 1) / 2) AS n2 FROM (SELECT count(*) AS c FROM t GROUP BY y))
SELECT 'p_size' AS feature, 'p_retailprice' AS target,
       round(S / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 9) AS corr FROM s, n, tx, ty""")
def kendall_part(spark, d):
    from tessera.sources.tables import table
    r = R.kendall(table(spark, d, "part"), "p_size", "p_retailprice")
    return r.select("feature", "target", F.round("corr", 9).alias("corr"))
