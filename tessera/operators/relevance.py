"""Feature relevance against a target.

Correlations are aggregates (one pass for the whole Pearson matrix);
Spearman ranks come from distinct (feature, x, y) counts and the skew-safe
average-rank scheme, so no row ids are needed; mutual information bins each
column at exact quantile cut points and sums p*ln(p/(px*py)) from one joint
count aggregate; regressions and tree importances are Spark ML estimators
(distributed training, model-sized results on the driver)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import columns_of_kind, qcol
from tessera.functions.numbers import digamma_sql
from tessera.functions.planar import kth_distance
from tessera.functions.quantiles import cumulative_counts, exact_quantiles
from tessera.functions.ranking import average_rank
from tessera.session import cut_lineage

TREE_ROWS = 500_000       # rows of one partition that trees are fitted to


def _features(df: DataFrame, targets: list[str], features: list[str] | None) -> list[str]:
    if features is not None:
        return sorted(features)
    return sorted(c for c in columns_of_kind(df, "numeric") if c not in targets)


def _number(c: str):
    """A column as double, NaN as NULL (missing, as in a data frame library)."""
    v = qcol(c).cast("double")
    return F.when(~F.isnan(v), v)


# ---------------------------------------------------------------- R1
def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """R1 full matrix as (column_a, column_b, corr): one aggregate with a
    ``corr`` per unordered pair (pairwise-complete: rows with a NULL or NaN in
    either column are skipped)."""
    cols = cols or columns_of_kind(df, "numeric")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(_number(a), _number(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    items = []
    for k, (a, b) in enumerate(pairs):
        items.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{k}").alias("corr")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"c{k}").alias("corr")))
    return row.select(F.inline(F.array(*items)))


def target_correlation(df: DataFrame, targets: list[str], features: list[str] | None = None,
                       method: str = "pearson") -> DataFrame:
    """(feature, target, corr) with the targets' own rows removed,
    sorted ascending by corr (the reference's bar order)."""
    feats = _features(df, targets, features)
    if method == "pearson":
        m = correlation_matrix(df, feats + list(targets))
        out = m.where(F.col("column_b").isin(targets) & ~F.col("column_a").isin(targets)) \
            .select(F.col("column_a").alias("feature"), F.col("column_b").alias("target"), "corr")
    elif method in ("spearman", "kendall"):
        out = None
        for t in targets:
            parts = [spearman(df, feats, t)] if method == "spearman" else [kendall(df, f, t) for f in feats]
            for part in parts:
                out = part if out is None else out.unionByName(part)
    else:
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    return out.orderBy("target", "corr", "feature")


# ---------------------------------------------------------------- R2
def spearman(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """R2: Pearson correlation of average ranks, pairwise-complete per
    feature. Rows collapse to distinct (feature, x, y) with counts; ranks of
    x and of y are computed within each feature's complete pairs."""
    # the feature as a number: a short key; counted once, as five branches read the counts
    items = F.array(*[F.struct(F.lit(i).alias("f"), _number(f).alias("x")) for i, f in enumerate(features)])
    longf = df.select(_number(target).alias("y"), F.inline(items)) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = cut_lineage(longf.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    rx, ry = (average_rank(cut_lineage(pairs.groupBy("f", v).agg(F.sum("n").alias("n"))), ["f"], v, "n", f"r{v}") for v in "xy")
    j = pairs.join(rx.select("f", "x", "rx"), ["f", "x"]).join(ry.select("f", "y", "ry"), ["f", "y"])
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = j.groupBy("f").agg(F.sum(n).alias("N"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"),
                           F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"),
                           F.sum(n * a * b).alias("sab"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("N")
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("N")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("N")
    names = F.array(*[F.lit(f) for f in features])
    return s.select(F.get(names, F.col("f")).alias("feature"), F.lit(target).alias("target"),
                    (cov / F.sqrt(va * vb)).alias("corr"))


# ---------------------------------------------------------------- R4-R8
def _assemble(df: DataFrame, feats: list[str], target: str) -> DataFrame:
    clean = df.select(*[_number(c).alias(c) for c in feats], _number(target).alias("_y")).na.drop()
    return VectorAssembler(inputCols=feats, outputCol="_x").transform(clean).select("_x", "_y")


def _spread(data: DataFrame, rows: int = TREE_ROWS) -> DataFrame:
    """``data`` in partitions of at most about ``rows`` rows, for methods that keep them in memory and read
    them in every step: one split of a compressed file holds many more."""
    parts = math.ceil(data.count() / rows)
    return data.repartition(parts) if parts > data.rdd.getNumPartitions() else data


def _coef_frame(spark, names, coefs, extra=None):
    rows = []
    for i, (n, c) in enumerate(zip(names, coefs)):
        r = {"term": n, "coefficient": float(c)}
        for k, vals in (extra or {}).items():
            r[k] = float(vals[i]) if vals is not None else None
        rows.append(r)
    cols = ["term", "coefficient"] + list((extra or {}).keys())
    schema = ", ".join([f"{c} {'string' if c == 'term' else 'double'}" for c in cols])
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)


def linear_regression(df: DataFrame, target: str, features: list[str] | None = None,
                      summary: bool = True) -> DataFrame:
    """OLS coefficients and intercept; with ``summary`` also standard
    errors, t and p values (normal-equation solver: one distributed pass
    builds the p x p Gram matrix)."""
    feats = _features(df, [target], features)
    m = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=0.0) \
        .fit(_assemble(df, feats, target))
    names = feats + ["intercept"]
    coefs = list(m.coefficients) + [m.intercept]
    extra = None
    if summary:
        s = m.summary
        extra = {"std_error": s.coefficientStandardErrors, "t_value": s.tValues, "p_value": s.pValues}
    out = _coef_frame(df.sparkSession, names, coefs, extra)
    if summary:
        out = out.withColumn("r2", F.lit(float(m.summary.r2)))
    return out


def poly_terms(feats: list[str], degree: int = 2) -> list[tuple[str, list[str]]]:
    """Polynomial term names in scikit-style order: ``a``, ``b``, ``a^2``,
    ``a b``, ``b^2`` ... (all monomials of degree 1..d, graded lexicographic)."""
    terms: list[tuple[str, list[str]]] = []

    def rec(start: int, left: int, chosen: list[int]):
        if left == 0:
            counts: dict[int, int] = {}
            for i in chosen:
                counts[i] = counts.get(i, 0) + 1
            name = " ".join(feats[i] if k == 1 else f"{feats[i]}^{k}" for i, k in sorted(counts.items()))
            terms.append((name, [feats[i] for i in chosen]))
            return
        for i in range(start, len(feats)):
            rec(i, left - 1, chosen + [i])

    for d in range(1, degree + 1):
        rec(0, d, [])
    return terms


def polynomial_regression(df: DataFrame, target: str, features: list[str] | None = None,
                          degree: int = 2) -> DataFrame:
    """OLS on explicit polynomial terms; (term, coefficient) ranked by
    absolute value."""
    feats = _features(df, [target], features)
    terms = poly_terms(feats, degree)
    expanded = df.select(*[F.aggregate(F.array(*[qcol(c).cast("double") for c in cols]), F.lit(1.0),
                                       lambda acc, v: acc * v).alias(f"t{i}") for i, (_, cols) in enumerate(terms)],
                         qcol(target).cast("double").alias(target))
    names = [f"t{i}" for i in range(len(terms))]
    m = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=0.0) \
        .fit(_assemble(expanded, names, target))
    out = _coef_frame(df.sparkSession, [n for n, _ in terms], list(m.coefficients))
    return out.orderBy(F.abs("coefficient").desc(), "term")


def ridge(df: DataFrame, target: str, features: list[str] | None = None, alpha: float = 1.0) -> DataFrame:
    """L2 with sklearn's alpha. Spark scales the penalty by the label's
    population standard deviation and 1/n, so regParam = alpha/n * std(y)."""
    feats = _features(df, [target], features)
    data = _assemble(df, feats, target)
    st = data.agg(F.count("_y").alias("n"), F.stddev_pop("_y").alias("sd")).first()
    reg = alpha / st["n"] * st["sd"]
    m = LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=0.0, regParam=reg,
                         standardization=False, maxIter=1000, tol=1e-12).fit(data)
    return _coef_frame(df.sparkSession, feats + ["intercept"], list(m.coefficients) + [m.intercept])


def lasso(df: DataFrame, target: str, features: list[str] | None = None, alpha: float = 0.01,
          max_iter: int = 5000) -> DataFrame:
    """L1 with sklearn's alpha (Spark's label scaling makes regParam =
    alpha equivalent)."""
    feats = _features(df, [target], features)
    m = LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=alpha,
                         standardization=False, maxIter=max_iter, tol=1e-10).fit(_assemble(df, feats, target))
    return _coef_frame(df.sparkSession, feats + ["intercept"], list(m.coefficients) + [m.intercept])


def _cross_products(data: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred cross products) of complete numeric columns: one
    aggregate for the means, one table of len(cols) squared sums a task."""
    first = data.agg(F.count(F.lit(1)), *[F.avg(qcol(c)) for c in cols]).first()
    n = first[0]
    if not n:
        return 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    means = np.array(first[1:], dtype=np.float64)
    width = len(cols)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((width, width))
        for f in frames:
            x = f.to_numpy(np.float64) - means
            g += x.T @ x
        i, j = np.indices(g.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": g.ravel()})

    g = np.zeros((width, width))
    for r in data.select(*[qcol(c) for c in cols]).mapInPandas(sums, "i int, j int, v double") \
            .groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        g[r["i"], r["j"]] = r["v"]
    return n, means, g


def _lasso_path(gram: np.ndarray, cov: np.ndarray, alpha: float, max_iter: int, tol: float = 1e-12) -> np.ndarray:
    """Cyclic coordinate descent of |y - Xw|^2 / 2n + alpha |w|_1 on X'X / n and X'y / n."""
    w = np.zeros(len(cov))
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            rest = cov[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            moved = max(moved, abs(new - w[j]) * math.sqrt(gram[j, j]))
            w[j] = new
        if moved <= tol * max(1.0, float(np.abs(cov).max())):
            return w
    raise ValueError(f"lasso has not converged after {max_iter} rounds")


def multi_target(df: DataFrame, targets: list[str], features: list[str] | None = None, method: str = "ols",
                 alpha: float = 1.0, degree: int = 2, bias: bool = False, max_iter: int = 5000) -> DataFrame:
    """R4-R7 for several targets at once: (target, term, coefficient), the
    intercept as the last term of each target. ``method`` is ``ols``, ``polynomial``
    (terms up to ``degree``; with ``bias`` a constant term ``1``, whose coefficient is 0 beside the
    intercept), ``ridge`` or ``lasso``.

    The cross products of all terms and targets are summed in one pass; every target is a
    right-hand side of the same terms x terms system. Rows with a null or NaN in any of the columns are
    left out; without any row coefficients are null. Of collinear terms the smallest
    solution in standardised units is taken, and a constant feature has coefficient 0."""
    if method not in ("ols", "polynomial", "ridge", "lasso"):
        raise ValueError(f"unknown method {method!r}")
    feats = _features(df, targets, features)
    terms = poly_terms(feats, degree) if method == "polynomial" else [(f, [f]) for f in feats]
    clean = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(feats)],
                      *[_number(t).alias(f"y{i}") for i, t in enumerate(targets)]).na.drop()
    place = {f: f"x{i}" for i, f in enumerate(feats)}
    products = [functools.reduce(lambda a, b: a * b, [F.col(place[f]) for f in fs]) for _, fs in terms]
    cols = [f"t{i}" for i in range(len(terms))] + [f"y{i}" for i in range(len(targets))]
    data = clean.select(*[x.alias(f"t{i}") for i, x in enumerate(products)], *[f"y{i}" for i in range(len(targets))])
    n, means, g = _cross_products(data, cols)
    p = len(terms)
    gram, cov = g[:p, :p], g[:p, p:]
    if method == "ridge":
        w = np.linalg.lstsq(gram + alpha * np.eye(p), cov, rcond=None)[0]
    elif method == "lasso":
        w = np.stack([_lasso_path(gram / max(n, 1), cov[:, t] / max(n, 1), alpha, max_iter) for t in range(len(targets))], 1)
    else:
        unit = np.sqrt(np.diag(gram))
        unit[unit == 0] = 1.0
        w = np.linalg.lstsq(gram / np.outer(unit, unit), cov / unit[:, None], rcond=1e-13)[0] / unit[:, None]
    rows = []
    for t, target in enumerate(targets):
        if method == "polynomial" and bias:
            rows.append((target, "1", 0.0 if n else None))
        rows += [(target, name, float(w[i, t]) if n else None) for i, (name, _) in enumerate(terms)]
        rows.append((target, "intercept", float(means[p + t] - means[:p] @ w[:, t]) if n else None))
    return df.sparkSession.createDataFrame(rows, "target string, term string, coefficient double")


def poisson(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Poisson GLM with log link; (term, coefficient, std_error,
    p_value) ranked by |coefficient|, intercept named ``const``."""
    feats = _features(df, [target], features)
    m = GeneralizedLinearRegression(featuresCol="_x", labelCol="_y", family="poisson", link="log") \
        .fit(_assemble(df, feats, target))
    s = m.summary
    out = _coef_frame(df.sparkSession, feats + ["const"], list(m.coefficients) + [m.intercept],
                      {"std_error": s.coefficientStandardErrors, "p_value": s.pValues})
    return out.orderBy(F.abs("coefficient").desc(), "term")


# ---------------------------------------------------------------- R9 / R10
def gradient_boosting(df: DataFrame, target: str, features: list[str] | None = None,
                      n_trees: int = 20, max_depth: int = 6, step: float = 0.3, seed: int = 42) -> DataFrame:
    """Gradient-boosted trees, (feature, importance) ascending. Spark's
    split-gain importances, so compare ranks with other libraries."""
    feats = _features(df, [target], features)
    m = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=n_trees, maxDepth=max_depth,
                     stepSize=step, seed=seed).fit(_spread(_assemble(df, feats, target)))
    imp = m.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)],
                                           "feature string, importance double").orderBy("importance", "feature")


def random_forest(df: DataFrame, target: str, features: list[str] | None = None,
                  n_trees: int = 100, max_depth: int = 10, seed: int = 42) -> DataFrame:
    """Random forest importances, descending."""
    feats = _features(df, [target], features)
    m = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=n_trees, maxDepth=max_depth,
                              seed=seed).fit(_spread(_assemble(df, feats, target)))
    imp = m.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)],
                                           "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


# ---------------------------------------------------------------- R11
def quantile_cuts(df: DataFrame, cols: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Exact cut points at i/bins (linear interpolation), deduplicated;
    O(columns x bins) numbers reach the driver."""
    probs = [i / bins for i in range(1, bins)]
    items = F.array(*[F.struct(F.lit(c).alias("_col"), qcol(c).cast("double").alias("_v")) for c in cols])
    longf = df.select(F.inline(items))
    q = exact_quantiles(longf, ["_col"], "_v", probs).collect()
    out = {}
    for r in q:
        cuts = sorted({r[f"q_{i}"] for i in range(len(probs)) if r[f"q_{i}"] is not None})
        out[r["_col"]] = cuts
    return out


def bin_expr(col, cuts: list[float]):
    """Bin index = number of cut points <= x (NULL stays NULL)."""
    arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(col.isNotNull(), F.size(F.filter(arr, lambda c: c <= col)))


def mutual_information(df: DataFrame, targets: list[str], features: list[str] | None = None,
                       bins: int = 10) -> DataFrame:
    """Quantile-binned mutual information (nats) of each feature with
    each target, sorted ascending. One joint (feature, bin_x, bin_y) count
    aggregate per target; bins from exact quantiles."""
    feats = _features(df, targets, features)
    cuts = quantile_cuts(df, feats + [t for t in targets if t not in feats], bins)
    out = None
    for t in targets:
        items = F.array(*[F.struct(F.lit(f).alias("feature"),
                                   bin_expr(_number(f), cuts[f]).alias("bx")) for f in feats])
        longf = df.select(bin_expr(_number(t), cuts[t]).alias("by"), F.inline(items)) \
            .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
        joint = longf.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
        px = joint.groupBy("feature", "bx").agg(F.sum("nxy").alias("nx"))
        py = joint.groupBy("feature", "by").agg(F.sum("nxy").alias("ny"))
        tot = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
        j = joint.join(px, ["feature", "bx"]).join(py, ["feature", "by"]).join(tot, "feature")
        term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
        mi = j.groupBy("feature").agg(F.sum(term).alias("mi")).withColumn("target", F.lit(t))
        out = mi if out is None else out.unionByName(mi)
    return out.select("feature", "target", "mi").orderBy("target", "mi", "feature")


#: Distances closer than this share of the numbers at hand count as equal.
EQUAL = 1e-12


def mutual_information_knn(df: DataFrame, targets: list[str], features: list[str] | None = None,
                           k: int = 3) -> DataFrame:
    """Mutual information (nats) by nearest neighbours (Kraskov, Stoegbauer
    and Grassberger 2004), sorted ascending: with r the distance to the k-th
    neighbour in the plane of feature and target (scaled to unit variance, larger of
    both axes), digamma(n) + digamma(k) less the mean digamma of the rows
    strictly nearer than r on either axis, the row itself included; 0 if negative.

    Rows with a NULL or NaN in the pair are skipped; a pair with k rows or fewer has
    a null score. No noise is added: where the k-th distance is 0, rows at the same
    value count. One pass finds all k-th distances in tiles of the plane
    (:mod:`tessera.functions.planar`); ranges on an axis are differences of
    cumulative counts over the sorted values."""
    feats = _features(df, targets, features)
    pairs = [(f, t) for t in targets for f in feats]
    items = F.array(*[F.struct(F.lit(f"{i}").alias("g"), _number(f).alias("x"), _number(t).alias("y")) for i, (f, t) in enumerate(pairs)])
    rows = df.select(F.inline(items)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    scale = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    spark, schema = df.sparkSession, "g string, n long, sx double, sy double"
    found = scale.collect()                                         # a row a pair
    scale = F.broadcast(spark.createDataFrame([(r["g"], r["n"], r["sx"] or 1.0, r["sy"] or 1.0) for r in found], schema))
    scaled = rows.join(scale, "g").select("g", (F.col("x") / F.col("sx")).alias("x"), (F.col("y") / F.col("sy")).alias("y"))
    near = cut_lineage(kth_distance(scaled, k).where(F.col("r") != float("inf")))

    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))
    sides = near.select("g", "x", "y", "w", "r", F.inline(axes))
    tol = F.lit(EQUAL) * (F.abs("v") + F.col("r") + 1)
    sides = sides.withColumn("h", F.greatest(F.col("r") - tol, tol))
    # how many values come before the upper end, less how many up to the lower end
    ends = F.array(F.struct((F.col("v") + F.col("h")).alias("at"), F.lit(0).alias("kind")),
                   F.struct((F.col("v") - F.col("h")).alias("at"), F.lit(2).alias("kind")))
    asked = sides.select("g", "axis", "x", "y", "w", F.inline(ends))
    values = sides.groupBy("g", "axis", F.col("v").alias("at")).agg(F.sum("w").alias("w")).withColumn("kind", F.lit(1))
    events = values.unionByName(asked.select("g", "axis", "at", "kind").distinct().withColumn("w", F.lit(0).cast("long")))
    counted = cumulative_counts(events, ["g", "axis"], "at", "w", ties=("kind",)).where(F.col("kind") != 1) \
        .select("g", "axis", "at", "kind", "before")
    rows_in = asked.join(counted, ["g", "axis", "at", "kind"]).groupBy("g", "axis", "x", "y", "w") \
        .agg(F.sum(F.when(F.col("kind") == 0, F.col("before")).otherwise(-F.col("before"))).alias("m"))
    sums = rows_in.groupBy("g").agg(F.sum(F.col("w") * F.expr(digamma_sql("m"))).alias("s"))
    names = spark.createDataFrame([(f"{i}", f, t) for i, (f, t) in enumerate(pairs)], "g string, feature string, target string")
    mi = F.expr(f"{digamma_sql('n')} + {digamma_sql(str(k))} - s / n")
    return F.broadcast(names).join(scale, "g", "left").join(sums, "g", "left") \
        .select("feature", "target", F.when(F.col("s").isNotNull(), F.greatest(mi, F.lit(0.0))).alias("mi")).orderBy("target", "mi", "feature")


# ---------------------------------------------------------------- R12-R16
def causal_effect(df: DataFrame, outcome: str, treatments: list[str] | None = None,
                  confounders: list[str] | None = None) -> DataFrame:
    """Back-door adjusted linear regression. Outcome on treatments +
    confounders; each treatment's coefficient is its effect, and the row
    ``all_treatments`` is the effect of moving every treatment 0 -> 1."""
    treatments = treatments or _features(df, [outcome], None)
    confounders = confounders or []
    cols = list(treatments) + [c for c in confounders if c not in treatments]
    m = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=0.0) \
        .fit(_assemble(df, cols, outcome))
    coefs = dict(zip(cols, m.coefficients))
    rows = [(t, float(coefs[t])) for t in treatments]
    rows.append(("all_treatments", float(sum(coefs[t] for t in treatments))))
    return df.sparkSession.createDataFrame(rows, "treatment string, effect double")


def top_features(scores: DataFrame, n: int, score_col: str = "importance",
                 name_col: str = "feature") -> list[str]:
    """The n best-scoring feature names (O(features) to the driver)."""
    return [r[name_col] for r in scores.orderBy(F.col(score_col).desc(), name_col).limit(n).collect()]


def rfe(df: DataFrame, target: str, features: list[str] | None = None, max_features: int = 10,
        n_trees: int = 10, seed: int = 42) -> DataFrame:
    """Recursive elimination: refit boosted trees and drop the least
    important feature until ``max_features`` remain; (feature, ranking)
    with 1 = kept, higher = dropped earlier... reversed order of removal."""
    feats = _features(df, [target], features)
    data = df.select(*[qcol(c).cast("double").alias(c) for c in feats],
                     qcol(target).cast("double").alias(target)).na.drop()
    data = data.persist()
    ranking = {}
    alive = list(feats)
    while len(alive) > max_features:
        imp = gradient_boosting(data, target, alive, n_trees=n_trees, seed=seed).collect()
        worst = min(imp, key=lambda r: (r["importance"], r["feature"]))["feature"]
        ranking[worst] = len(alive) - max_features + 1
        alive.remove(worst)
    for f in alive:
        ranking[f] = 1
    data.unpersist()
    return df.sparkSession.createDataFrame(sorted(ranking.items(), key=lambda kv: (kv[1], kv[0])),
                                           "feature string, ranking int")


def elbow_k(costs: dict[int, float]) -> int:
    """Argmin of the first differences of the cost curve, + the first k."""
    ks = sorted(costs)
    diffs = [costs[ks[i + 1]] - costs[ks[i]] for i in range(len(ks) - 1)]
    return ks[min(range(len(diffs)), key=lambda i: diffs[i])] if diffs else ks[0]


def optimal_k(df: DataFrame, features: list[str], max_k: int = 10, method: str = "silhouette",
              id_col: str | None = None, seed: int = 42) -> DataFrame:
    """k = 2..max_k; silhouette argmax (exact, from cluster_quality) or
    the elbow of KMeans training cost. Returns (k, score) plus best_k."""
    from tessera.operators.cluster import kmeans
    from tessera.operators.cluster_quality import silhouette
    spark = df.sparkSession
    data = df.select(*([qcol(id_col)] if id_col else []), *[qcol(c).cast("double").alias(c) for c in features]).na.drop()
    if id_col is None:
        raise ValueError("optimal_k needs an id column")
    data = data.persist()
    scores = {}
    for k in range(2, max_k + 1):
        labels, model = kmeans(data, features, id_col, k=k, seed=seed, return_model=True)
        if method == "silhouette":
            scores[k] = silhouette(data.join(labels, id_col), features, "Cluster", id_col).first()["silhouette"]
        else:
            scores[k] = model.summary.trainingCost
    data.unpersist()
    best = max(scores, key=lambda k: (scores[k] if scores[k] is not None else -math.inf)) \
        if method == "silhouette" else elbow_k(scores)
    return spark.createDataFrame([(k, float(v) if v is not None else None, k == best) for k, v in sorted(scores.items())],
                                 "k int, score double, best boolean")


# ---------------------------------------------------------------- R3
def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b of two columns, exact. Rows collapse to distinct
    (x, y, count); the tile-pair engine sums count_a * count_b *
    sign(dx) * sign(dy) over tuple pairs (partial sums only, no pair rows);
    tie corrections come from the value counts of x and of y."""
    import numpy as np
    import pandas as pd
    from tessera.functions.pairs import apply_tiles
    base = df.select(_number(x).alias("_x"), _number(y).alias("_y")).na.drop()
    tup = base.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_w")) \
        .withColumn("_id", F.xxhash64("_x", "_y"))

    def block(a, b, same):
        xa, ya, wa = a["_x"].to_numpy(), a["_y"].to_numpy(), a["_w"].to_numpy().astype(float)
        xb, yb, wb = b["_x"].to_numpy(), b["_y"].to_numpy(), b["_w"].to_numpy().astype(float)
        s = np.sign(xa[:, None] - xb[None, :]) * np.sign(ya[:, None] - yb[None, :]) * (wa[:, None] * wb[None, :])
        total = np.triu(s, 1).sum() if same else s.sum()
        return pd.DataFrame({"s": [float(total)]})

    S = apply_tiles(tup, "_id", block, "s double").agg(F.sum("s").alias("S"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    tx = base.groupBy("_x").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n1"))
    ty = base.groupBy("_y").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n2"))
    s_, n_, n1, n2 = S.first()["S"], n.first()["n"], tx.first()["n1"], ty.first()["n2"]
    n0 = n_ * (n_ - 1) / 2
    den = ((n0 - n1) * (n0 - n2)) ** 0.5
    tau = float(s_) / den if den else None
    return df.sparkSession.createDataFrame([(x, y, tau)], "feature string, target string, corr double")
