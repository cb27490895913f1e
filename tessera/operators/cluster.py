"""Clustering (K1-K13): k-means, Gaussian mixture, DBSCAN, agglomerative,
spectral, k-prototypes, automatic tuning and the selection wrapper.

Every method returns (id, Cluster). k-means and GMM are Spark ML
estimators. DBSCAN is exact and order-free (two tile-pair passes, see
:func:`dbscan`). Agglomerative clustering cuts merge trees
(:mod:`tessera.operators.linkage`)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import apply_cells
from tessera.functions.frame import qcol
from tessera.functions.pairs import DEFAULT_TILE_ROWS, apply_grid, stack, vector_col, within
from tessera.functions.ranking import group_row_number
from tessera.operators.dbscan_cells import labels_by_cells
from tessera.operators.dbscan_grid import Grid
from tessera.operators.linkage import MergeTree, cut_scores, merge_trees, merges_of, single_linkage
from tessera.operators.neighbors import connected_components, knn
from tessera.session import cut_lineage

NOISE = -1


def _assembled(df: DataFrame, features, id_col: str) -> DataFrame:
    if isinstance(features, str):
        from pyspark.ml.functions import array_to_vector
        return df.select(qcol(id_col), array_to_vector(vector_col(df, features)).alias("_f"))
    clean = df.select(qcol(id_col), *[qcol(c).cast("double").alias(c) for c in features])
    return VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(clean) \
        .select(qcol(id_col), "_f")


# ---------------------------------------------------------------- K1 / K4
def kmeans(df: DataFrame, features, id_col: str, k: int = 3, seed: int = 42,
           return_model: bool = False, max_iter: int = 20):
    """K1: k-means|| initialisation, Lloyd iterations on Spark ML."""
    data = _assembled(df, features, id_col)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="Cluster", maxIter=max_iter,
                   initMode="k-means||").fit(data)
    labels = model.transform(data).select(qcol(id_col), F.col("Cluster").cast("int"))
    return (labels, model) if return_model else labels


def gmm(df: DataFrame, features, id_col: str, k: int = 3, seed: int = 42, return_model: bool = False):
    """K4: Gaussian mixture with full covariances (EM on Spark ML)."""
    data = _assembled(df, features, id_col)
    model = GaussianMixture(k=k, seed=seed, featuresCol="_f", predictionCol="Cluster").fit(data)
    labels = model.transform(data).select(qcol(id_col), F.col("Cluster").cast("int"))
    return (labels, model) if return_model else labels


# ---------------------------------------------------------------- K3
def _linked_components(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and the columns of a boolean block (one set if ``same``);
    -1 without a link (O(m^2) like the distance block itself)."""
    left = np.full(near.shape[0], -1)
    right = left if same else np.full(near.shape[1], -1)
    for s in np.flatnonzero(near.any(axis=1)):
        if left[s] >= 0:
            continue
        left[s] = s
        rows = np.array([s])
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & (right < 0))
            right[cols] = s
            if same:
                rows = cols
                continue
            rows = np.flatnonzero(near[:, cols].any(axis=1) & (left < 0)) if len(cols) else cols
            left[rows] = s
    return left, right


def _labels_by_blocks(pts: DataFrame, blocks, eps: float, min_samples: int) -> DataFrame:
    """(id, component) of every core and border point from two passes over ``blocks(frame, fn, schema)``."""
    def count_block(a, b, same):
        near = within(stack(a["_vec"]), stack(b["_vec"]), eps)
        ca = np.count_nonzero(near, axis=1)
        out = [pd.DataFrame({"_id": a["_id"].to_numpy(), "_n": ca.astype("int64")})]
        if not same:
            out.append(pd.DataFrame({"_id": b["_id"].to_numpy(), "_n": np.count_nonzero(near, axis=0).astype("int64")}))
        return pd.concat(out, ignore_index=True)

    counts = blocks(pts, count_block, "_id long, _n long") \
        .groupBy("_id").agg(F.sum("_n").alias("_n"))
    flagged = cut_lineage(pts.join(counts, "_id").withColumn("_core", F.col("_n") >= F.lit(min_samples))
                          .drop("_n"))

    def forest_block(a, b, same):
        near = within(stack(a["_vec"]), stack(b["_vec"]), eps)
        (ia, ca), (ib, cb) = ((f["_id"].to_numpy(), f["_core"].to_numpy().astype(bool)) for f in (a, b))
        la, lb = _linked_components(near[np.ix_(ca, cb)], same)
        ids, comp = (ia[ca], la) if same else (np.concatenate([ia[ca], ib[cb]]), np.concatenate([la, lb]))
        linked = comp >= 0
        root = np.full(comp.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, comp[linked], ids[linked])
        src, dst = [ids[linked]], [root[comp[linked]]]
        core_links = len(src[0])
        # border attachments: a non-core point touching core points; one without a link is a root
        for i, mine, theirs, lab, m in ((ia, ca, cb, lb, near),) if same else ((ia, ca, cb, lb, near), (ib, cb, ca, la, near.T)):
            r, c = np.nonzero(m[np.ix_(~mine, theirs)])
            others = (ib if theirs is cb else ia)[theirs][c]
            lab = lab[c]
            to = np.where(lab >= 0, root[lab] if len(root) else others, others)
            pairs = np.unique(np.stack([i[~mine][r], to]), axis=1)
            src.append(pairs[0])
            dst.append(pairs[1])
        src, dst = np.concatenate(src), np.concatenate(dst)
        return pd.DataFrame({"src": src, "dst": dst, "kind": (np.arange(len(src)) >= core_links).astype("int32")})

    links = cut_lineage(blocks(flagged, forest_block, "src long, dst long, kind int"))
    core_ids = flagged.where("_core").select(F.col("_id").alias("id"))
    comps = connected_components(links.where("kind = 0").select("src", "dst"), core_ids)
    border = links.where("kind = 1").join(comps.withColumnRenamed("id", "dst"), "dst") \
        .groupBy(F.col("src").alias("id")).agg(F.min("component").alias("component"))
    return comps.unionByName(border.join(core_ids, "id", "left_anti"))


def dbscan(df: DataFrame, features, id_col: str, eps: float = 0.5, min_samples: int = 5,
           tile_rows: int = DEFAULT_TILE_ROWS, grid: bool | None = None) -> DataFrame:
    """K3: exact DBSCAN, independent of row order.

    With 1-3 scalar feature columns (the default when given) the points lie in cells narrower than the
    radius (:mod:`tessera.operators.dbscan_cells`). Otherwise:

    Pass 1 (tiles): neighbours within eps, self included -> core points.
    Pass 2 (tiles): inside each block, connected components of the core
    points within eps; each block emits a star forest (core point -> its
    block component's smallest id) and, for non-core points, the component
    roots they touch. No pair rows are emitted. The blocks come
    from cells around pivots, of which only those
    within reach are compared (:func:`tessera.functions.cells.apply_cells`), or, where the narrow
    cells would be too many to be numbered, from an eps grid (only neighbouring cells are compared,
    dense cells are split into bounded sub-tiles).

    Global components of the forests (min-label propagation) are the clusters, numbered 0.. by their
    smallest core id; a border point joins the smallest adjacent cluster;
    the rest is noise (-1)."""
    use_grid = grid if grid is not None else (not isinstance(features, str) and len(features) <= 3)
    if use_grid:
        pts = df.select(qcol(id_col).cast("long").alias("_id"), vector_col(df, features),
                        *[qcol(c).cast("double").alias(f"_g{i}") for i, c in enumerate(features)])
        gcols = [f"_g{i}" for i in range(len(features))]

        def blocks(frame, fn, schema):
            return apply_grid(frame, "_id", gcols, float(eps), fn, schema, tile_rows)
    else:
        pts = df.select(qcol(id_col).cast("long").alias("_id"), vector_col(df, features))

        def blocks(frame, fn, schema):
            return apply_cells(frame, "_id", float(eps), fn, schema, tile_rows)
    labels = labels_by_cells(pts, gcols, float(eps), min_samples, tile_rows) if use_grid else None
    if labels is None:
        labels = _labels_by_blocks(pts, blocks, float(eps), min_samples)
    order = group_row_number(labels.select("component").distinct().withColumn("_g", F.lit(0)),
                             ["_g"], "component", "_num")
    numbered = labels.join(order.select("component", (F.col("_num") - 1).cast("int").alias("Cluster")), "component")
    return pts.select(F.col("_id").alias(id_col)).join(
        numbered.select(F.col("id").alias(id_col), "Cluster"), id_col, "left") \
        .select(qcol(id_col), F.coalesce(F.col("Cluster"), F.lit(NOISE)).cast("int").alias("Cluster"))


# ---------------------------------------------------------------- K2
def _lance_williams(C: np.ndarray, w: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Groups of weighted centroids merged down to ``k``."""
    return np.array(MergeTree(None, "", len(C), merges_of(C, w, linkage)).groups(k))


def agglomerative(df: DataFrame, features, id_col: str, k: int = 3, linkage: str = "ward",
                  micro: int = 200, seed: int = 42) -> DataFrame:
    """K2: single linkage is exact (:func:`tessera.operators.linkage.single_linkage`);
    the others cut the merge tree of k-means micro-clusters."""
    if linkage == "single":
        return single_linkage(df, features, id_col, k)
    return merge_trees(df, features, id_col, [linkage], micro, k, seed)[linkage].cut(k)


# ---------------------------------------------------------------- K5
def spectral(df: DataFrame, features, id_col: str, k: int = 3, n_neighbors: int = 10,
             seed: int = 42, max_iter: int = 30) -> DataFrame:
    """K5: power iteration clustering on the symmetric kNN graph with RBF
    affinities (distributed; no dense n x n matrix)."""
    nn = knn(df, id_col, features, n_neighbors)
    scale = nn.agg(F.avg("dist")).first()[0] or 1.0
    edges = nn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst"),
                      F.exp(-(F.col("dist") / F.lit(scale)) ** 2).alias("weight")) \
        .groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", weightCol="weight")
    assigned = pic.assignClusters(edges)
    return df.select(qcol(id_col).cast("long").alias(id_col)).join(
        assigned.select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("Cluster")), id_col, "left") \
        .select(qcol(id_col), F.coalesce("Cluster", F.lit(NOISE)).cast("int").alias("Cluster"))


# ---------------------------------------------------------------- K6
def kprototypes(df: DataFrame, numeric: list[str], categorical: list[str], id_col: str, k: int = 3,
                gamma: float | None = None, max_iter: int = 20, seed: int = 42) -> DataFrame:
    """K6: Lloyd loop on mixed data: squared Euclidean distance on numeric
    columns + gamma x number of categorical mismatches against broadcast
    prototypes (k rows); update by mean and mode. Lineage is checkpointed
    each round."""
    spark = df.sparkSession
    base = df.select(qcol(id_col), *[qcol(c).cast("double").alias(c) for c in numeric],
                     *[qcol(c).cast("string").alias(c) for c in categorical]).na.drop()
    if gamma is None:
        sd = base.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first() if numeric else None
        gamma = 0.5 * float(np.mean([sd[c] or 0.0 for c in numeric])) if numeric else 1.0
    init = base.withColumn("_h", F.xxhash64(qcol(id_col), F.lit(seed))).orderBy("_h").limit(k).drop("_h").collect()
    protos = [(i, [r[c] for c in numeric], [r[c] for c in categorical]) for i, r in enumerate(init)]
    assigned = None
    for _ in range(max_iter):
        cost_terms = []
        for pid, nums, cats in protos:
            d = F.lit(0.0)
            for c, v in zip(numeric, nums):
                d = d + (F.col(c) - F.lit(float(v))) ** 2
            for c, v in zip(categorical, cats):
                d = d + F.lit(float(gamma)) * (F.col(c) != F.lit(v)).cast("double")
            cost_terms.append(F.struct(d.alias("d"), F.lit(pid).alias("p")))
        new = cut_lineage(base.withColumn("Cluster", F.least(*cost_terms)["p"]))
        agg = new.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in numeric]).collect()
        modes = {}
        for c in categorical:
            top = new.groupBy("Cluster", c).agg(F.count(F.lit(1)).alias("n")) \
                .groupBy("Cluster").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col(c).alias("v"))).alias("t")) \
                .collect()
            modes[c] = {r["Cluster"]: r["t"]["v"] for r in top}
        means = {r["Cluster"]: r for r in agg}
        updated = [(pid, [means[pid][c] for c in numeric] if pid in means else nums,
                    [modes[c].get(pid, v) for c, v in zip(categorical, cats)] if pid in means else cats)
                   for pid, nums, cats in protos]
        converged = assigned is not None and new.join(assigned.withColumnRenamed("Cluster", "_old"), id_col) \
            .where(F.col("Cluster") != F.col("_old")).limit(1).count() == 0
        assigned = new.select(qcol(id_col), "Cluster")
        protos = updated
        if converged:
            break
    return assigned.select(qcol(id_col), F.col("Cluster").cast("int"))


# ---------------------------------------------------------------- K8-K13
def _progress(candidates, scores):
    """The best candidate scored so far, its score, and how many scored ones came after it."""
    best, best_score, misses = None, -np.inf, 0
    for c in candidates:
        if scores.get(c) is None:
            continue
        if scores[c] > best_score + 1e-12:
            best, best_score, misses = c, scores[c], 0
        else:
            misses += 1
    return best, best_score, misses


def _tune_loop(candidates, run, score, patience):
    best, best_score, misses = None, -np.inf, 0
    for params in candidates:
        labels = run(params)
        s = score(labels)
        if s is None:
            continue
        if s > best_score + 1e-12:             # equal labels score alike but for the order of sums
            best, best_score, misses = params, s, 0
        else:
            misses += 1
        if misses >= patience:
            break
    return best, best_score


def _score_fn(df, features, id_col):
    from tessera.operators.cluster_quality import silhouette
    base = df.select(qcol(id_col), *([qcol(features)] if isinstance(features, str) else [qcol(c) for c in features]))

    def score(labels):
        lab = labels.persist()
        if lab.select("Cluster").distinct().count() < 2:
            lab.unpersist()
            return None
        s = silhouette(base.join(lab, id_col), features, "Cluster", id_col).first()[0]
        lab.unpersist()
        return s
    return score


def tune_kmeans(df, features, id_col, k_range=None, patience: int = 3, seed: int = 42) -> dict:
    """K8: k = 2..min(50, n), best silhouette, stop after ``patience``
    candidates without improvement; fallback k = 3."""
    n = df.count()
    k_range = k_range or range(2, min(50, n) + 1)
    best, s = _tune_loop(list(k_range), lambda k: kmeans(df, features, id_col, k=k, seed=seed),
                         _score_fn(df, features, id_col), patience)
    return {"n_clusters": best or 3, "random_state": seed, "score": s if best else None}


def tune_dbscan(df, features, id_col, eps_values=None, min_samples_values=None, patience: int | None = None) -> dict:
    """K9: eps 0.1..4.9 x 22 min_samples values, all-noise skipped, noise
    scored as its own cluster; fallback eps 0.5, min_samples 5. The whole grid is searched, or with
    ``patience`` until so many scored cells bring nothing better. The cells share
    their work (:mod:`tessera.operators.dbscan_grid`); once all points are one cluster they stay so with a larger
    radius and a smaller count."""
    eps_values = eps_values if eps_values is not None else [round(0.1 * i, 1) for i in range(1, 50)]
    # The min_samples grid of the reference's tuner.
    ms = min_samples_values or [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 17, 18, 19, 20, 25, 30, 40, 50, 75, 100]
    shared = Grid(df, features, id_col, eps_values, ms)
    scores: dict[float, dict] = {}
    single: list[tuple[float, int]] = []                 # cells without another label than one cluster's

    def one_cluster(eps, m):
        return any(e <= eps and m <= most for e, most in single)

    def score(cell):
        eps, m = float(cell[0]), int(cell[1])
        sets = shared.core_sets(eps)
        if m not in sets or one_cluster(eps, m):
            return None                                  # all noise, or one cluster without noise
        if eps not in scores:
            scores[eps] = shared.scores(eps, list({first for x, first in sets.items() if not one_cluster(eps, x)}))
            single.extend((eps, x) for x, first in sets.items() if scores[eps].get(first, 0.0) is None)
        return scores[eps][sets[m]]

    best, s = _tune_loop([(e, m) for e in eps_values for m in ms], lambda cell: cell, score, math.inf if patience is None else patience)
    return {"eps": best[0], "min_samples": best[1], "score": s} if best else \
        {"eps": 0.5, "min_samples": 5, "score": None}


def tune_agglomerative(df, features, id_col, k_range=None, linkages=("ward", "complete"),
                       patience: int = 3, micro: int = 200) -> dict:
    """Per linkage (patience reset per linkage), best silhouette. One
    merge tree per linkage gives every candidate, one pass over the pairs all scores."""
    k_range = list(k_range or range(2, min(50, df.count()) + 1))
    trees = merge_trees(df, features, id_col, linkages, micro, max(k_range, default=2))
    scores = cut_scores(df, features, trees, k_range)
    overall, overall_s = None, -np.inf
    for link in linkages:
        best, s = _tune_loop(k_range, lambda k: (link, k), scores.get, patience)
        if best is not None and s > overall_s:
            overall, overall_s = {"n_clusters": best, "linkage": link}, s
    return {**(overall or {"n_clusters": 3, "linkage": linkages[0]}), "score": overall_s if overall else None}


def tune_gmm(df, features, id_col, k_range=None, patience: int = 3, seed: int = 42) -> dict:
    """GMM components by silhouette with patience."""
    from tessera.operators.cluster_quality import silhouettes
    n = df.count()
    k_range = list(k_range or range(2, min(50, n) + 1))
    data = cut_lineage(_assembled(df, features, id_col))
    base = df.select(qcol(id_col), *([qcol(features)] if isinstance(features, str) else [qcol(c) for c in features]))
    scores: dict[int, float | None] = {}

    def score(k):
        if k not in scores:
            _, _, misses = _progress(k_range, scores)
            # none of these can be the one that ends the search before the last of them is scored
            ks = [x for x in k_range if x not in scores][:max(1, patience - misses)]
            labelled = data
            for x in ks:
                labelled = GaussianMixture(k=x, seed=seed, featuresCol="_f", predictionCol=f"_k{x}", probabilityCol=f"_p{x}").fit(data).transform(labelled)
            rows = cut_lineage(base.join(labelled.select(qcol(id_col), *[f"_k{x}" for x in ks]), id_col))
            scores.update(zip(ks, silhouettes(rows, features, [f"_k{x}" for x in ks], id_col)))
        return scores[k]

    best, s = _tune_loop(k_range, lambda k: k, score, patience)
    return {"n_components": best or 3, "random_state": seed, "score": s if best else None}


METHODS = {"KMEANS": "kmeans", "AGGLOMERATIVE": "agglomerative", "DBSCAN": "dbscan", "GMM": "gmm",
           "SPECTRAL": "spectral", "KPROTOTYPES": "kprototypes"}


def best_params(method: str, df, features, id_col, **kw) -> dict:
    """Dispatcher; unknown method -> ValueError."""
    m = method.upper().replace("_CPU", "")
    if m == "KMEANS":
        return tune_kmeans(df, features, id_col, **kw)
    if m == "AGGLOMERATIVE":
        return tune_agglomerative(df, features, id_col, **kw)
    if m == "GMM":
        return tune_gmm(df, features, id_col, **kw)
    if m == "DBSCAN":
        return tune_dbscan(df, features, id_col, **kw)
    raise ValueError(f"no clustering method is called {method!r}")


def run_clustering(method: str, df, features, id_col, params: dict | None = None) -> DataFrame:
    """K7: dispatch by name; an unknown method raises (the reference
    returns -1 labels)."""
    params = dict(params or {})
    m = method.upper().replace("_CPU", "")
    if m == "KMEANS":
        return kmeans(df, features, id_col, k=params.get("n_clusters", 3), seed=params.get("random_state", 42))
    if m == "AGGLOMERATIVE":
        return agglomerative(df, features, id_col, k=params.get("n_clusters", 3),
                             linkage=params.get("linkage", "ward"))
    if m == "DBSCAN":
        return dbscan(df, features, id_col, eps=params.get("eps", 0.5), min_samples=params.get("min_samples", 5))
    if m == "GMM":
        return gmm(df, features, id_col, k=params.get("n_components", 3), seed=params.get("random_state", 42))
    if m == "SPECTRAL":
        return spectral(df, features, id_col, k=params.get("n_clusters", 3))
    raise ValueError(f"no clustering method is called {method!r}")


def cluster_selection(df: DataFrame, features: list[str], id_col: str, method: str,
                      ids: DataFrame | None = None, params: dict | None = None,
                      embedding: DataFrame | None = None) -> DataFrame:
    """Project the features (P2), keep a brushed id selection (P6),
    cluster (manual params or tuned), attach ``Cluster`` to the embedding
    by id (J1)."""
    from tessera.operators.select import filter_ids
    data = filter_ids(df.select(qcol(id_col), *[qcol(c) for c in sorted(features)]), ids, id_col)
    params = params if params is not None else best_params(method, data, sorted(features), id_col)
    labels = run_clustering(method, data, sorted(features), id_col, params)
    target = embedding if embedding is not None else data
    return target.join(labels, id_col, "inner")
