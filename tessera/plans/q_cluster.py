"""Clustering queries (K1-K13). Labels of most methods depend on library
initialisation, so these are rows-only in the oracle gate; DBSCAN has SQL and is
also checked against a sequential version in tests/test_properties.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import linkage as L
from tessera.operators import reduce as D
from tessera.operators.dbscan_grid import Grid
from tessera.plans.catalog import register
from tessera.plans.q_select import blobs2d
from tessera.plans.q_vectors import emb
from tessera.sources.tables import table


def emb2d(spark, d):
    """Embeddings' first two dimensions as x, y (whole table)."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"), "label")


@register("kmeans_embeddings", "K1,J1")
def kmeans_embeddings(spark, d):
    return K.kmeans(emb(spark, d), "embedding", "vec_id", k=10, seed=42)


@register("gmm_blobs", "K4")
def gmm_blobs(spark, d):
    return K.gmm(blobs2d(spark, d), ["x", "y"], "event_id", k=3, seed=42)


@register("dbscan_blobs", "K3,J7,N5")
def dbscan_blobs(spark, d):
    return K.dbscan(blobs2d(spark, d), ["x", "y"], "event_id", eps=0.02, min_samples=10)


#: Clusters of the pairs p(a, b) within the radius of e(vec_id), four neighbours and the row itself making a core.
DBSCAN_SQL = """,
core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 5),
g AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r(id, root) AS (SELECT id, id FROM core UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM c)),
l AS (SELECT id, k FROM c JOIN n USING (root)
      UNION ALL SELECT p.a, min(k) FROM p JOIN c ON c.id = p.b JOIN n USING (root) WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a)
SELECT vec_id, CAST(coalesce(k, -1) AS INTEGER) AS Cluster FROM e LEFT JOIN l ON l.id = e.vec_id"""


@register("dbscan_embeddings_2d", "K3,J7,N5", """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01)""" + DBSCAN_SQL)
def dbscan_embeddings_2d(spark, d):
    return K.dbscan(emb2d(spark, d), ["x", "y"], "vec_id", eps=0.01, min_samples=5)


@register("dbscan_embeddings", "K3,J7,N5", """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON list_distance(a.x, b.x) <= 1.18)""" + DBSCAN_SQL)
def dbscan_embeddings(spark, d):
    return K.dbscan(emb(spark, d), "embedding", "vec_id", eps=1.18, min_samples=5)


@register("agglomerative_embeddings", "K2")
def agglomerative_embeddings(spark, d):
    return K.agglomerative(emb(spark, d), "embedding", "vec_id", k=10, linkage="ward")


#: Prim's algorithm: at each step the nearest point that is not in the tree (whose entry isn't infinite) joins it.
SPANNING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
m AS (SELECT a.i, list(list_distance(a.x, b.x) ORDER BY b.i) AS ds FROM e a, e b GROUP BY a.i),
p AS (
  SELECT 1 AS step, CAST(1 AS BIGINT) AS v, CAST(NULL AS BIGINT) AS f, CAST(NULL AS DOUBLE) AS d,
         list_transform(ds, lambda x, j: CASE WHEN j = 1 THEN CAST('infinity' AS DOUBLE) ELSE x END) AS best,
         list_transform(ds, lambda x, j: CAST(1 AS BIGINT)) AS via FROM m WHERE i = 1
  UNION ALL
  SELECT step + 1, n, via[n], best[n],
         list_transform(best, lambda x, j: CASE WHEN j = n OR isinf(x) THEN CAST('infinity' AS DOUBLE) ELSE least(x, ds[j]) END),
         list_transform(via, lambda x, j: CASE WHEN NOT isinf(best[j]) AND ds[j] < best[j] THEN n ELSE x END)
  FROM (SELECT *, CAST(list_position(best, list_min(best)) AS BIGINT) AS n FROM p) q JOIN m ON m.i = q.n WHERE NOT isinf(list_min(best))),
t AS (SELECT step, v, f, d, row_number() OVER (ORDER BY d DESC) AS longest FROM p WHERE f IS NOT NULL)"""


@register("spanning_tree_embeddings", "K2,N0", SPANNING_SQL + """
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, round(d, 9) AS dist FROM t JOIN e a ON a.i = t.v JOIN e b ON b.i = t.f""")
def spanning_tree_embeddings(spark, d):
    return L.spanning_edges(emb(spark, d), "embedding", "vec_id").select("a", "b", F.round("dist", 9).alias("dist"))


@register("merge_tree_embeddings", "K2,K10")
def merge_tree_embeddings(spark, d):
    """The dendrograms of both tuned linkages, from one k-means."""
    trees = L.merge_trees(emb(spark, d), "embedding", "vec_id", ["ward", "complete"])
    ward, complete = (trees[x].table().withColumn("linkage", F.lit(x)) for x in ("ward", "complete"))
    return ward.unionByName(complete)


@register("agglomerative_single_embeddings", "K2", SPANNING_SQL + """,
g AS (SELECT v AS a, f AS b FROM t WHERE longest > 4 UNION ALL SELECT f, v FROM t WHERE longest > 4),
r(id, root) AS (SELECT i, i FROM e UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT e.id AS vec_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS Cluster FROM c JOIN e ON e.i = c.id""")
def agglomerative_single_embeddings(spark, d):
    return K.agglomerative(emb(spark, d), "embedding", "vec_id", k=5, linkage="single")


@register("spectral_embeddings", "K5")
def spectral_embeddings(spark, d):
    return K.spectral(emb(spark, d), "embedding", "vec_id", k=10, n_neighbors=10)


@register("kprototypes_customer", "K6")
def kprototypes_customer(spark, d):
    c = table(spark, d, "customer")
    return K.kprototypes(c, ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "c_custkey", k=3)


@register("tune_kmeans_embeddings", "K8,K12,R14")
def tune_kmeans_embeddings(spark, d):
    p = K.best_params("KMEANS_CPU", emb(spark, d), "embedding", "vec_id", k_range=range(2, 7))
    return spark.createDataFrame([(p["n_clusters"], p["score"])], "n_clusters int, silhouette double")


def _dbscan_cells_sql(radii, counts):
    """How many core points each cell of the grid has, and how many rows are noise."""
    cells = " UNION ALL ".join(f"SELECT {e} AS eps, {m} AS m" for e in radii for m in counts)
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
cells AS ({cells}),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e a, e b),
n AS (SELECT eps, a, count(*) AS n FROM d, (SELECT DISTINCT eps FROM cells) WHERE d <= eps GROUP BY eps, a),
near AS (SELECT d.a, n.eps, max(n.n) AS most FROM d JOIN n ON n.a = d.b AND d.d <= n.eps GROUP BY d.a, n.eps)
SELECT CAST(c.eps AS DOUBLE) AS eps, CAST(c.m AS INTEGER) AS min_samples, count(*) FILTER (n.n >= c.m) AS n_core,
       count(*) FILTER (near.most < c.m) AS n_noise
FROM cells c JOIN n ON n.eps = c.eps JOIN near ON near.eps = c.eps AND near.a = n.a GROUP BY c.eps, c.m"""


GRID_RADII, GRID_COUNTS = [0.005, 0.01, 0.02, 0.04], [2, 3, 5, 10, 20]


@register("dbscan_grid_embeddings_2d", "K9,J7,N5", _dbscan_cells_sql(GRID_RADII, GRID_COUNTS))
def dbscan_grid_embeddings_2d(spark, d):
    """Core points and noise of every cell, from the clusterings of the shared grid."""
    e = emb2d(spark, d)
    grid, n = Grid(e, ["x", "y"], "vec_id", GRID_RADII, GRID_COUNTS), e.count()
    out = spark.createDataFrame([(eps, m, grid.cores[i, m], n) for i, eps in enumerate(GRID_RADII) for m in GRID_COUNTS],
                                "eps double, min_samples int, n_core long, n long")
    noise = None
    for eps in GRID_RADII:
        sets = grid.core_sets(eps)
        same = spark.createDataFrame([(eps, m, s) for m, s in sets.items()], "eps double, min_samples int, m int")
        part = grid.labels(eps, list(set(sets.values()))).groupBy("m").agg(F.count_if(F.col("Cluster") == -1).alias("n_noise")) \
            .join(F.broadcast(same), "m").drop("m")
        noise = part if noise is None else noise.unionByName(part)
    return out.join(noise, ["eps", "min_samples"], "left") \
        .select("eps", "min_samples", "n_core", F.coalesce("n_noise", "n").alias("n_noise"))


@register("tune_dbscan_embeddings_2d", "K9,K12")
def tune_dbscan_embeddings_2d(spark, d):
    """The whole grid of 49 radii and 22 counts."""
    p = K.best_params("DBSCAN", emb2d(spark, d), ["x", "y"], "vec_id")
    return spark.createDataFrame([(float(p["eps"]), int(p["min_samples"]), p["score"])],
                                 "eps double, min_samples int, silhouette double")


@register("tune_agglomerative_embeddings", "K10,K12")
def tune_agglomerative_embeddings(spark, d):
    p = K.best_params("AGGLOMERATIVE", emb(spark, d), "embedding", "vec_id")
    return spark.createDataFrame([(p["n_clusters"], p["linkage"], p["score"])],
                                 "n_clusters int, linkage string, silhouette double")


@register("tune_gmm_blobs", "K11,K12")
def tune_gmm_blobs(spark, d):
    p = K.best_params("GMM", emb2d(spark, d), ["x", "y"], "vec_id", k_range=range(2, 5))
    return spark.createDataFrame([(p["n_components"], p["score"])], "n_components int, silhouette double")


@register("cluster_selection_embeddings", "K13,P2,P6,J1,J5")
def cluster_selection_embeddings(spark, d):
    e = emb(spark, d)
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(8)])
    layout = D.pca(wide, [f"f{i:02d}" for i in range(8)], "vec_id", 2)
    ids = wide.where(F.col("f00") > 0).select("vec_id")
    return K.cluster_selection(wide, [f"f{i:02d}" for i in range(8)], "vec_id", "KMEANS", ids=ids,
                               params={"n_clusters": 4}, embedding=layout)


@register("optimal_k_elbow_embeddings", "R14,A13")
def optimal_k_elbow_embeddings(spark, d):
    from tessera.operators.relevance import optimal_k
    e = emb2d(spark, d)
    return optimal_k(e, ["x", "y"], max_k=6, method="elbow", id_col="vec_id")


@register("cluster_features_embeddings", "R15,D1,A14")
def cluster_features_embeddings(spark, d):
    """KMeans labels + 2-D PCA + the top-loading feature of each axis."""
    e = emb(spark, d)
    cols = [f"f{i:02d}" for i in range(8)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    labels = K.kmeans(wide, cols, "vec_id", k=4)
    W, _, _ = D.pca_fit(wide, cols, "vec_id", 2)
    top = [cols[int(abs(W[:, j]).argmax())] for j in range(2)]
    return D.pca(wide, cols, "vec_id", 2).join(labels, "vec_id") \
        .withColumn("pc1_top_feature", F.lit(top[0])).withColumn("pc2_top_feature", F.lit(top[1]))
