"""Vector queries over ``embeddings``: cluster quality with the given labels
(Q1-Q5), exact k nearest neighbours (N1) and embedding quality of the
first two dimensions against all 64 (V1-V5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster_quality as Q
from tessera.operators import embedding_quality as V
from tessera.operators import neighbors as NB
from tessera.operators import pivots as PV
from tessera.plans.catalog import register
from tessera.sources.tables import table

E_SQL = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
                 [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS y, label FROM embeddings)"""
PAIRS_SQL = E_SQL + """,
p AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj,
             list_distance(a.x, b.x) AS dx, list_distance(a.y, b.y) AS dy
      FROM e a JOIN e b ON a.id <> b.id)"""


def emb(spark, d):
    """(vec_id, embedding, y2 = first two dims, label)."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", F.slice("embedding", 1, 2).alias("y2"), "label")


SIL_SQL = PAIRS_SQL + """,
s AS (SELECT i, li, lj, avg(dx) AS md FROM p GROUP BY i, li, lj),
per AS (SELECT i, max(CASE WHEN lj = li THEN md END) AS a, min(CASE WHEN lj <> li THEN md END) AS b
        FROM s GROUP BY i)"""


@register("silhouette_embeddings", "Q1,J6,N0", "WITH " + SIL_SQL + """
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM per""")
def silhouette_embeddings(spark, d):
    return Q.silhouette(emb(spark, d), "embedding", "label", "vec_id") \
        .select(F.round("silhouette", 9).alias("silhouette"))


@register("silhouette_squared_embeddings", "Q1", "WITH " + SIL_SQL.replace("avg(dx)", "avg(dx * dx)") + """
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette_squared FROM per""")
def silhouette_squared_embeddings(spark, d):
    return Q.silhouette_squared(emb(spark, d), "embedding", "label") \
        .select(F.round("silhouette_squared", 9).alias("silhouette_squared"))


CH_SQL = E_SQL + """,
dims AS (SELECT label, unnest(x) AS v, unnest(generate_series(1, len(x))) AS d FROM e),
cen AS (SELECT label, d, avg(v) AS mu, count(*) AS n FROM dims GROUP BY label, d),
ov AS (SELECT d, avg(v) AS m FROM dims GROUP BY d),
w AS (SELECT sum((v - mu) * (v - mu)) AS W FROM dims JOIN cen USING (label, d)),
bt AS (SELECT sum(n * (mu - m) * (mu - m)) AS B FROM cen JOIN ov USING (d)),
kk AS (SELECT count(DISTINCT label) AS k, (SELECT count(*) FROM e) AS nn FROM e),
ch AS (SELECT CASE WHEN W = 0 THEN 1.0 ELSE B * (nn - k) / (W * (k - 1)) END AS calinski_harabasz FROM w, bt, kk)"""

DB_SQL = E_SQL + """,
dims2 AS (SELECT label, unnest(x) AS v, unnest(generate_series(1, len(x))) AS d FROM e),
cen2 AS (SELECT label, d, avg(v) AS mu FROM dims2 GROUP BY label, d),
cv AS (SELECT label, list(mu ORDER BY d) AS c FROM cen2 GROUP BY label),
sc AS (SELECT e.label, avg(list_distance(e.x, cv.c)) AS s FROM e JOIN cv USING (label) GROUP BY e.label),
cc AS (SELECT a.label AS la, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r
       FROM cv a JOIN cv b ON a.label <> b.label JOIN sc sa ON sa.label = a.label JOIN sc sb ON sb.label = b.label
       GROUP BY a.label),
db AS (SELECT avg(r) AS davies_bouldin FROM cc)"""


@register("calinski_harabasz_embeddings", "Q2", "WITH " + CH_SQL +
          " SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch")
def calinski_harabasz_embeddings(spark, d):
    return Q.calinski_harabasz(emb(spark, d), "embedding", "label") \
        .select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@register("davies_bouldin_embeddings", "Q3", "WITH " + DB_SQL +
          " SELECT round(davies_bouldin, 9) AS davies_bouldin FROM db")
def davies_bouldin_embeddings(spark, d):
    return Q.davies_bouldin(emb(spark, d), "embedding", "label") \
        .select(F.round("davies_bouldin", 9).alias("davies_bouldin"))


@register("evaluate_all_embeddings", "Q4", "WITH " + SIL_SQL + ", " + CH_SQL.replace(E_SQL + ",", "") + ", "
          + DB_SQL.replace(E_SQL + ",", "") + """
SELECT (SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) FROM per) AS silhouette,
       (SELECT round(calinski_harabasz, 6) FROM ch) AS calinski_harabasz,
       (SELECT round(davies_bouldin, 9) FROM db) AS davies_bouldin""")
def evaluate_all_embeddings(spark, d):
    r = Q.evaluate_all(emb(spark, d), "embedding", "label", "vec_id")
    return r.select(F.round("silhouette", 9).alias("silhouette"),
                    F.round("calinski_harabasz", 6).alias("calinski_harabasz"),
                    F.round("davies_bouldin", 9).alias("davies_bouldin"))


@register("evaluate_multiple_embeddings", "Q5", "WITH " + SIL_SQL.replace(
    "a.label AS li, b.label AS lj", "a.label % 3 AS li, b.label % 3 AS lj") + """
SELECT 'label_mod3' AS method, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette
FROM per""")
def evaluate_multiple_embeddings(spark, d):
    e = emb(spark, d)
    labels = {"label_mod3": e.select("vec_id", (F.col("label") % 3).alias("Cluster"))}
    r = Q.evaluate_multiple(e.select("vec_id", "embedding"), "embedding", labels, "vec_id")
    return r.select("method", F.round("silhouette", 9).alias("silhouette"))


@register("knn_embeddings", "N1,A12", "WITH " + PAIRS_SQL + """
SELECT i AS id, j AS nbr, round(dx, 9) AS dist, r AS rank FROM (
  SELECT i, j, dx, row_number() OVER (PARTITION BY i ORDER BY dx, j) AS r FROM p) WHERE r <= 5""")
def knn_embeddings(spark, d):
    nn = NB.knn(emb(spark, d), "vec_id", "embedding", k=5)
    return nn.select("id", "nbr", F.round("dist", 9).alias("dist"), F.col("rank").cast("long").alias("rank"))


@register("knn_pruned_embeddings", "N1,J7,A12", "WITH " + PAIRS_SQL + """
SELECT i AS id, j AS nbr, round(dx, 9) AS dist, r AS rank FROM (
  SELECT i, j, dx, row_number() OVER (PARTITION BY i ORDER BY dx, j) AS r FROM p) WHERE r <= 10""")
def knn_pruned_embeddings(spark, d):
    nn = PV.knn_pruned(emb(spark, d), "vec_id", "embedding", k=10)
    return nn.select("id", "nbr", F.round("dist", 9).alias("dist"), F.col("rank").cast("long").alias("rank"))


RANKS_SQL = PAIRS_SQL + """,
rx AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dx, j) AS r FROM p),
ry AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dy, j) AS r FROM p),
nn AS (SELECT count(*) AS n FROM e),
tw AS (SELECT 1 - 2.0 / (n * 5 * (2 * n - 15 - 1)) * coalesce((SELECT sum(rx.r - 5) FROM ry JOIN rx USING (i, j)
                                                      WHERE ry.r <= 5 AND rx.r > 5), 0) AS trustworthiness FROM nn),
ct AS (SELECT 1 - 2.0 / (n * 5 * (2 * n - 15 - 1)) * coalesce((SELECT sum(ry.r - 5) FROM rx JOIN ry USING (i, j)
                                                      WHERE rx.r <= 5 AND ry.r > 5), 0) AS continuity FROM nn),
st AS (SELECT sqrt(sum((dy - dx) * (dy - dx)) / sum(dx * dx)) AS stress, corr(dx, dy) AS distance_correlation
       FROM p WHERE i < j)"""


@register("trustworthiness_embeddings", "V1,A9,A12", "WITH " + RANKS_SQL +
          " SELECT round(trustworthiness, 9) AS trustworthiness FROM tw")
def trustworthiness_embeddings(spark, d):
    return V.trustworthiness(emb(spark, d), "vec_id", "embedding", "y2", 5) \
        .select(F.round("trustworthiness", 9).alias("trustworthiness"))


@register("continuity_embeddings", "V2,A9", "WITH " + RANKS_SQL +
          " SELECT round(continuity, 9) AS continuity FROM ct")
def continuity_embeddings(spark, d):
    return V.continuity(emb(spark, d), "vec_id", "embedding", "y2", 5) \
        .select(F.round("continuity", 9).alias("continuity"))


@register("stress_embeddings", "V3", "WITH " + RANKS_SQL + " SELECT round(stress, 9) AS stress FROM st")
def stress_embeddings(spark, d):
    return V.stress(emb(spark, d), "vec_id", "embedding", "y2").select(F.round("stress", 9).alias("stress"))


@register("distance_correlation_embeddings", "V4", "WITH " + RANKS_SQL +
          " SELECT round(distance_correlation, 9) AS distance_correlation FROM st")
def distance_correlation_embeddings(spark, d):
    return V.distance_correlation(emb(spark, d), "vec_id", "embedding", "y2") \
        .select(F.round("distance_correlation", 9).alias("distance_correlation"))


@register("evaluate_embedding_first_dims", "V5", "WITH " + RANKS_SQL + """
SELECT round(trustworthiness, 9) AS trustworthiness, round(continuity, 9) AS continuity,
       round(stress, 9) AS stress, round(distance_correlation, 9) AS distance_correlation FROM tw, ct, st""")
def evaluate_embedding_first_dims(spark, d):
    r = V.evaluate_embedding(emb(spark, d), "vec_id", "embedding", "y2", 5)
    return r.select(*[F.round(c, 9).alias(c) for c in
                      ["trustworthiness", "continuity", "stress", "distance_correlation"]])
