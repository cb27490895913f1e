"""Explanation queries (X1-X9) on embeddings with their given labels as
clusters, and dimensionality-reduction queries (D1-D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embedding_quality as V
from tessera.operators import explain as X
from tessera.operators import reduce as D
from tessera.plans.catalog import register
from tessera.sources.tables import table

FEATS = ["f1", "f2", "f3", "f4"]


def labelled(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATS)],
                    F.col("label").alias("Cluster"))


L_SQL = ("l AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATS))
         + ", label AS Cluster FROM embeddings)")


def _profile_sql() -> str:
    parts = []
    for i, f in enumerate(FEATS):
        parts.append(f"""SELECT Cluster, count(*) AS cluster_size, '{f}' AS feature, {i} AS fpos,
       round(avg({f}), 9) AS cluster_mean, round((SELECT avg({f}) FROM l), 9) AS overall_mean,
       round(avg({f}) - (SELECT avg({f}) FROM l), 9) AS diff,
       CASE WHEN abs(avg({f}) - (SELECT avg({f}) FROM l)) < 1e-6 THEN 'about the same as'
            WHEN avg({f}) - (SELECT avg({f}) FROM l) > 0 THEN 'higher than' ELSE 'lower than' END AS comparison
FROM l GROUP BY Cluster""")
    return "WITH " + L_SQL + " " + " UNION ALL ".join(parts)


@register("cluster_profile_embeddings", "X6,A1", _profile_sql())
def cluster_profile_embeddings(spark, d):
    p = X.cluster_profile(labelled(spark, d), FEATS)
    return p.select("Cluster", "cluster_size", "feature", "fpos", F.round("cluster_mean", 9).alias("cluster_mean"),
                    F.round("overall_mean", 9).alias("overall_mean"), F.round("diff", 9).alias("diff"), "comparison")


@register("cluster_box_stats_embeddings", "X7,O5", "WITH " + L_SQL + """,
q AS (SELECT Cluster, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS median,
             quantile_cont(f1, 0.75) AS q3, count(f1) AS n FROM l GROUP BY Cluster)
SELECT q.Cluster, min(f1) AS min, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, max(f1) AS max,
       min(CASE WHEN f1 >= q1 - 1.5 * (q3 - q1) THEN f1 END) AS lower_whisker,
       max(CASE WHEN f1 <= q3 + 1.5 * (q3 - q1) THEN f1 END) AS upper_whisker, n
FROM l JOIN q ON l.Cluster = q.Cluster GROUP BY q.Cluster, q1, median, q3, n""")
def cluster_box_stats_embeddings(spark, d):
    b = X.cluster_box_stats(labelled(spark, d), "f1")
    return b.select("Cluster", "min", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "max",
                    "lower_whisker", "upper_whisker", "n")


@register("list_clusters_embeddings", "X8,A4", "SELECT DISTINCT label AS Cluster FROM embeddings")
def list_clusters_embeddings(spark, d):
    return X.list_clusters(labelled(spark, d))


@register("color_size_points_embeddings", "X9,F3,J5", "WITH " + L_SQL + """,
m AS (SELECT min(f3) AS mn, max(f3) AS mx FROM l)
SELECT vec_id, round(f1, 9) AS x, round(f2, 9) AS y, Cluster AS color,
       round(1.0::DOUBLE + 6.0::DOUBLE * (ln(1 + ((f3 - mn) + 1e-9::DOUBLE)) - ln(1 + 1e-9::DOUBLE))
             / nullif(ln(1 + ((mx - mn) + 1e-9::DOUBLE)) - ln(1 + 1e-9::DOUBLE), 0), 9) AS size
FROM l, m""")
def color_size_points_embeddings(spark, d):
    data = labelled(spark, d)
    layout = data.select("vec_id", F.round("f1", 9).alias("x"), F.round("f2", 9).alias("y"))
    pts = X.color_size_points(layout, data, "vec_id", "Cluster", "f3")
    return pts.select("vec_id", "x", "y", "color", F.round("size", 9).alias("size"))


@register("explain_cluster_embeddings", "X1,X2")
def explain_cluster_embeddings(spark, d):
    imp = X.explain_cluster(labelled(spark, d), FEATS, cluster=3, bins=8)
    return X.top_terms(imp, 15)


@register("surrogate_rules_embeddings", "X3,X4,X5")
def surrogate_rules_embeddings(spark, d):
    m = X.surrogate_tree(labelled(spark, d), FEATS, depth=3)
    rules = X.decision_rules(m, FEATS)
    lines = rules.splitlines()
    plain = X.plain_rules(rules).splitlines()
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(lines, plain))],
                                 "line_no int, rule string, plain string")


def _emb_wide(spark, d, dims: int = 16):
    e = table(spark, d, "embeddings")
    cols = [f"f{i:02d}" for i in range(dims)]
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("pca_embeddings", "D1")
def pca_embeddings(spark, d):
    return D.pca(table(spark, d, "embeddings"), "embedding", "vec_id", 2)


@register("pca_two_features", "D1", "WITH " + L_SQL + """,
m AS (SELECT avg(f1) AS m1, avg(f2) AS m2, var_samp(f1) AS a, var_samp(f2) AS c, covar_samp(f1, f2) AS b FROM l),
v AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM m),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM v),
w AS (SELECT *, sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS s1, sign(CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END) AS s2 FROM u)
SELECT vec_id, round(((f1 - m1) * x + (f2 - m2) * y) * s1, 6) AS PC1, round(((f1 - m1) * -y + (f2 - m2) * x) * s2, 6) AS PC2 FROM l, w""")
def pca_two_features(spark, d):
    p = D.pca(labelled(spark, d), ["f1", "f2"], "vec_id", 2)
    return p.select("vec_id", F.round("PC1", 6).alias("PC1"), F.round("PC2", 6).alias("PC2"))


@register("kernel_pca_embeddings", "D2")
def kernel_pca_embeddings(spark, d):
    return D.kernel_pca(table(spark, d, "embeddings"), "embedding", "vec_id", 2, kernel="rbf")


@register("factor_analysis_embeddings", "D3")
def factor_analysis_embeddings(spark, d):
    w, cols = _emb_wide(spark, d, 64)
    return D.factor_analysis(w, cols, "vec_id", 2)


@register("umap_layout_embeddings", "D6,N2,N1")
def umap_layout_embeddings(spark, d):
    return D.umap_layout(table(spark, d, "embeddings"), "embedding", "vec_id", 2, k=15)


@register("tsne_layout_embeddings", "D7,N3")
def tsne_layout_embeddings(spark, d):
    return D.tsne_layout(table(spark, d, "embeddings"), "embedding", "vec_id", 2)


@register("embedding_quality_pca", "V5,D1")
def embedding_quality_pca(spark, d):
    e = table(spark, d, "embeddings")
    layout = D.pca(e, "embedding", "vec_id", 2)
    j = e.join(layout, "vec_id")
    return V.evaluate_embedding(j.select("vec_id", "embedding", F.array("PC1", "PC2").alias("pcs")),
                                "vec_id", "embedding", "pcs", 5)


@register("attach_clusters_drop_embedding", "J2,J1,P1", "WITH " + L_SQL + """
SELECT l.vec_id, l.f3, l.f4, l.Cluster FROM l""")
def attach_clusters_drop_embedding(spark, d):
    """Original features + Cluster, the embedding columns dropped (keyed join)."""
    data = labelled(spark, d)
    layout = data.select("vec_id", F.col("f1").alias("PC1"), F.col("f2").alias("PC2"), "Cluster")
    feats = data.select("vec_id", "f3", "f4")
    from tessera.operators.select import attach, drop_columns
    return drop_columns(attach(feats, layout, "vec_id"), ["PC1", "PC2"])


@register("lle_weights_embeddings", "N4")
def lle_weights_embeddings(spark, d):
    """Rows-only: reconstruction weights (sum to 1 per point, numpy-tested)."""
    return D.lle_weights(table(spark, d, "embeddings"), "embedding", "vec_id", k=10)


@register("lle_weight_sums", "N4", "SELECT vec_id AS id, CAST(10 AS BIGINT) AS n, 1.0 AS total FROM embeddings")
def lle_weight_sums(spark, d):
    """Every point has ten weights that sum to one."""
    w = D.lle_weights(table(spark, d, "embeddings"), "embedding", "vec_id", k=10)
    return w.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("total"))


@register("fuzzy_weight_sums", "N2", "SELECT vec_id AS id, round(log2(15), 4) AS total FROM embeddings")
def fuzzy_weight_sums(spark, d):
    """The memberships of a point's 15 neighbours sum to log2(15)."""
    nn = D.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 15)
    return D._fuzzy_weights(nn, 15).groupBy(F.col("i").alias("id")).agg(F.round(F.sum("w"), 4).alias("total"))


@register("perplexity_entropies", "N3", "SELECT vec_id AS id, round(ln(30), 4) AS entropy FROM embeddings")
def perplexity_entropies(spark, d):
    """The affinities of a point have the entropy that the perplexity 30 asks for."""
    nn = D.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 91, "cityblock")
    return D._perplexity_weights(nn, 30.0).groupBy(F.col("i").alias("id")) \
        .agg(F.round(-F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)), 4).alias("entropy"))


@register("lle_layout_embeddings", "D5,N4")
def lle_layout_embeddings(spark, d):
    return D.lle_layout(table(spark, d, "embeddings"), "embedding", "vec_id", 2, k=10)


@register("isomap_embeddings", "D4")
def isomap_embeddings(spark, d):
    return D.isomap(table(spark, d, "embeddings"), "embedding", "vec_id", 2, k=5)
