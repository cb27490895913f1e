"""Explaining clusters.

The additive one-vs-rest model is re-aimed onto Spark ML: each feature is
cut into quantile bins, bins are one-hot encoded, a logistic regression is
fitted on a seeded 90% split and scored on the rest. A feature's importance
is the mean absolute centred contribution of its bins. Pair terms ``a & b``
use the cross of two binned features. Profiles and box statistics are plain
aggregates."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import qcol
from tessera.functions.scale import log_scale
from tessera.operators.outliers import box_stats

# The comparison words of the profile and the tolerance.
SAME, HIGHER, LOWER = "about the same as", "higher than", "lower than"
TOLERANCE = 1e-6
TOP_TERMS = 15


def explain_cluster(df: DataFrame, features: list[str], cluster: int, label_col: str = "Cluster",
                    bins: int = 8, pairs: int = 10, seed: int = 42, train_fraction: float = 0.9) -> DataFrame:
    """(term, importance, accuracy) for "row in ``cluster``" vs the rest.

    First a model of single features; then every pair of features is scored by
    what its joint bins explain of that model's residuals, and the ``pairs``
    strongest (a model parameter) become terms of the final model. One
    aggregate scores all pairs, another weighs all terms."""
    names = {c: f"c{i}" for i, c in enumerate(features)}
    data = df.select(*[qcol(c).cast("double").alias(n) for c, n in names.items()],
                     (qcol(label_col) == F.lit(cluster)).cast("double").alias("_y")).na.drop()
    # split by a hash of the row, so that it is the same for any partitioning
    held = F.pmod(F.xxhash64(*data.columns, F.lit(seed)), F.lit(10_000)) >= int(round(10_000 * train_fraction))
    data = data.withColumn("_held", held)
    single = [QuantileDiscretizer(inputCol=n, outputCol=f"b_{n}", numBuckets=bins, handleInvalid="keep", relativeError=0.0001)
              for n in names.values()]
    data = Pipeline(stages=single).fit(data.where("NOT _held")).transform(data) \
        .select("_y", "_held", *[F.col(f"b_{n}").cast("int").alias(f"t_{n}") for n in names.values()])
    terms = {c: f"t_{n}" for c, n in names.items()}

    def fitted(frame: DataFrame, columns: list[str]):
        stages = []
        for t in columns:
            stages.append(OneHotEncoder(inputCol=t, outputCol=f"o_{t}", dropLast=False, handleInvalid="keep"))
        stages.append(VectorAssembler(inputCols=[f"o_{t}" for t in columns], outputCol="_x"))
        stages.append(LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01, elasticNetParam=0.0, maxIter=100))
        return Pipeline(stages=stages).fit(frame.where("NOT _held"))

    both = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    if pairs > 0 and both:
        rest = fitted(data, list(terms.values())).transform(data.where("NOT _held")) \
            .withColumn("_r", F.col("_y") - vector_to_array("probability")[1])

        def joint(a: str, b: str):
            return (F.col(terms[a]) * F.lit(bins + 1) + F.col(terms[b])).cast("int")

        cells = rest.select("_r", F.posexplode(F.array(*[joint(a, b) for a, b in both])).alias("k", "cell")) \
            .groupBy("k", "cell").agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("n"))
        strength = cells.groupBy("k").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("strength"))
        best = [both[r["k"]] for r in strength.orderBy(F.desc("strength"), "k").limit(pairs).collect()]
        for a, b in sorted(best, key=both.index):
            name = f"t_{names[a]}_{names[b]}"
            data = data.withColumn(name, joint(a, b))
            terms[f"{a} & {b}"] = name
    columns = list(terms.values())
    model = fitted(data, columns)
    accuracy = model.transform(data.where("_held")).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("a")).first()["a"]
    coef = model.stages[-1].coefficients.toArray()
    sizes = [stage.categorySizes[0] + 1 for stage in model.stages[:len(columns)]]       # one place for unseen cells
    counts: dict[int, dict[int, int]] = {}
    for r in data.where("NOT _held").select(F.posexplode(F.array(*columns)).alias("k", "cell")).groupBy("k", "cell").count().collect():
        counts.setdefault(r["k"], {})[r["cell"]] = r["count"]              # terms x cells numbers
    # importance: mean |w_bin - mean_w| over the training rows, per term
    rows, at = [], 0
    for k, term in enumerate(terms):
        w, n = coef[at:at + sizes[k]], counts.get(k, {})
        at += sizes[k]
        total = sum(n.values()) or 1
        mean = sum(w[c] * x for c, x in n.items()) / total
        rows.append((term, float(sum(abs(w[c] - mean) * x for c, x in n.items()) / total),
                     float(accuracy) if accuracy is not None else None))
    return df.sparkSession.createDataFrame(rows, "term string, importance double, accuracy double") \
        .orderBy(F.col("importance").desc(), "term")


def top_terms(importances: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """Only when some importance is positive: the n largest."""
    pos = importances.where(F.col("importance") > 0)
    return pos.orderBy(F.col("importance").desc(), "term").limit(n)


def surrogate_tree(df: DataFrame, features: list[str], label_col: str = "Cluster", depth: int = 3,
                   seed: int = 42):
    """Depth-3 decision tree predicting the cluster label."""
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(
        df.select(*[qcol(c).cast("double").alias(c) for c in features], qcol(label_col).cast("double").alias("_y")))
    return DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, seed=seed).fit(data)


def decision_rules(model, features: list[str]) -> str:
    """The tree as text with feature names instead of indices."""
    text = model.toDebugString
    return re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], text)


def leaf_rows(model, features: list[str], spark) -> DataFrame:
    """(leaf, depth, condition, predicted), one row for each leaf from left to right. ``condition``
    is SQL over the feature columns; a row of data meets that of one leaf."""
    rows = []

    def walk(node, path):
        if node.getClass().getSimpleName() == "LeafNode":
            rows.append((len(rows), len(path), " AND ".join(path) or "TRUE", int(node.prediction())))
            return
        name, at = features[node.split().featureIndex()].replace("`", "``"), float(node.split().threshold())
        walk(node.leftChild(), [*path, f"`{name}` <= {at!r}"])
        walk(node.rightChild(), [*path, f"`{name}` > {at!r}"])

    walk(model._java_obj.rootNode(), [])                       # 2 ** depth leaves at most
    return spark.createDataFrame(rows, "leaf int, depth int, condition string, predicted int")


def leaf_profile(df: DataFrame, leaves: DataFrame, label_col: str = "Cluster") -> DataFrame:
    """The leaves with their numbers of rows, and of rows that have the predicted label
    (``hits``), from one aggregate. Rows with a missing feature meet no condition."""
    rows = leaves.orderBy("leaf").collect()
    leaf = F.coalesce(*[F.when(F.expr(r["condition"]), F.lit(r["leaf"])) for r in rows])
    said = F.element_at(F.lit([r["predicted"] for r in rows]), F.col("leaf") + 1)
    per = df.select(leaf.alias("leaf"), qcol(label_col).alias("_y")).where(F.col("leaf").isNotNull()) \
        .groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_y") == said, 1)).alias("hits"))
    return leaves.join(per, "leaf", "left").na.fill(0, ["rows", "hits"])


def plain_rules(rules: str) -> str:
    """The rule text in words."""
    out = rules.replace("<=", "is at most").replace(" > ", " is more than ")
    out = out.replace("If (", "If ").replace("Else (", "Otherwise, if ").replace(")", "")
    return re.sub(r"Predict: (\S+)", r"the point belongs to cluster \1", out)


def cluster_profile(df: DataFrame, features: list[str], label_col: str = "Cluster") -> DataFrame:
    """Per cluster and feature: size, cluster mean, overall mean,
    difference and the comparison word (|diff| < 1e-6 -> about the same)."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("fpos"),
                               qcol(c).cast("double").alias("v")) for i, c in enumerate(features)])
    longf = df.select(qcol(label_col).alias("Cluster"), F.inline(items))
    per = longf.groupBy("Cluster", "feature", "fpos").agg(F.avg("v").alias("cluster_mean"))
    overall_row = df.agg(*[F.avg(qcol(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)])
    overall = overall_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("overall_mean"))
                                                   for i, c in enumerate(features)])))
    sizes = df.groupBy(qcol(label_col).alias("Cluster")).agg(F.count(F.lit(1)).alias("cluster_size"))
    out = per.join(F.broadcast(overall), "feature").join(sizes, "Cluster")   # overall: one row per feature
    diff = F.col("cluster_mean") - F.col("overall_mean")
    word = F.when(F.abs(diff) < TOLERANCE, F.lit(SAME)).when(diff > 0, F.lit(HIGHER)).otherwise(F.lit(LOWER))
    return out.select("Cluster", "cluster_size", "feature", "fpos", "cluster_mean", "overall_mean",
                      diff.alias("diff"), word.alias("comparison"))


def cluster_box_stats(df: DataFrame, feature: str, label_col: str = "Cluster") -> DataFrame:
    """Five-number summary of one feature per cluster."""
    return box_stats(df, feature, [label_col])


def list_clusters(df: DataFrame, label_col: str = "Cluster") -> DataFrame:
    """Distinct cluster labels."""
    return df.select(qcol(label_col)).distinct()


def color_size_points(embedding: DataFrame, data: DataFrame, id_col: str, target: str, feature: str) -> DataFrame:
    """Embedding points with the target as colour and a log-scaled size
    from one feature (keyed join on id, F3 sizes)."""
    sized = log_scale(data.select(qcol(id_col), qcol(target).alias("color"), qcol(feature)), feature, "size")
    return embedding.join(sized.select(qcol(id_col), "color", "size"), id_col)
