"""Outlier scan (O1-O6): high/low flags per numeric column, candidate rows,
box statistics, and removal.

The flags look only at the 8 largest / 8 smallest non-zero values of each
column. ``row_number() <= 8`` over a per-column window is planned by Spark
as a WindowGroupLimit: every map task keeps its own top 8 per column before
the shuffle, so the exchange carries at most 8 x columns x tasks rows no
matter how large or skewed the table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frame import columns_of_kind, qcol
from tessera.functions.quantiles import exact_quantiles

# The rule's sample size, ratio, and the report labels.
TOP_K = 8
MULTIPLIER = 5
HIGH_LABEL = "Possibly High Outlier(s)"
LOW_LABEL = "Possibly Low Outlier(s)"


def _numeric_long(df: DataFrame, cols: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("pos"),
                               qcol(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    return df.select(F.inline(items)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def extremes(df: DataFrame, cols: list[str] | None = None, k: int = TOP_K) -> DataFrame:
    """(column_name, pos, side, rank, value): the k largest values and the k
    smallest non-zero values of every numeric column (duplicates kept)."""
    cols = cols or columns_of_kind(df, "numeric")
    longf = _numeric_long(df, cols)
    hi = longf.withColumn("rank", F.row_number().over(
        Window.partitionBy("column_name", "pos").orderBy(F.col("value").desc()))) \
        .where(F.col("rank") <= k).withColumn("side", F.lit("high"))
    lo = longf.where(F.col("value") != 0).withColumn("rank", F.row_number().over(
        Window.partitionBy("column_name", "pos").orderBy(F.col("value").asc()))) \
        .where(F.col("rank") <= k).withColumn("side", F.lit("low"))
    return hi.unionByName(lo)


def outlier_flags(df: DataFrame, cols: list[str] | None = None, k: int = TOP_K,
                  mult: float = MULTIPLIER) -> DataFrame:
    """O1/O2: (column_name, pos, high, low).

    High: among the k largest, more than 3 distinct values and some nonzero
    v with max / v > mult. Low: among the k smallest nonzero, more than 3
    distinct values, the minimum is negative and some |min| / |v| > mult (a
    non-negative minimum can never flag, as in the reference)."""
    ex = extremes(df, cols, k)
    g = ex.groupBy("column_name", "pos", "side").agg(
        F.count_distinct("value").alias("nd"),
        F.max("value").alias("mx"), F.min("value").alias("mn"),
        F.collect_list("value").alias("vals"))
    m = F.lit(float(mult))
    high = F.exists("vals", lambda v: (v != 0) & (F.col("mx") / v > m))
    low = (F.col("mn") < 0) & F.exists("vals", lambda v: (v != 0) & (F.abs(F.col("mn")) / F.abs(v) > m))
    flagged = g.select("column_name", "pos", "side",
                       ((F.col("nd") > 3) & F.when(F.col("side") == "high", high).otherwise(low)).alias("flag"))
    return flagged.groupBy("column_name", "pos").agg(
        F.coalesce(F.max(F.when(F.col("side") == "high", F.col("flag"))), F.lit(False)).alias("high"),
        F.coalesce(F.max(F.when(F.col("side") == "low", F.col("flag"))), F.lit(False)).alias("low"))


def find_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """O3: (Column, Value) rows naming columns with possible outliers."""
    f = outlier_flags(df, cols)
    hi = f.where("high").select(F.col("column_name").alias("Column"), F.lit(HIGH_LABEL).alias("Value"), "pos",
                                F.lit(0).alias("_s"))
    lo = f.where("low").select(F.col("column_name").alias("Column"), F.lit(LOW_LABEL).alias("Value"), "pos",
                               F.lit(1).alias("_s"))
    return hi.unionByName(lo)


def outlier_candidates(df: DataFrame, col: str, id_col: str, side: str = "high",
                       k: int = TOP_K) -> DataFrame:
    """The k rows with the largest values (or smallest non-zero values),
    ties by id: a global top-k (TakeOrderedAndProject: each task keeps k)."""
    x = qcol(col)
    base = df.where(x.isNotNull())
    if side == "high":
        top = base.orderBy(x.desc(), qcol(id_col).asc()).limit(k)
    elif side == "low":
        top = base.where(x != 0).orderBy(x.asc(), qcol(id_col).asc()).limit(k)
    else:
        raise ValueError("side must be 'high' or 'low'")
    return top.select(qcol(id_col), x.alias("value"))


def remove_outliers(df: DataFrame, ids: DataFrame, id_col: str, col: str,
                    side: str = "high", k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Delete rows by id (anti join) and return (remaining rows,
    refreshed candidates)."""
    kept = df.join(ids.select(qcol(id_col)).distinct(), id_col, "left_anti")
    return kept, outlier_candidates(kept, col, id_col, side, k)


def box_stats(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Five-number summary with linear-interpolated quartiles and
    Tukey whiskers (most extreme values within 1.5 IQR of the quartiles),
    optionally per group. Exact and skew-safe (see quantiles module)."""
    by = by or []
    v = qcol(col).cast("double")
    base = df.select(*[qcol(b) for b in by], v.alias("_v"))
    q = exact_quantiles(base, by, "_v", [0.25, 0.5, 0.75]) \
        .withColumnRenamed("q_0", "q1").withColumnRenamed("q_1", "median").withColumnRenamed("q_2", "q3")
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*by, "q1", "median", "q3", "n",
                      (F.col("q1") - 1.5 * iqr).alias("_lf"), (F.col("q3") + 1.5 * iqr).alias("_uf"))
    if not by:
        # ungrouped: the fences are scalars (O(1) to the driver), used as literals
        fr = fences.first()
        agg = base.agg(F.min("_v").alias("min"), F.max("_v").alias("max"),
                       F.min(F.when(F.col("_v") >= F.lit(fr["_lf"]), F.col("_v"))).alias("lower_whisker"),
                       F.max(F.when(F.col("_v") <= F.lit(fr["_uf"]), F.col("_v"))).alias("upper_whisker"))
        return agg.select("min", F.lit(fr["q1"]).alias("q1"), F.lit(fr["median"]).alias("median"),
                          F.lit(fr["q3"]).alias("q3"), "max", "lower_whisker", "upper_whisker",
                          F.lit(fr["n"]).cast("long").alias("n"))
    # one fence row per group; AQE broadcasts it when measured small
    joined = base.join(fences, by)
    agg = joined.groupBy(*by).agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.min(F.when(F.col("_v") >= F.col("_lf"), F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(F.col("_v") <= F.col("_uf"), F.col("_v"))).alias("upper_whisker"))
    return agg.join(fences.drop("_lf", "_uf"), by).select(
        *by, "min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker",
        F.col("n").cast("long").alias("n"))
