"""Row numbers and cumulative counts within groups that may be hot.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; if one
group holds a third of the rows, one task sorts a third of the data. Here
the order column is first cut into contiguous ranges by approximate
quantiles (O(blocks) numbers reach the driver), windows run per (group,
range), and each (group, range) gets the count of its group's rows in
earlier ranges as an offset. Result is exact; no task sees more than about
rows/blocks rows of any group."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(df: DataFrame, order_col: str, n_blocks: int, rel_err: float) -> DataFrame:
    probs = [i / n_blocks for i in range(1, n_blocks)]
    cuts = sorted(set(df.approxQuantile(order_col, probs, rel_err))) if probs else []
    cuts = [c for c in cuts if c == c]                       # drop NaN
    splits = [float("-inf")] + [float(c) for c in cuts] + [float("inf")]
    if len(splits) < 3:
        return df.withColumn("_blk", F.lit(0.0))
    tmp = df.withColumn("_ord_d", F.col(order_col).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_ord_d", outputCol="_blk", handleInvalid="keep")
    return b.transform(tmp).drop("_ord_d")


def group_row_number(df: DataFrame, group_cols: list[str], order_col: str, out: str = "rn",
                     n_blocks: int | None = None, rel_err: float = 0.001) -> DataFrame:
    """Exact ``row_number() over (partition by group order by order_col)``
    (order_col numeric and unique within a group), skew-safe."""
    spark = df.sparkSession
    n_blocks = n_blocks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blk = _blocks(df, order_col, n_blocks, rel_err)
    local = blk.withColumn("_lrn", F.row_number().over(
        Window.partitionBy(*group_cols, "_blk").orderBy(order_col)))
    sizes = blk.groupBy(*group_cols, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (group, range): at most n_blocks rows for the hottest group
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group_cols).orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(offsets.select(*group_cols, "_blk", "_off"), [*group_cols, "_blk"])
    return joined.withColumn(out, (F.col("_off") + F.col("_lrn")).cast("long")) \
        .drop("_blk", "_lrn", "_off")


def average_rank(counts: DataFrame, group_cols: list[str], value_col: str, count_col: str,
                 out: str = "avg_rank", n_blocks: int | None = None,
                 rel_err: float = 0.001) -> DataFrame:
    """Average (tie-aware) rank of each distinct value within its group from
    a (group, value, count) frame: rank = rows before + (count + 1) / 2.
    Same range-block scheme as :func:`group_row_number`."""
    spark = counts.sparkSession
    n_blocks = n_blocks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blk = _blocks(counts, value_col, n_blocks, rel_err)
    w = Window.partitionBy(*group_cols, "_blk").orderBy(value_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = blk.withColumn("_before", F.coalesce(F.sum(count_col).over(w), F.lit(0)))
    sizes = blk.groupBy(*group_cols, "_blk").agg(F.sum(count_col).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group_cols).orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(offsets.select(*group_cols, "_blk", "_off"), [*group_cols, "_blk"])
    rank = F.col("_off") + F.col("_before") + (F.col(count_col) + 1) / 2.0
    return joined.withColumn(out, rank.cast("double")).drop("_blk", "_before", "_off")
