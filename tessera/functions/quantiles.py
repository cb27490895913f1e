"""Exact, skew-safe quantiles with linear interpolation (numpy's default and
DuckDB's ``quantile_cont``).

``percentile()`` keeps every distinct value of a group in one aggregation
buffer, so a hot group would sit whole in one task. Here values are first
counted per (group, value) with map-side combining, cumulative counts come
from the range-block scheme of :mod:`tessera.functions.ranking`, and the two
order statistics around each requested position are picked by a join with
the per-group sizes (one row per group)."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranking import _blocks


def cumulative_counts(counts: DataFrame, group_cols: list[str], value_col: str, count_col: str,
                      n_blocks: int | None = None, rel_err: float = 0.001, ties: tuple[str, ...] = ()) -> DataFrame:
    """(group, value, count) -> adds ``before``: rows of the group with a
    smaller value (or an equal one that comes first by the ``ties`` columns).
    No task holds more than ~1/n_blocks of any group."""
    spark = counts.sparkSession
    n_blocks = n_blocks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blk = _blocks(counts, value_col, n_blocks, rel_err)
    w = Window.partitionBy(*group_cols, "_blk").orderBy(value_col, *ties) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = blk.withColumn("_lb", F.coalesce(F.sum(count_col).over(w), F.lit(0)))
    sizes = blk.groupBy(*group_cols, "_blk").agg(F.sum(count_col).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group_cols).orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(offsets.select(*group_cols, "_blk", "_off"), [*group_cols, "_blk"])
    return joined.withColumn("before", (F.col("_off") + F.col("_lb")).cast("long")) \
        .drop("_blk", "_lb", "_off")


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs: list[float]) -> DataFrame:
    """(group..., q_<i> for each prob, n) with linear interpolation between
    order statistics; NULL values are ignored."""
    if not group_cols:
        g = exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value_col, probs)
        return g.drop("_g")
    vals = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
    counts = vals.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    cum = cumulative_counts(counts, group_cols, value_col, "_c")
    sizes = counts.groupBy(*group_cols).agg(F.sum("_c").alias("_size"))
    # every (group, prob) needs the order statistics at floor(h) and ceil(h)
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("_size") - 1) * F.lit(float(p))
        wanted.append(F.struct(F.lit(i).alias("_pi"), h.alias("_h"),
                               F.floor(h).cast("long").alias("_lo"), F.ceil(h).cast("long").alias("_hi")))
    pos = sizes.select(*group_cols, "_size", F.inline(F.array(*wanted)))
    needed = pos.select(*group_cols, "_pi", F.col("_lo").alias("_at")).unionByName(
        pos.select(*group_cols, "_pi", F.col("_hi").alias("_at")))
    # join on the group keys; the range test keeps one value per position
    if group_cols == ["_g"]:
        needed = F.broadcast(needed)            # 2 x len(probs) rows: proven small
    hit = cum.join(needed, group_cols) \
        .where((F.col("before") <= F.col("_at")) & (F.col("_at") < F.col("before") + F.col("_c"))) \
        .select(*group_cols, "_pi", "_at", F.col(value_col).cast("double").alias("_v"))
    lo = hit.withColumnRenamed("_at", "_lo").withColumnRenamed("_v", "_vlo")
    hi = hit.withColumnRenamed("_at", "_hi").withColumnRenamed("_v", "_vhi")
    res = pos.join(lo, [*group_cols, "_pi", "_lo"]).join(hi, [*group_cols, "_pi", "_hi"]) \
        .select(*group_cols, "_pi", "_size",
                (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("_q"))
    out = res.groupBy(*group_cols).pivot("_pi", list(range(len(probs)))).agg(F.first("_q"))
    names = {str(i): f"q_{i}" for i in range(len(probs))}
    for k, v in names.items():
        out = out.withColumnRenamed(k, v)
    return out.join(sizes.withColumnRenamed("_size", "n"), group_cols)
