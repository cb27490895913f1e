"""Scaling and label helpers (F3, F4, F5) as column expressions / small plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import qcol
from tessera.functions.ranking import group_row_number
from tessera.functions.text import shorten
from tessera.session import cut_lineage


def log_scale(df: DataFrame, col: str, out: str = "size", lo: float = 1.0, hi: float = 7.0) -> DataFrame:
    """marker size lo + (hi-lo) * minmax(log1p(x - min + 1e-9)). The
    extremes are scalars from one aggregate (O(1) to the driver) used as
    literals; log1p is monotone, so its extremes are those of x. A constant
    column gives NULL instead of dividing by zero."""
    x = qcol(col)
    r = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    if r["mn"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    mn, mx = F.lit(float(r["mn"])), F.lit(float(r["mx"]))
    ls = F.log1p((x - mn) + F.lit(1e-9))
    lo_v = F.log1p((mn - mn) + F.lit(1e-9))
    hi_v = F.log1p((mx - mn) + F.lit(1e-9))
    return df.withColumn(out, F.lit(lo) + F.lit(hi - lo) * (ls - lo_v) / F.nullif(hi_v - lo_v, F.lit(0.0)))


def shorten_labels(df: DataFrame, label_col: str, order_col: str, out: str = "short_label",
                   max_len: int = 15) -> DataFrame:
    """labels cut to ``max_len`` + ``...``; the k-th repeat (k >= 2) of a
    cut label, in ``order_col`` order, gets the suffix ``(k)``. Numbering
    uses the skew-safe group row number (a common prefix may be hot)."""
    cut = df.withColumn("_cut", shorten(qcol(label_col), max_len))
    numbered = group_row_number(cut, ["_cut"], order_col, "_k")

    def suffixed(name: str):
        return F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("("), F.col("_k").cast("string"), F.lit(")")))

    done = numbered.withColumn(out, suffixed("_cut")).drop("_cut", "_k")
    # a suffixed label may equal another label as it stands: number such repeats until none is left
    while done.groupBy(out).count().where("count > 1").limit(1).count():
        again = group_row_number(done.withColumnRenamed(out, "_cut"), ["_cut"], order_col, "_k")
        done = cut_lineage(again.withColumn(out, suffixed("_cut")).drop("_cut", "_k"))
    return done
