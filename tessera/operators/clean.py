"""Cleaning and filling (C1-C4): decimal fix, Unicode fix, null fill, and a
fix plan applied before re-running the health check."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as TX
from tessera.functions.frame import qcol
from tessera.operators import profile as P
from tessera.sources.io import infer_types


def fix_decimals(df: DataFrame, cols: list[str]) -> DataFrame:
    """Commas between digits -> dots, quotes removed, parsed; failures
    (``1.234,56``, ``1,234,567``, text) become NULL."""
    cols = set(cols)
    return df.select(*[N.fix_decimal(qcol(c)).alias(c) if c in cols else qcol(c)
                       for c in df.columns])


def fix_unicode(df: DataFrame, cols: list[str], drop_apostrophe: bool = True) -> DataFrame:
    """The listed marks replaced (dashes, quotes, nbsp) or removed."""
    cols = set(cols)
    return df.select(*[TX.fix_unicode(qcol(c), drop_apostrophe).alias(c) if c in cols else qcol(c)
                       for c in df.columns])


def fill_null(df: DataFrame, col: str, value: str) -> DataFrame:
    """NULLs of one column replaced by a user value, then that column's
    type is inferred again (the value may turn numbers into text)."""
    filled = df.withColumn(col, F.coalesce(qcol(col).cast("string"), F.lit(str(value))))
    return infer_types(filled, [col])


@dataclass
class FixPlan:
    drop: list[str] = field(default_factory=list)
    decimals: list[str] = field(default_factory=list)
    unicode: list[str] = field(default_factory=list)
    fill: dict[str, str] = field(default_factory=dict)


def apply_fixes(df: DataFrame, plan: FixPlan, id_col: str,
                thresholds: P.Thresholds = P.Thresholds()) -> tuple[DataFrame, DataFrame]:
    """C4: apply a plan (drop, decimal fix, Unicode fix, fills) and return
    (fixed frame, its new health report)."""
    out = df.drop(*[c for c in plan.drop if c in df.columns])
    if plan.decimals:
        out = fix_decimals(out, [c for c in plan.decimals if c in out.columns])
    if plan.unicode:
        out = fix_unicode(out, [c for c in plan.unicode if c in out.columns])
    for c, v in plan.fill.items():
        if c in out.columns:
            out = fill_null(out, c, v)
    return out, P.health_report(out, id_col, thresholds)
