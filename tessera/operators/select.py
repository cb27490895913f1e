"""Projections, filters and keyed joins.

Row identity is always an explicit id column: positional attach (the
reference concatenates arrays by row order) becomes a keyed join, because
Spark rows have no stable position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import qcol


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop flagged columns; names that are absent are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def feature_columns(df: DataFrame, targets: list[str] | None = None,
                    exclude: list[str] | None = None) -> list[str]:
    """A8 + P2: non-target columns, sorted by name (set difference sorts)."""
    targets = targets or [default_target(df)]
    skip = set(targets) | set(exclude or [])
    return sorted(c for c in df.columns if c not in skip)


def select_features(df: DataFrame, cols: list[str], id_col: str | None = None,
                    target: str | None = None) -> DataFrame:
    """Feature projection in sorted name order, optionally with id and
    target kept in front / at the end."""
    front = [id_col] if id_col else []
    back = [target] if target and target not in cols else []
    return df.select(*[qcol(c) for c in front + sorted(cols) + back])


def default_target(df: DataFrame) -> str:
    """The last column is the default target."""
    return df.columns[-1]


def filter_report(report: DataFrame, contains: str, col: str = "errors_found") -> DataFrame:
    """P5: report rows whose text contains a category (case-insensitive)."""
    return report.where(F.lower(F.col(col)).contains(contains.lower()))


def filter_ids(df: DataFrame, ids: DataFrame | None, id_col: str) -> DataFrame:
    """Keep a selection of rows (semi join); no selection = all rows.
    Catalyst/AQE broadcast the id side when it is measured small."""
    if ids is None:
        return df
    return df.join(ids.select(qcol(id_col)).distinct(), id_col, "left_semi")


def drop_rows(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Delete chosen rows (anti join)."""
    return df.join(ids.select(qcol(id_col)).distinct(), id_col, "left_anti")


def drop_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Remove rows holding NULLs (in ``cols`` or anywhere)."""
    return df.na.drop(how="any", subset=cols)


def in_box(x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float]) -> Column:
    return x.between(*x_range) & y.between(*y_range)


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting folded over the literal vertices: a point is inside when
    a ray to +x crosses an odd number of edges."""
    crossings = F.lit(0)
    n = len(vertices)
    for i in range(n):
        (xi, yi), (xj, yj) = vertices[i], vertices[(i - 1) % n]
        if yi == yj:
            continue
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & \
            (x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit(yj - yi) + F.lit(xi))
        crossings = crossings + F.when(crosses, 1).otherwise(0)
    return crossings % 2 == 1


def range_select(df: DataFrame, id_col: str, x: str, y: str,
                 box: tuple[tuple[float, float], tuple[float, float]] | None = None,
                 polygon: list[tuple[float, float]] | None = None) -> DataFrame:
    """Ids of the points of an embedding inside a box or a lasso polygon
    (the brushed selection of the reference's plots)."""
    cond = F.lit(True)
    if box is not None:
        cond = cond & in_box(qcol(x), qcol(y), box[0], box[1])
    if polygon is not None:
        cond = cond & in_polygon(qcol(x), qcol(y), polygon)
    return df.where(cond).select(qcol(id_col))


def attach(left: DataFrame, right: DataFrame, id_col: str, how: str = "inner") -> DataFrame:
    """Attach columns (e.g. ``Cluster``) by id."""
    return left.join(right, id_col, how)
