"""Exact all-pairs work in bounded tiles.

Distance-based metrics of the reference (silhouette, stress, distance
correlation, trustworthiness, continuity, k nearest neighbours) need every
pair of points. Instead of a cross join that materialises n^2 pair rows,
points are hashed into T tiles of at most ~``tile_rows`` rows; every row is
replicated to the T unordered tile pairs it belongs to and each (a, b) tile
pair is one ``applyInPandas`` group. The group computes its distance block
with numpy and emits only partial aggregates (sums, counts, top-k lists),
never pairs. From 16 tiles on, up to ``MAX_SPAN`` tiles lie in one, so that rows are
copied and partial results emitted less often; the group goes through it ``tile_rows``
rows at a time. Memory per task is bounded by 2 x MAX_SPAN x tile_rows points
and one tile_rows x tile_rows block, work spreads over T(T+1)/2 tasks, and nothing
passes through the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import qcol
from tessera.session import ship_package

DEFAULT_TILE_ROWS = 1024
#: Tiles that one group may hold of each side, and groups of rows that are kept for parallel work.
MAX_SPAN, LEAST_GROUPS = 32, 16
#: Squared distances below this share of the squared norms are computed from differences.
CANCELS = 1e-4


def vector_col(df: DataFrame, cols: list[str] | str, out: str = "_vec"):
    """array<double> from an array column or from scalar columns."""
    if isinstance(cols, str):
        return F.transform(qcol(cols), lambda x: x.cast("double")).alias(out)
    return F.array(*[qcol(c).cast("double") for c in cols]).alias(out)


def n_tiles_for(df: DataFrame, tile_rows: int) -> int:
    n = df.count()
    return max(1, math.ceil(n / tile_rows))


def tile_pairs(df: DataFrame, id_col: str, n_tiles: int) -> DataFrame:
    """Add ``_tile`` and replicate each row to its (``_pa`` <= ``_pb``) tile
    pairs: T copies of each row, never a cross product."""
    t = df.withColumn("_tile", F.pmod(F.xxhash64(qcol(id_col)), F.lit(n_tiles)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("_other")
    rep = t.select("*", other)
    return rep.withColumn("_pa", F.least("_tile", "_other")).withColumn("_pb", F.greatest("_tile", "_other")) \
        .drop("_other")


def apply_tiles(df: DataFrame, id_col: str, fn, schema: str, tile_rows: int = DEFAULT_TILE_ROWS,
                n_tiles: int | None = None, whole: bool = False) -> DataFrame:
    """Run ``fn(a, b, same)`` on every unordered tile pair; ``a``/``b`` are
    pandas frames of the two tiles (the same frame when ``same``). With ``whole`` it gets
    all the rows of a group at once, and cuts them itself (:func:`chunks`)."""
    ship_package(df.sparkSession)
    n_tiles = n_tiles or n_tiles_for(df, tile_rows)
    span = min(MAX_SPAN, max(1, n_tiles // LEAST_GROUPS))
    groups = math.ceil(n_tiles / span)
    rep = tile_pairs(df, id_col, groups)
    rep = rep.repartition(groups * (groups + 1) // 2, "_pa", "_pb") if groups > 1 else rep

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pa, pb = int(pdf["_pa"].iloc[0]), int(pdf["_pb"].iloc[0])
        tile = pdf["_tile"]
        pdf = pdf.drop(columns=["_pa", "_pb", "_tile"])
        a = pdf[tile == pa].reset_index(drop=True)
        b = a if pa == pb else pdf[tile == pb].reset_index(drop=True)
        if whole or span == 1:
            return fn(a, b, pa == pb)
        left, right = ([f.iloc[s].reset_index(drop=True) for s in chunks(len(f), tile_rows)] for f in (a, b))
        outs = [fn(x, x, True) if pa == pb and i == j else fn(x, y, False)
                for i, x in enumerate(left) for j, y in enumerate(right) if pa != pb or i <= j]
        return pd.concat([o for o in outs if len(o)] or outs or [fn(a, b, pa == pb)], ignore_index=True)

    return rep.groupBy("_pa", "_pb").applyInPandas(run, schema)


def chunks(n: int, rows: int) -> list[slice]:
    """Slices of about ``rows`` rows that cover ``n``."""
    return [slice(s, min(s + rows, n)) for s in range(0, n, rows)]


def stack(series: pd.Series) -> np.ndarray:
    """pandas column of arrays -> 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.values])


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact pairwise Euclidean distances, computed from differences (not
    the |a|^2 + |b|^2 - 2ab shortcut, which loses precision)."""
    out = np.empty((a.shape[0], b.shape[0]))
    if a.shape[1] == b.shape[1] == 2:                             # the same sums without a third axis
        for s in chunks(len(a), 64):
            dx, dy = (np.subtract.outer(a[s, t], b[:, t]) for t in (0, 1))
            dx *= dx
            dy *= dy
            dx += dy
            np.sqrt(dx, out=out[s])
        return out
    step = max(1, 4_000_000 // max(1, b.shape[0] * max(1, a.shape[1])))
    for s in range(0, a.shape[0], step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def centred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both moved by the mean of ``a``: equal differences, smaller norms."""
    mean = a.mean(axis=0) if len(a) else 0.0
    mean = mean if np.isfinite(mean).all() else 0.0
    return a - mean, b - mean


def squared_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """|a|^2 + |b|^2 - 2ab, fast but with absolute errors, which stay below the sum of
    the two others: one bound for each row of ``a`` and one for each of ``b``."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d2 = a @ (-2.0 * b.T)
    d2 += na[:, None]
    d2 += nb
    share = 8 * (a.shape[1] + 4) * np.finfo(float).eps
    return d2, share * na, share * nb


def apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of the rows a[i] and b[j] from differences, summed one dimension after the other."""
    out = np.empty(len(i))
    for s in chunks(len(i), 1 << 16):
        diff = (a[i[s]] - b[j[s]]).T
        total = np.zeros(diff.shape[1])
        for x in diff:
            total += x * x if metric == "euclidean" else np.abs(x)
        out[s] = np.sqrt(total) if metric == "euclidean" else total
    return out


def euclidean_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances for sums: from products, but from differences where
    products lose digits. Relative errors stay about 1e-11."""
    if a.shape[1] <= 4 or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return euclidean(a, b) if a.shape[1] > 4 or not a.shape[1] else \
            np.sqrt(sum((x[:, None] - y[None, :]) ** 2 for x, y in zip(a.T, b.T)))
    x, y = centred(a, b)
    d2, ea, eb = squared_products(x, y)
    share = 8 * (a.shape[1] + 4) * np.finfo(float).eps
    close = CANCELS / share * max(ea.max(initial=0.0), 0.0) + CANCELS / share * eb
    i, j = np.nonzero(d2 < close)
    out = np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)
    if len(i):
        out[i, j] = apart(a, b, i, j)
    return out


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within the Euclidean ``radius``: from products, and from
    differences where their errors leave it open."""
    if a.shape[1] <= 4 or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return euclidean(a, b) <= radius
    near, ea, eb = squared_products(*centred(a, b))
    slack = ea[:, None] + eb.max(initial=0.0) + 1e-12 * radius * radius
    near -= radius * radius
    out = near <= slack
    i, j = np.nonzero(out & (near >= -slack))
    out[i, j] = apart(a, b, i, j) <= radius
    return out


def manhattan_single(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Manhattan distances in single precision, and bounds of their errors as in :func:`squared_products`."""
    x, y = (np.ascontiguousarray(v.T, np.float32) for v in (a, b))
    out = np.zeros((len(a), len(b)), np.float32)
    for s in chunks(len(a), 32):
        part, work = out[s], np.empty((len(out[s]), len(b)), np.float32)
        for p, q in zip(x, y):
            np.subtract(p[s, None], q, out=work)
            part += np.abs(work, out=work)
    share = 2 * (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    return out, share * np.abs(a).sum(1), share * np.abs(b).sum(1)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, 4_000_000 // max(1, b.shape[0] * max(1, a.shape[1])))
    for s in range(0, a.shape[0], step):
        out[s:s + step] = np.abs(a[s:s + step, None, :] - b[None, :, :]).sum(-1)
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na = np.linalg.norm(a, axis=1)[:, None]
    nb = np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - (a @ b.T) / (na * nb)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cosine(a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "cityblock": manhattan,
           "cosine": cosine, "correlation": correlation}


def distance_fn(metric: str):
    try:
        return METRICS[metric]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}") from None


def apply_grid(df: DataFrame, id_col: str, coords: list[str], cell: float, fn, schema: str,
               tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Like :func:`apply_tiles`, but only for pairs of points in the same or
    adjacent grid cells (side ``cell``), for radius searches in 1-3
    dimensions. A cell holding more than ``tile_rows`` points is split into
    hash sub-tiles (its count comes from one aggregate), so a dense cell --
    even one holding a third of the rows -- is spread over many bounded
    blocks. Each point is replicated only to the buckets of its 3^d
    neighbouring cells."""
    import itertools
    ship_package(df.sparkSession)
    d = len(coords)
    # cells may be wider than the radius (neighbours still lie in adjacent
    # cells); size them from the extent so a cell holds ~tile_rows/4 points
    # on average instead of a handful (fewer, fuller blocks). One aggregate.
    ext = df.agg(F.count(F.lit(1)).alias("n"),
                 *[(F.max(qcol(c)) - F.min(qcol(c))).alias(f"r{i}") for i, c in enumerate(coords)]).first()
    if ext["n"]:
        volume = 1.0
        for i in range(d):
            volume *= max(float(ext[f"r{i}"] or 0.0), float(cell))
        cell = max(float(cell), (volume * (tile_rows / 4) / ext["n"]) ** (1.0 / d))
    cells = [F.floor(qcol(c) / F.lit(float(cell))).cast("long").alias(f"_c{i}") for i, c in enumerate(coords)]
    pts = df.select("*", *cells)
    ckeys = [f"_c{i}" for i in range(d)]
    sizes = pts.groupBy(*ckeys).agg(F.count(F.lit(1)).alias("_cnt")) \
        .withColumn("_nsubs", F.greatest(F.lit(1), F.ceil(F.col("_cnt") / F.lit(tile_rows))).cast("int")) \
        .drop("_cnt")
    own = pts.join(sizes, ckeys).withColumn("_sub", F.pmod(F.xxhash64(qcol(id_col)), F.col("_nsubs")).cast("int")) \
        .withColumn("_bucket", F.concat_ws(":", *[F.col(k).cast("string") for k in ckeys],
                                           F.col("_sub").cast("string"))).drop("_nsubs", "_sub")
    offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=d)])
    nbr = own.select("*", F.explode(offsets).alias("_off"))
    for i, k in enumerate(ckeys):
        nbr = nbr.withColumn(f"_n{i}", F.col(k) + F.col("_off")[i])
    nsizes = sizes.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(ckeys)], F.col("_nsubs").alias("_other_subs"))
    nbr = nbr.join(nsizes, [f"_n{i}" for i in range(d)])
    nbr = nbr.select("*", F.explode(F.sequence(F.lit(0), F.col("_other_subs") - 1)).alias("_other_sub"))
    other = F.concat_ws(":", *[F.col(f"_n{i}").cast("string") for i in range(d)], F.col("_other_sub").cast("string"))
    keyed = nbr.withColumn("_other", other) \
        .withColumn("_pa", F.least("_bucket", "_other")).withColumn("_pb", F.greatest("_bucket", "_other"))
    keep = [c for c in df.columns] + ["_bucket", "_pa", "_pb"]
    keyed = keyed.select(*[qcol(c) for c in keep])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ta, tb = pdf["_pa"].iloc[0], pdf["_pb"].iloc[0]
        own_b = pdf["_bucket"]
        a = pdf[own_b == ta].drop(columns=["_pa", "_pb", "_bucket"]).reset_index(drop=True)
        if ta == tb:
            return fn(a, a, True)
        b = pdf[own_b == tb].drop(columns=["_pa", "_pb", "_bucket"]).reset_index(drop=True)
        return fn(a, b, False)

    return keyed.groupBy("_pa", "_pb").applyInPandas(run, schema)
