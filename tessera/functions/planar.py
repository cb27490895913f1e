"""Distances to the k-th nearest point in a plane, without all pairs.

Rows of one group and place collapse to one weighted point, so ties cost
nothing. Each group's plane is cut into strips of x and each strip into tiles of y,
at approximate quantiles, so that a tile holds a bounded number of points
wherever they crowd. A tile gives each of its points an upper bound, the
k-th distance among its own points. Only points whose square of that half side reaches
over the border visit the tiles that it meets; their candidates are merged.
The result is exact. Distances are the larger of the two axes' (Chebyshev)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, ship_package

TILE_POINTS = 2000
CHUNK = 256               # points whose distances are worked out at once


def nearest(points: np.ndarray, weights: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None,
            reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, weights) of up to ``k`` nearest points of each query, in
    ascending order, padded with infinity and 0. ``own``: the query's place among the
    points, of which one row does not count; ``reach``: only points up to
    that distance are asked for.

    Points are swept along the axis of the larger extent: what lies farther
    than the best k so far along one axis can't be nearer in the plane."""
    n, m = len(queries), len(points)
    axis = int(np.argmax(np.ptp(points, axis=0))) if m else 0
    order = np.argsort(points[:, axis], kind="stable")
    pts, w, line = points[order], weights[order], points[order, axis]
    width = min(m, k + (own is not None))
    dist, many = np.full((n, k + 1), np.inf), np.zeros((n, k + 1), np.int64)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    by_line = np.argsort(queries[:, axis], kind="stable")
    for at in range(0, n, CHUNK):
        rows = by_line[at:at + CHUNK]
        q = queries[rows]
        if reach is None:
            # the width nearest along the line bound the distance
            mid = np.searchsorted(line, q[:, axis])
            low = np.clip(mid - width, 0, max(0, m - 2 * width))
            near = np.minimum(low[:, None] + np.arange(min(m, 2 * width)), m - 1)
            d = np.abs(pts[near] - q[:, None, :]).max(-1)
            far = np.partition(d, width - 1, axis=1)[:, width - 1] if width else np.zeros(len(rows))
        else:
            far = reach[rows]
        slack = 4 * np.spacing(np.abs(q[:, axis]).max())
        a = np.searchsorted(line, (q[:, axis] - far).min() - slack, "left")
        b = np.searchsorted(line, (q[:, axis] + far).max() + slack, "right")
        if a >= b:
            continue
        d = np.abs(q[:, None, :] - pts[None, a:b]).max(-1)
        take = min(k + 1, b - a)
        best = np.argpartition(d, take - 1, axis=1)[:, :take] if take < b - a else np.tile(np.arange(b - a), (len(rows), 1))
        got = np.take_along_axis(d, best, axis=1)
        count = w[a:b][best]
        if own is not None:
            count = count - (best + a == place[own[rows]][:, None])
            got = np.where(count > 0, got, np.inf)
        if reach is not None:
            count = np.where(got <= far[:, None], count, 0)
            got = np.where(count > 0, got, np.inf)
        s = np.argsort(got, axis=1, kind="stable")
        dist[rows, :take] = np.take_along_axis(got, s, axis=1)
        many[rows, :take] = np.take_along_axis(count, s, axis=1)
    return dist[:, :k], many[:, :k]


def _lists(rows: np.ndarray) -> pd.Series:
    return pd.Series(list(rows), dtype=object)


def _tiles(points: DataFrame, tile_points: int) -> DataFrame:
    """(g, strip, strip_lo, strip_hi, cuts): the strips of each group and the
    places on the y axis where a strip is cut into tiles."""
    sizes = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(sizes.values(), default=0)
    strips = max(1, math.isqrt(math.ceil(most / tile_points)))
    at = [i / strips for i in range(1, strips)]
    if at:
        cut = points.groupBy("g").agg(F.percentile_approx("x", at, 10 * strips + 1000).alias("xs"))
    else:
        cut = points.select("g").distinct().withColumn("xs", F.array().cast("array<double>"))
    cut = cut.withColumn("xs", F.array_sort(F.array_distinct("xs")))
    held = points.join(F.broadcast(cut), "g").withColumn("strip", F.size(F.filter("xs", lambda c: c <= F.col("x"))))
    count = held.groupBy("g", "strip").agg(F.count(F.lit(1)).alias("n"))
    tallest = max(1, math.ceil((count.agg(F.max("n")).first()[0] or 0) / tile_points))
    at = [i / tallest for i in range(1, tallest)]
    y = F.percentile_approx("y", at, 10 * tallest + 1000) if at else F.array().cast("array<double>")
    strip = held.groupBy("g", "strip").agg(F.count(F.lit(1)).alias("n"), *([y.alias("ys")] if at else []))
    if not at:
        strip = strip.withColumn("ys", y)
    # a strip with fewer points takes every so many-th cut
    every = F.greatest(F.lit(1), F.floor(F.lit(tallest) * F.lit(tile_points) / F.col("n"))).cast("int")
    some = F.filter("ys", lambda v, i: (i + 1) % every == 0)
    inf = F.lit(float("inf"))
    return strip.join(F.broadcast(cut), "g").select(
        "g", "strip", F.when(F.col("strip") > 0, F.get("xs", F.col("strip") - 1)).otherwise(-inf).alias("strip_lo"),
        F.coalesce(F.get("xs", F.col("strip")), inf).alias("strip_hi"), F.array_sort(F.array_distinct(some)).alias("cuts"), "xs")


def kth_distance(rows: DataFrame, k: int, tile_points: int = TILE_POINTS) -> DataFrame:
    """(g, x, y, w, r) for every distinct (g, x, y) of ``rows`` (g string, x and y
    double, none missing): its number of rows and the distance from one of them to
    its k-th nearest other row in the group; infinite where a group has k rows or fewer."""
    ship_package(rows.sparkSession)
    points = cut_lineage(rows.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    strips = cut_lineage(_tiles(points, tile_points))
    lines = strips.groupBy("g").agg(F.first("xs").alias("xs"))                    # a row a group
    tile = F.concat_ws(":", "g", F.col("strip").cast("string"), F.col("tile").cast("string"))
    placed = points.join(F.broadcast(lines), "g").withColumn("strip", F.size(F.filter("xs", lambda c: c <= F.col("x")))) \
        .drop("xs").join(strips.drop("xs"), ["g", "strip"]) \
        .withColumn("tile", F.size(F.filter("cuts", lambda c: c <= F.col("y")))) \
        .withColumn("lo", F.when(F.col("tile") > 0, F.get("cuts", F.col("tile") - 1)).otherwise(F.lit(float("-inf")))) \
        .withColumn("hi", F.coalesce(F.get("cuts", F.col("tile")), F.lit(float("inf")))).drop("cuts") \
        .withColumn("t", tile)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy()
        d, c = nearest(p, pdf["w"].to_numpy(), p, k, own=np.arange(len(p)))
        reached = np.cumsum(c, axis=1) >= k
        r = np.where(reached.any(axis=1), d[np.arange(len(p)), reached.argmax(axis=1)], np.inf)
        with np.errstate(invalid="ignore"):
            over = (p[:, 0] - r < pdf["strip_lo"].to_numpy()) | (p[:, 0] + r >= pdf["strip_hi"].to_numpy()) \
                | (p[:, 1] - r < pdf["lo"].to_numpy()) | (p[:, 1] + r >= pdf["hi"].to_numpy())
        return pdf.assign(r=r, over=over, ds=_lists(d), ws=_lists(c))[["g", "x", "y", "w", "t", "r", "over", "ds", "ws"]]

    local = cut_lineage(placed.groupBy("t").applyInPandas(
        inside, "g string, x double, y double, w long, t string, r double, over boolean, ds array<double>, ws array<long>"))
    crossing = local.where("over").select("g", F.col("x").alias("qx"), F.col("y").alias("qy"), "r", F.col("t").alias("home"))
    # the strips, then the tiles, that the square around a point meets
    first = F.size(F.filter("xs", lambda c: c <= F.col("qx") - F.col("r")))
    last = F.size(F.filter("xs", lambda c: c <= F.col("qx") + F.col("r")))
    low = F.size(F.filter("cuts", lambda c: c <= F.col("qy") - F.col("r")))
    high = F.size(F.filter("cuts", lambda c: c <= F.col("qy") + F.col("r")))
    visits = crossing.join(F.broadcast(lines), "g").withColumn("strip", F.explode(F.sequence(first, last))).drop("xs") \
        .join(strips.select("g", "strip", "cuts"), ["g", "strip"]).withColumn("tile", F.explode(F.sequence(low, high))).drop("cuts") \
        .withColumn("t", tile).where(F.col("t") != F.col("home")).select("g", "qx", "qy", "r", "t")

    def visit(queries: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        d, c = nearest(here[["x", "y"]].to_numpy(), here["w"].to_numpy(), queries[["qx", "qy"]].to_numpy(), k, reach=queries["r"].to_numpy())
        return pd.DataFrame({"g": queries["g"], "x": queries["qx"], "y": queries["qy"], "ds": _lists(d).to_numpy(),
                             "ws": _lists(c).to_numpy()})

    found = visits.groupBy("t").cogroup(placed.groupBy("t")).applyInPandas(visit, "g string, x double, y double, ds array<double>, ws array<long>")
    pairs = F.arrays_zip(F.col("ds").alias("d"), F.col("ws").alias("w"))
    all_found = local.where("over").select("g", "x", "y", "ds", "ws").unionByName(found).select("g", "x", "y", pairs.alias("p")) \
        .groupBy("g", "x", "y").agg(F.flatten(F.collect_list("p")).alias("p"))          # k from each tile that was met
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(float("inf")).alias("r"))
    merged = all_found.withColumn("p", F.array_sort(F.filter("p", lambda z: z["w"] > 0))).select(
        "g", "x", "y", F.aggregate("p", start, lambda s, z: F.struct(
            (s["c"] + z["w"]).alias("c"), F.when((s["c"] < k) & (s["c"] + z["w"] >= k), z["d"]).otherwise(s["r"]).alias("r")))["r"].alias("better"))
    return local.select("g", "x", "y", "w", "r").join(merged, ["g", "x", "y"], "left") \
        .select("g", "x", "y", "w", F.coalesce("better", "r").alias("r"))
