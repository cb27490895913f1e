"""Nearest neighbours and graph components.

k nearest neighbours are exact: each tile pair keeps, for every point, its
k best candidates inside the block; the union holds at most k x T rows per
point and a ``row_number() <= k`` window (a WindowGroupLimit) keeps the
global k. In a block, products (Euclidean) or single precision (Manhattan) tell with known
error bounds which pairs can be among the best; only their distances are computed from differences. Connected components use alternating large-star / small-star
rounds; lineage is cut with reliable checkpoints in the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.functions.frame import qcol
from tessera.functions.pairs import DEFAULT_TILE_ROWS, apart, apply_tiles, centred, chunks, distance_fn, manhattan_single, \
    squared_products, stack, vector_col
from tessera.session import cut_lineage


def id_kind(df: DataFrame, id_col: str) -> str:
    """The type an id is carried in: long for whole numbers, its own otherwise."""
    kind = df.schema[id_col].dataType
    return "long" if isinstance(kind, IntegralType) else kind.simpleString()


class Best:
    """The k nearest rows found so far of n rows, in the order (distance, place)."""

    def __init__(self, n: int, k: int):
        self.dist, self.at, self.place = np.full((n, k), np.inf), np.full((n, k), -1), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, at: np.ndarray, dist: np.ndarray, place: np.ndarray) -> None:
        """Take in the rows ``at``, no pair twice."""
        if not len(rows):
            return
        k = self.dist.shape[1]
        hit = np.unique(rows)
        group = np.concatenate([np.repeat(np.arange(len(hit)), k), np.searchsorted(hit, rows)])
        dist, place, at = (np.concatenate([old[hit].ravel(), new]) for old, new in ((self.dist, dist), (self.place, place), (self.at, at)))
        order = np.lexsort((place, dist, group))
        first = np.searchsorted(group[order], np.arange(len(hit)))
        keep = order[first[:, None] + np.arange(k)]
        self.dist[hit], self.place[hit], self.at[hit] = dist[keep], place[keep], at[keep]

    def table(self, ids: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(self.at >= 0)
        return pd.DataFrame({"id": ids[r], "nbr": others[self.at[r, c]], "dist": self.dist[r, c]})


def screen(metric: str, a: np.ndarray, b: np.ndarray):
    """Nearly the distances of all pairs, in a measure of their own: (function of the slices of a
    and b that gives them and the error bounds of both sides, function that turns distances into the measure)."""
    if metric == "euclidean":
        x, y = centred(a, b)
        return lambda i, j: squared_products(x[i], y[j]), lambda d: d * d * (1 + 1e-12)
    if metric in ("manhattan", "cityblock"):
        return lambda i, j: manhattan_single(a[i], b[j]), lambda d: d * (1 + 1e-6)
    dist = distance_fn(metric)
    return lambda i, j: (dist(a[i], b[j]), np.zeros(len(a[i])), np.zeros(len(b[j]))), lambda d: d


def _limits(near: np.ndarray, best: np.ndarray, k: int, to_measure, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """What a row of ``near`` may measure at most to be among the k nearest."""
    known = best[:, -1]
    out = to_measure(known) + mine + theirs.max(initial=0.0)
    fresh = np.isinf(known)
    if fresh.any() and near.shape[1] >= k:
        out[fresh] = np.partition(near[fresh], k - 1, axis=1)[:, k - 1] + 2 * (mine[fresh] + theirs.max(initial=0.0))
    return out


def search(a: np.ndarray, b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray, k: int, metric: str,
           same: bool, step: int, both: bool = True, reach: np.ndarray | None = None) -> tuple[Best, Best | None]:
    """The k nearest rows of ``b`` of every row of ``a`` and, with ``both``, the other way round; ``same``: both
    are one set, and no row counts itself. Nothing farther than a row's ``reach`` is wanted."""
    mine, theirs = Best(len(a), k), Best(len(b), k) if both and not same else None
    nearly, to_measure = screen(metric, a, b)
    exact = metric in ("euclidean", "manhattan", "cityblock")
    bound = np.full(len(a), np.inf) if reach is None else to_measure(reach)
    for i in chunks(len(a), step):
        for j in chunks(len(b), step):
            if same and j.start < i.start:
                continue
            near, ea, eb = nearly(i, j)
            if same and i == j:
                np.fill_diagonal(near, np.inf)
            jobs = [(near, mine, i, j, ea, eb, place_b, False)]
            if same and i != j:
                jobs.append((near.T, mine, j, i, eb, ea, place_a, True))
            elif theirs is not None:
                jobs.append((near.T, theirs, j, i, eb, ea, place_a, True))
            for d, best, own, other, e1, e2, place, turned in jobs:
                limit = _limits(d, best.dist[own], k, to_measure, e1, e2)
                if not turned:
                    limit = np.minimum(limit, bound[own] + e1 + e2.max(initial=0.0))
                c, r = np.nonzero(near <= limit) if turned else np.nonzero(near <= limit[:, None])[::-1]
                if same and i == j:
                    r, c = r[r != c], c[r != c]
                if not len(r):
                    continue
                if exact:
                    dist = apart(b if turned else a, a if turned else b, r + own.start, c + other.start, metric)
                else:
                    dist = d[r, c]
                if not turned and reach is not None:
                    keep = dist <= reach[own][r] * (1 + 1e-9)
                    r, c, dist = r[keep], c[keep], dist[keep]
                best.add(r + own.start, c + other.start, dist, place[c + other.start])
    return mine, theirs


def _plain_block(a, b, ia, ib, k: int, metric: str, same: bool, step: int) -> pd.DataFrame:
    """The same from whole sorted distances, for numbers that are not finite."""
    dist = distance_fn(metric)
    outs = [pd.DataFrame({"id": ia[:0], "nbr": ib[:0], "dist": np.zeros(0)})]

    def best(x, y, others, ids, own):
        d = dist(x, y)
        itself = np.zeros(d.shape, bool)                                 # last, after distances that are no numbers
        if own is not None:
            itself[np.arange(len(x)), np.arange(own.start, own.stop)] = True
        kk = min(k, len(y) - (own is not None))
        if kk > 0:
            place = np.broadcast_to(np.unique(others, return_inverse=True)[1], d.shape)
            order = np.lexsort((place, d, itself), axis=1)[:, :kk]
            outs.append(pd.DataFrame({"id": np.repeat(ids, kk), "nbr": others[order.ravel()], "dist": np.take_along_axis(d, order, 1).ravel()}))

    for s in chunks(len(a), max(1, step // 8)):
        best(a[s], b, ib, ia[s], s if same else None)
    if not same:
        for s in chunks(len(b), max(1, step // 8)):
            best(b[s], a, ia, ib[s], None)
    return pd.concat([o for o in outs if len(o)] or outs, ignore_index=True)


def _topk_block(k: int, metric: str, step: int = DEFAULT_TILE_ROWS):
    def block(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        ia, ib = a["_id"].to_numpy(), b["_id"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"id": ia[:0], "nbr": ib[:0], "dist": np.zeros(0)})
        x = stack(a["_vec"])
        y = x if same else stack(b["_vec"])
        if not (np.isfinite(np.abs(x).sum() ** 2) and np.isfinite(np.abs(y).sum() ** 2)):
            return _plain_block(x, y, ia, ib, k, metric, same, step)
        pa, pb = (np.unique(ids, return_inverse=True)[1] for ids in (ia, ib))       # texts can't be sorted beside numbers
        mine, theirs = search(x, y, pa, pb, k, metric, same, step)
        outs = [mine.table(ia, ib)] + ([theirs.table(ib, ia)] if theirs else [])
        return pd.concat([o for o in outs if len(o)] or outs[:1], ignore_index=True)

    return block


def knn(df: DataFrame, id_col: str, features, k: int = 5, metric: str = "euclidean",
        tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """(id, nbr, dist, rank) -- the exact k nearest other points of every
    point, rank 1 = nearest, ties broken by neighbour id. Ids are of any type that sorts; rows
    without an id, and vectors that are null or hold a null, take no part."""
    kind = id_kind(df, id_col)
    pts = df.select(qcol(id_col).cast(kind).alias("_id"), vector_col(df, features)) \
        .where(F.col("_id").isNotNull() & F.col("_vec").isNotNull() & F.forall("_vec", lambda x: x.isNotNull()))
    cand = apply_tiles(pts, "_id", _topk_block(k, metric, tile_rows), f"id {kind}, nbr {kind}, dist double", tile_rows,
                       whole=True)
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_distances(df: DataFrame, id_col: str, features, ids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """N0 for chosen pairs: (id, nbr, dist) for the (id, nbr) rows of ``ids``
    (two keyed joins, then an array expression; no cross product)."""
    pts = df.select(qcol(id_col).cast("long").alias("_pid"), vector_col(df, features))
    a = ids.join(pts.withColumnRenamed("_pid", "id").withColumnRenamed("_vec", "_va"), "id") \
        .join(pts.withColumnRenamed("_pid", "nbr").withColumnRenamed("_vec", "_vb"), "nbr")
    if metric == "euclidean":
        d = F.sqrt(F.aggregate(F.zip_with("_va", "_vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                               lambda acc, v: acc + v))
    elif metric in ("manhattan", "cityblock"):
        d = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)
    else:
        raise ValueError(f"pair_distances supports euclidean/manhattan, not {metric!r}")
    return a.select("id", "nbr", d.alias("dist"))


def _canonical(e: DataFrame) -> DataFrame:
    """Undirected edges as (a < b), self loops and duplicates removed."""
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) \
        .where(F.col("a") != F.col("b")).distinct()


def _fingerprint(e: DataFrame) -> tuple:
    """Identifies a set of edges by its count and two mixes of their hashes:
    one pass without a shuffle of the edges."""
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, vertices: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) with component = smallest id reachable.

    Alternating large-star / small-star rounds on the edge list (Kiveris et
    al., "Connected Components in MapReduce and Beyond", 2014): each round
    is two group-bys over the edges, the edge count never grows, and the
    graph converges to one star per component centred on its smallest id
    in O(log^2 n) rounds -- independent of the component diameter. State is
    checkpointed to the shared folder each round (reliable under executor
    loss; no local checkpoints)."""
    e = cut_lineage(_canonical(edges.select(F.col("src").cast("long").alias("a"),
                                            F.col("dst").cast("long").alias("b"))))
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every neighbour larger than u hooks to min(N(u) + u)
        m_all = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _canonical(both.join(m_all, "a").where(F.col("b") > F.col("a"))
                           .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = cut_lineage(large)
        # small star: u and its smaller neighbours hook to min(smaller N(u) + u)
        lower = large.select(F.col("b").alias("u"), F.col("a").alias("v"))     # v < u
        m_low = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = _canonical(lower.join(m_low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                           .unionByName(m_low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        small = cut_lineage(small)
        before, seen, e = seen, _fingerprint(small), small
        if before == seen:
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    # converged: stars (centre, member) with the centre the component minimum
    comp = e.select(F.col("b").alias("id"), F.col("a").alias("component")) \
        .unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component"))) \
        .groupBy("id").agg(F.min("component").alias("component"))
    v = vertices.select(F.col("id").cast("long")).distinct()
    return v.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
