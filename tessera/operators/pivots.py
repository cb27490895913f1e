"""Exact nearest neighbours that skip what the triangle inequality rules out.

Any number of dimensions, Euclidean or Manhattan. At most ``max_pivots`` rows, chosen by a hash,
are pivots; every row lies in the cell of its nearest pivot, and a cell is cut by hash
into tiles of about ``tile_rows`` rows. A row first looks through its own tile, which bounds the
distance of its last neighbour. It then visits only cells that can hold something as near: a
cell with pivot p and radius r holds nothing nearer to x than d(x, p) - r, nor, as its rows
are nearer to p than to x's own pivot q, than (d(x, p) - d(x, q)) / 2. Tiles of neighbouring cells lie in one group of bounded rows
(:class:`tessera.functions.cells.Groups`): a row is copied once a group it visits, and
goes through the cells within reach there. Visitors of a group are counted
first and spread over chunks, so that a task holds about two groups of rows.

Equal vectors are searched for once: of each vector only the k + 1 smallest ids can be in
anybody's list, and all its rows share one list. A vector held by a third of the rows
thus costs one search.

The driver holds pivots, radii and row counts of cells: ``max_pivots`` rows of d numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frame import qcol
from tessera.functions.cells import BATCH, SLACK, Groups, pivot_distances
from tessera.functions.pairs import DEFAULT_TILE_ROWS, chunks, stack, vector_col
from tessera.operators.neighbors import Best, id_kind, search
from tessera.session import cut_lineage, ship_package

#: Metrics that keep the triangle inequality.
METRICS = ("euclidean", "manhattan", "cityblock")


class _Search:
    """Cells, own tiles and visits of one search; lists hold k + 1 rows, the row itself included."""

    def __init__(self, df: DataFrame, id_col: str, features, k: int, metric: str, tile_rows: int,
                 max_pivots: int, probes: int | None):
        if metric not in METRICS:
            raise ValueError(f"{metric!r} keeps no triangle inequality; use one of {METRICS}")
        if k < 1 or tile_rows < 1 or max_pivots < 1 or (probes is not None and probes < 1):
            raise ValueError("k, tile_rows, max_pivots and probes start from 1")
        ship_package(df.sparkSession)
        self.spark, self.kind, self.probes = df.sparkSession, id_kind(df, id_col), probes
        self.size, self.tile_rows, self.dist, self.metric = k + 1, tile_rows, pivot_distances(metric), metric
        pts = df.select(qcol(id_col).cast(self.kind).alias("_id"), vector_col(df, features))
        usable = F.col("_id").isNotNull() & F.col("_vec").isNotNull() \
            & F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
        self.points = cut_lineage(pts.where(usable))
        place = Window.partitionBy("_vec").orderBy("_id")
        members = cut_lineage(self.points.withColumn("_r", F.row_number().over(place))
                              .where(F.col("_r") <= self.size))
        self.members = members
        self.rows = members.count()
        if self.rows:
            self._cells(members, min(max_pivots, math.ceil(self.rows / max(1, tile_rows // 2))))

    def _cells(self, members: DataFrame, n_cells: int) -> None:
        first = members.where(F.col("_r") == 1).orderBy(F.xxhash64("_id"), "_id").limit(n_cells)
        pivots = np.array([r["_vec"] for r in first.select("_vec").collect()], dtype=float)   # at most max_pivots rows
        dist = self.dist

        def assign(frames):
            for pdf in frames:
                if len(pdf):
                    d = dist(stack(pdf["_vec"]), pivots)
                    yield pdf.assign(_cell=d.argmin(1).astype("int32"), _own=d.min(1))

        placed = cut_lineage(members.mapInPandas(
            assign, f"_id {self.kind}, _vec array<double>, _r int, _cell int, _own double"))
        counts = np.zeros(len(pivots), dtype="int64")
        radius = np.full(len(pivots), math.inf)                           # of an empty cell
        for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_own").alias("r")).collect():
            counts[r["_cell"]], radius[r["_cell"]] = r["n"], r["r"]
        self.pivots, self.radius = pivots, radius
        self.groups = Groups(pivots, counts, self.tile_rows)
        self.subs = self.groups.subs
        cells = self.spark.createDataFrame([(i, int(s)) for i, s in enumerate(self.subs)], "_cell int, _subs long")
        self.tiles = placed.join(F.broadcast(cells), "_cell") \
            .withColumn("_sub", F.pmod(F.xxhash64("_id"), "_subs")).drop("_subs")
        self.own = cut_lineage(self._own_tiles())

    def _own_tiles(self) -> DataFrame:
        """One row for each different vector: its list within its tile and the distance of the last in it."""
        size, metric = self.size, self.metric

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            ask = pdf[pdf["_r"] == 1]
            if not len(ask):
                return ask.assign(_reach=0.0, _nbr=None, _dist=None).drop(columns="_r")
            ids = pdf["_id"].to_numpy()
            place = np.unique(ids, return_inverse=True)[1]
            best, _ = search(stack(ask["_vec"]), stack(pdf["_vec"]), place, place, size, metric, False, BATCH, both=False)
            there = [a >= 0 for a in best.at]
            return ask.assign(_reach=best.dist[:, -1], _nbr=[ids[a[t]] for a, t in zip(best.at, there)],
                              _dist=[d[t] for d, t in zip(best.dist, there)]).drop(columns="_r")

        return self.tiles.groupBy("_cell", "_sub").applyInPandas(
            block, f"_id {self.kind}, _vec array<double>, _cell int, _own double, _sub long, _reach double, "
                   f"_nbr array<{self.kind}>, _dist array<double>")

    def _reached(self):
        """(rows, cells) of a frame: which row of it visits which cell beside its own tile."""
        pivots, radius, subs, dist, probes = self.pivots, self.radius, self.subs, self.dist, self.probes

        def reached(pdf: pd.DataFrame):
            d = dist(stack(pdf["_vec"]), pivots)
            low = np.maximum(d - radius, (d - pdf["_own"].to_numpy()[:, None]) / 2)
            go = (low <= pdf["_reach"].to_numpy()[:, None] * (1 + SLACK) + SLACK * d) & (subs > 0)
            own = pdf["_cell"].to_numpy()
            go[np.arange(len(pdf)), own] &= subs[own] > 1                 # its own tile is done
            if probes is not None and probes < len(pivots):
                near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
                asked = np.zeros_like(go)
                np.put_along_axis(asked, near, True, axis=1)
                go &= asked
            return np.nonzero(go)

        return reached

    def visits(self) -> np.ndarray:
        """How many rows visit each cell."""
        reached, n = self._reached(), len(self.pivots)

        def count(frames):
            total = np.zeros(n, dtype="int64")
            for pdf in frames:
                if len(pdf):
                    total += np.bincount(reached(pdf)[1], minlength=n)
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"_to": hit.astype("int32"), "n": total[hit]})

        out = np.zeros(n, dtype="int64")
        for r in self.own.select("_vec", "_cell", "_own", "_reach").mapInPandas(count, "_to int, n long") \
                .groupBy("_to").agg(F.sum("n").alias("n")).collect():
            out[r["_to"]] = r["n"]
        return out

    def visited(self) -> DataFrame:
        """(_id, _nbr, _dist): what the visits find within reach, at most k + 1 rows a visited group."""
        reached, size, kind, metric, n = self._reached(), self.size, self.kind, self.metric, len(self.pivots)
        groups = self.groups
        member = groups.member

        def go(frames):
            for whole in frames:
                for s in chunks(len(whole), BATCH):
                    pdf = whole.iloc[s]
                    rows, cells = reached(pdf)
                    mask = np.zeros((len(pdf), n), np.float32)
                    mask[rows, cells] = 1.0
                    rows, to = np.nonzero(mask @ member > 0)
                    yield pdf.iloc[rows].assign(_to=to.astype("int32"))

        fields = f"_id {kind}, _vec array<double>, _cell int, _sub long, _own double, _reach double"
        own = self.own.select("_id", "_vec", "_cell", "_sub", "_own", "_reach")
        asking = own.mapInPandas(go, f"{fields}, _to int")
        chunked = [(r["_to"], math.ceil(r["n"] / groups.rows)) for r in own.select("_vec", "_cell", "_own", "_reach").mapInPandas(
            _counted(reached, member), "_to int, n long").groupBy("_to").agg(F.sum("n").alias("n")).collect()]
        sizes = F.broadcast(self.spark.createDataFrame(chunked, "_to int, _chunks long"))       # one row a group
        names = ["_id", "_vec", "_cell", "_sub", "_own", "_reach", "_to", "_chunk"]
        ask = asking.join(sizes, "_to").withColumn("_chunk", F.pmod(F.xxhash64("_id", F.lit(1)), "_chunks")).select(*names)
        hold = self.tiles.join(F.broadcast(groups.table(self.spark)), ["_cell", "_sub"]) \
            .select("_id", "_vec", "_cell", "_sub", F.lit(0.0).alias("_own"), F.lit(None).cast("double").alias("_reach"),
                    F.col("_group").alias("_to")).join(sizes, "_to") \
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).select(*names)

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["_reach"].notna()
            q, m = pdf[asks].reset_index(drop=True), pdf[~asks].reset_index(drop=True)
            ids = m["_id"].to_numpy()
            if not len(q) or not len(m):
                return pd.DataFrame({"_id": pdf["_id"][:0], "_nbr": pdf["_id"][:0], "_dist": np.zeros(0)})
            x, y, place = stack(q["_vec"]), stack(m["_vec"]), np.unique(ids, return_inverse=True)[1]
            best, reach = Best(len(q), size), q["_reach"].to_numpy()
            tile = m.groupby(["_cell", "_sub"]).indices
            visits = np.zeros((len(q), n), bool)
            for s in chunks(len(q), BATCH):
                rows, cells = reached(q.iloc[s])
                visits[rows + s.start, cells] = True
            for (c, sub), at in tile.items():
                go_ = visits[:, c] & ~((q["_cell"].to_numpy() == c) & (q["_sub"].to_numpy() == sub))    # its own tile is done
                rows = np.flatnonzero(go_)
                if len(rows):
                    found, _ = search(x[rows], y[at], place[at], place[at], size, metric, False, BATCH * 4, both=False,
                                      reach=np.minimum(reach, best.dist[:, -1])[rows])
                    r, p = np.nonzero(found.at >= 0)
                    best.add(rows[r], at[found.at[r, p]], found.dist[r, p], found.place[r, p])
            t = best.table(q["_id"].to_numpy(), ids)
            return pd.DataFrame({"_id": t["id"], "_nbr": t["nbr"], "_dist": t["dist"]})

        parts = max(1, sum(c for _, c in chunked))
        return ask.unionByName(hold).repartition(parts, "_to", "_chunk").groupBy("_to", "_chunk").applyInPandas(
            block, f"_id {kind}, _nbr {kind}, _dist double")


def _counted(reached, member: np.ndarray):
    """How many rows of a partition visit each group."""
    def count(frames):
        total = np.zeros(member.shape[1], dtype="int64")
        for whole in frames:
            for s in chunks(len(whole), BATCH):
                rows, cells = reached(whole.iloc[s])
                mask = np.zeros((min(s.stop, len(whole)) - s.start, len(member)), np.float32)
                mask[rows, cells] = 1.0
                total += (mask @ member > 0).sum(axis=0)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"_to": hit.astype("int32"), "n": total[hit]})

    return count


def knn_pruned(df: DataFrame, id_col: str, features, k: int = 5, metric: str = "euclidean",
               tile_rows: int = DEFAULT_TILE_ROWS, max_pivots: int = 1024, probes: int | None = None) -> DataFrame:
    """(id, nbr, dist, rank), the k nearest other rows of every row, ties to the smaller id.

    The same rows as ``neighbors.knn``, but cells out of reach are never compared.
    ``probes`` makes it approximate: a row visits at most its ``probes`` nearest cells.
    Ids are of any type that sorts, and unique. Rows without an id, and vectors that are null or
    hold a null, NaN or infinite number, take no part. An empty table gives no rows; a row
    has fewer than k neighbours where there are fewer other rows."""
    s = _Search(df, id_col, features, k, metric, tile_rows, max_pivots, probes)
    schema = f"id {s.kind}, nbr {s.kind}, dist double, rank int"
    if not s.rows:
        return s.spark.createDataFrame([], schema)
    found = s.own.select("_id", F.inline(F.arrays_zip("_dist", "_nbr"))).unionByName(s.visited())
    place = Window.partitionBy("_id").orderBy("_dist", "_nbr")
    lists = found.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= s.size) \
        .groupBy(F.col("_id").alias("_rep")).agg(F.sort_array(F.collect_list(F.struct("_dist", "_nbr"))).alias("_list"))
    reps = s.members.where(F.col("_r") == 1).select(F.col("_id").alias("_rep"), "_vec")
    mine = s.points.join(reps, "_vec").select("_id", "_rep").join(lists, "_rep") \
        .select("_id", F.slice(F.filter("_list", lambda x: x["_nbr"] != F.col("_id")), 1, k).alias("_list"))
    return mine.select(F.col("_id").alias("id"), F.posexplode("_list").alias("_p", "_x")) \
        .select("id", F.col("_x._nbr").alias("nbr"), F.col("_x._dist").alias("dist"), (F.col("_p") + 1).cast("int").alias("rank"))


def visit_share(df: DataFrame, id_col: str, features, k: int = 5, metric: str = "euclidean",
                tile_rows: int = DEFAULT_TILE_ROWS, max_pivots: int = 1024) -> float:
    """The share of (row, tile) comparisons that an exact search makes, own tiles included."""
    s = _Search(df, id_col, features, k, metric, tile_rows, max_pivots, None)
    if not s.rows:
        return 0.0
    asking, visits = s.own.count(), s.visits()
    return float((visits * s.subs).sum() + asking) / float(asking * s.subs.sum())
