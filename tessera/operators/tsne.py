"""The descent of t-SNE (D7): van der Maaten's gradient descent with momentum and gains.

Rows are dealt to blocks as in :mod:`tessera.functions.blockgraph`; a block is one row of bytes: the affinities of its rows,
packed once. A step is one cogroup: a block gets the positions of all blocks (a few numbers a row of the table), moves its own rows and
sends their new positions. The pull of the neighbours is summed over the block's affinities. The push of all rows
comes from a grid: masses are spread on its nodes and multiplied with the kernels by Fourier transforms (Linderman et al.,
"Fast interpolation-based t-SNE", 2019), so a step grows with the rows, not with their pairs; where the pairs are
fewer than what the grid would cost, they are summed themselves."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.blockgraph import block_count, block_keys, dealt
from tessera.session import cut_lineage, planned_once, ship_package

BLOCK_ROWS = 1 << 14                                 # rows worth a block: fewer take less time than Spark takes for a step
ENTRIES = 1 << 19                                    # affinities that are summed at once
SPACING, NODES, PADDED = 0.25, 32, 1 << 24           # of the grid: widest spacing, least nodes along the longest side, most nodes
CUT = 25                                             # steps that one job makes
CHECK = 50                                           # steps between two looks at the error (a multiple of CUT)

_HOLD = "block int, ids binary, mult binary, starts binary, cols binary, vals binary"
_FRAME = "to int, src int, data binary, grad double, error double"
_kernels: dict = {}                                  # of the last grid of this worker


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def degrees(dims: int) -> int:
    """Degrees of freedom of the t-distribution in the layout."""
    return max(dims - 1, 1)


def _pair_push(own: np.ndarray, all_: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, float]:
    """What :func:`push` returns, from all pairs."""
    dof = degrees(all_.shape[1])
    rows = max(1, (1 << 18) // max(1, len(all_)))
    weighted = np.column_stack([mass, all_ * mass[:, None]])
    norms = (all_ * all_).sum(1)

    def similar(y):
        near = y @ (all_.T * (-2 / dof))
        near += 1 + (y * y).sum(1)[:, None] / dof
        near += norms / dof
        np.maximum(near, 1.0, out=near)
        return near, 1 / near if dof == 1 else near ** (-(dof + 1) / 2)

    total, out = 0.0, np.empty(own.shape)
    for s in range(0, len(own), rows):
        near, w = similar(own[s:s + rows])
        if len(own) == len(all_):                                    # one block: own are all
            total += float(mass[s:s + rows] @ (w @ mass))
        w /= near
        sums = w @ weighted
        out[s:s + rows] = own[s:s + rows] * sums[:, :1] - sums[:, 1:]
    if len(own) != len(all_):
        total = sum(float(mass[s:s + rows] @ (similar(all_[s:s + rows])[1] @ mass)) for s in range(0, len(all_), rows))
    return out, total - mass.sum()


def _lagrange(u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first of the four nodes around every place, and the cubic weights of the four."""
    base = np.floor(u).astype(np.int64)
    t = u - base
    return base - 1, [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]


def _even(n: int) -> int:
    """The next number from ``n`` on that is quick to transform."""
    return min(m for p in range(0, 5) for q in range(0, 3) for m in [3 ** p * 5 ** q * 2 ** max(1, math.ceil(math.log2(max(1, n / (3 ** p * 5 ** q)))))])


def _transformed(shape: tuple[int, ...], h: float, dof: int) -> list[np.ndarray]:
    """Fourier transforms of the kernels on a padded grid: the similarity, and the push along each axis."""
    key = shape, h, dof
    if key not in _kernels:
        _kernels.clear()
        at = np.meshgrid(*[((np.arange(m) + m // 2) % m - m // 2) * h for m in shape], indexing="ij", sparse=True)
        near = 1 + sum(a * a for a in at) / dof
        far = near ** (-(dof + 3) / 2)
        _kernels[key] = [np.fft.rfftn(near ** (-(dof + 1) / 2))] + [np.fft.rfftn(a * far) for a in at]
    return _kernels[key]


def push(own: np.ndarray, all_: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, float]:
    """(sums over all rows of mass x push on each of ``own``, sum of the similarities of all pairs of rows, none with itself)."""
    dims = all_.shape[1]
    low = all_.min(axis=0)
    span = all_.max(axis=0) - low
    if dims > 3 or len(all_) < 64 or not np.isfinite(span).all() or not span.max() > 0:
        return _pair_push(own, all_, mass)
    h = SPACING * 2.0 ** min(0, math.floor(math.log2(span.max() / (NODES * SPACING))))

    def padded(h):
        return tuple(_even(2 * (int(x / h) + 5)) for x in span)

    shape = padded(h)
    if len(all_) ** 2 <= 2 * math.prod(shape):
        return _pair_push(own, all_, mass)
    while math.prod(shape) > PADDED:
        h *= 2
        shape = padded(h)
    half = tuple(m // 2 for m in shape)
    strides = [math.prod(half[a + 1:]) for a in range(dims)]

    def spread(y):
        """For each of the nodes around every row: their numbers and weights."""
        parts = [_lagrange((y[:, a] - low[a]) / h + 1) for a in range(dims)]
        first = sum(p[0] * s for p, s in zip(parts, strides))
        for corner in itertools.product(range(4), repeat=dims):
            yield first + sum(c * s for c, s in zip(corner, strides)), math.prod(p[1][c] for p, c in zip(parts, corner))

    size = math.prod(half)
    charge = np.zeros(size)
    for node, weight in spread(all_):
        charge += np.bincount(node, weights=weight * mass, minlength=size)
    every = tuple(range(dims))
    wave = np.fft.rfftn(charge.reshape(half), shape, every)
    inner = tuple(slice(0, m) for m in half)
    fields = [np.fft.irfftn(wave * k, shape, every)[inner].ravel() for k in _transformed(shape, h, degrees(dims))]
    out = np.zeros(own.shape)
    for node, weight in spread(own):
        for a in range(dims):
            out[:, a] += weight * fields[a + 1][node]
    return out, float(charge @ fields[0]) - mass.sum()


def pull(own: np.ndarray, all_: np.ndarray, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, float]:
    """(sums of affinity x pull on each of ``own``, sum of affinity x log(affinity / similarity))."""
    dims = all_.shape[1]
    dof = degrees(dims)
    out, error = np.zeros(own.shape), 0.0
    axes = [np.ascontiguousarray(all_[:, a]) for a in range(dims)]
    a = 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + ENTRIES, side="right")) - 1)
        n, s = np.diff(starts[a:b + 1]), slice(starts[a], starts[b])
        if s.stop > s.start:
            gaps = [np.repeat(own[a:b, x], n) - axes[x][cols[s]] for x in range(dims)]
            near = 1 + sum(g * g for g in gaps) / dof
            w = vals[s] / near
            some = np.flatnonzero(n)
            for x, g in enumerate(gaps):
                out[a + some, x] = np.add.reduceat(w * g, starts[a:b][some] - s.start)
            error += float(vals[s] @ (np.log(np.maximum(vals[s], np.finfo("f4").tiny)) + (dof + 1) / 2 * np.log(near)))
        a = b
    return out, error


def _messages(number: int, y: np.ndarray, mult: np.ndarray, keys: list[int], repeated: bool) -> list[tuple]:
    """The positions of a block for every block, with how often each row occurs if that is not always once."""
    data = _raw(np.column_stack([y, mult]) if repeated else y, "f8")
    return [(t, number, data, 0.0, 0.0) for t in keys]


class Descent:
    """Rows ``start`` (id long, mult long, y array<double>: where they begin) with affinities ``edges`` (i, j, w), whose two
    directions are both given and equal ones added up; they are scaled to add up to 1."""

    def __init__(self, edges: DataFrame, start: DataFrame, dims: int, rate: float):
        spark = start.sparkSession
        ship_package(spark)
        self.dims, self.rate = dims, float(rate)
        start = cut_lineage(start)
        n, most = start.agg(F.count(F.lit(1)), F.max("mult")).first()
        self.repeated = (most or 1) > 1
        self.blocks = block_count(n, BLOCK_ROWS, spark.sparkContext.defaultParallelism)
        self.keys = block_keys(spark, self.blocks)
        place = Window.partitionBy("block").orderBy("id")
        index = cut_lineage(start.withColumn("block", dealt(self.keys))
                            .withColumn("pos", (F.row_number().over(place) - 1).cast("int")))
        sizes = {r["block"]: r["n"] for r in index.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        before = {k: sum(sizes.get(b, 0) for b in self.keys if b < k) for k in self.keys}
        first = F.element_at(F.create_map(*[F.lit(x).cast("int") for kv in before.items() for x in kv]), F.col("block"))
        placed = cut_lineage(edges.where("i <> j AND w > 0 AND NOT isnan(w)").join(index.select(F.col("id").alias("i"), "block", "pos"), "i")
                             .join(index.select(F.col("id").alias("j"), (first + F.col("pos")).cast("int").alias("col")), "j")
                             .select("block", "pos", "col", "w"))
        self.total = float(placed.agg(F.sum("w")).first()[0] or 0.0)
        total = self.total

        def pack(key: tuple, mine: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            mine = mine.sort_values("pos")
            pos, col, w = (entries[c].to_numpy() for c in ("pos", "col", "w"))
            order = np.lexsort((col, pos))
            pos, col, w = pos[order], col[order], w[order]
            new = np.flatnonzero(np.append(True, (np.diff(pos) != 0) | (np.diff(col) != 0))) if len(pos) else np.zeros(0, np.int64)
            vals = np.add.reduceat(w, new) / total if len(new) else w
            return pd.DataFrame([{"block": int(key[0]), "ids": _raw(mine["id"], "i8"), "mult": _raw(mine["mult"], "i8"),
                                  "starts": _raw(np.searchsorted(pos[new], np.arange(len(mine) + 1)), "i8"),
                                  "cols": _raw(col[new], "i4"), "vals": _raw(vals, "f4")}])

        def begin(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
            y = np.stack(mine.sort_values("pos")["y"].to_list()).astype("f8")
            return pd.DataFrame([{"to": int(key[0]), "src": -1, "data": _raw(np.hstack([y, np.zeros(y.shape), np.ones(y.shape)]), "f8"),
                                  "grad": 0.0, "error": 0.0}])

        held = cut_lineage(index.select("block", "pos", "id", "mult").groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(pack, _HOLD))
        self.frame = cut_lineage(index.select("block", "pos", "y").groupBy("block").applyInPandas(begin, _FRAME))
        with planned_once(spark):
            self.hold = cut_lineage(held.repartition(self.blocks, "block"))

    def _announced(self, frame: DataFrame) -> DataFrame:
        """A frame without messages, with the positions of its rows sent to all blocks."""
        dims, keys, repeated = self.dims, self.keys, self.repeated

        def work(key: tuple, hold: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            mult, number, data = np.frombuffer(hold.iloc[0]["mult"], "i8"), int(key[0]), got.iloc[0]["data"]
            y = np.frombuffer(data, "f8").reshape(len(mult), -1)[:, :dims]
            return pd.DataFrame([(number, -1, data, 0.0, 0.0), *_messages(number, y, mult, keys, repeated)],
                                columns=["to", "src", "data", "grad", "error"])

        return self.hold.groupBy("block").cogroup(frame.groupBy("to")).applyInPandas(work, _FRAME)

    def _step(self, frame: DataFrame, more: float, momentum: float, send: bool, times: int = 1) -> DataFrame:
        """One step; ``times`` steps at once where one block holds all rows and needs no messages."""
        dims, rate, keys, repeated = self.dims, self.rate, self.keys, self.repeated
        dof = degrees(dims)

        def work(key: tuple, hold: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            number, block = int(key[0]), hold.iloc[0]
            mult, starts, cols, vals = (np.frombuffer(block[c], k) for c, k in (("mult", "i8"), ("starts", "i8"), ("cols", "i4"), ("vals", "f4")))
            weight = float(vals.sum(dtype=float))
            got = got.sort_values("src")["data"].to_list()                                 # the block itself comes first
            state = np.frombuffer(got[0], "f8").reshape(len(mult), 3 * dims)
            y, update, gains = (state[:, a * dims:(a + 1) * dims] for a in range(3))
            for _ in range(times):
                if len(keys) == 1:
                    all_, mass = y, mult.astype(float)
                else:
                    sent = np.frombuffer(b"".join(got[1:]), "f8").reshape(-1, dims + repeated)
                    all_, mass = sent[:, :dims], sent[:, dims] if repeated else np.ones(len(sent))
                near, error = pull(y, all_, starts, cols, vals)
                away, z = push(y, all_, mass)
                z = max(z, np.finfo(float).tiny)
                grad = 2 * (dof + 1) / dof * (more * near - away / z)
                error = more * (error + weight * math.log(more * z))
                gains = np.maximum(np.where(update * grad < 0, gains + 0.2, gains * 0.8), 0.01)
                grad = grad * gains
                update = momentum * update - rate * grad
                y = y + update
            out = [(number, -1, _raw(np.hstack([y, update, gains]), "f8"), float((grad * grad).sum()), error)]
            if send:
                out += _messages(number, y, mult, keys, repeated)
            return pd.DataFrame(out, columns=["to", "src", "data", "grad", "error"])

        return self.hold.groupBy("block").cogroup(frame.groupBy("to")).applyInPandas(work, _FRAME)

    def run(self, steps: int, more: float, momentum: float, patience: int, least: float) -> int:
        """At most ``steps`` steps with all affinities ``more`` times as large, from rest: how many were made. It ends early when the
        gradient is shorter than ``least`` or the error didn't fall for ``patience`` steps."""
        spark, dims = self.hold.sparkSession, self.dims

        def rest(data: bytes) -> bytes:
            state = np.frombuffer(data, "f8").reshape(-1, 3 * dims)
            return _raw(np.hstack([state[:, :dims], np.zeros((len(state), dims)), np.ones((len(state), dims))]), "f8")

        def resting(it):
            for pdf in it:
                yield pdf.assign(data=[rest(x) for x in pdf["data"]])

        best, at, done = math.inf, 0, 0
        with planned_once(spark, self.blocks):
            self.frame = cut_lineage(self.frame.mapInPandas(resting, _FRAME))
            while done < steps:
                now = min(CUT, steps - done)
                if self.blocks == 1:
                    frame = self._step(self.frame, more, momentum, False, now)
                else:
                    frame = self._announced(self.frame)
                    for s in range(now):
                        frame = self._step(frame, more, momentum, s + 1 < now)
                self.frame = cut_lineage(frame)
                done += now
                del frame
                spark.sparkContext._jvm.System.gc()          # shuffles behind the checkpoint are removed
                if done % CHECK:
                    continue
                grad, error = self.frame.agg(F.sum("grad"), F.sum("error")).first()
                if error < best:
                    best, at = error, done
                elif done - at > patience:
                    break
                if math.sqrt(grad) <= least:
                    break
        return done

    def table(self) -> DataFrame:
        """(id, y): where the rows are now."""
        dims = self.dims

        def work(key: tuple, hold: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            ids = np.frombuffer(hold.iloc[0]["ids"], "i8")
            return pd.DataFrame({"id": ids, "y": list(np.frombuffer(got.iloc[0]["data"], "f8").reshape(len(ids), 3 * dims)[:, :dims])})

        return self.hold.groupBy("block").cogroup(self.frame.groupBy("to")).applyInPandas(work, "id long, y array<double>")
