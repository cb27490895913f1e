"""Operator 4: exact top-k inner products by columnar branch and bound.

Vectors are turned into integers floor(scale * x). Queries are dealt into
blocks and candidates into chunks; every (query block, candidate chunk) pair
is one group of a grouped pandas function. Within a group the chunk lies in
vertical layout (dimensions x vectors). Partial products are summed one block of
dimensions at a time; after each block a candidate survives for a query
only if its partial sum plus the largest product that the remaining
dimensions allow (Cauchy-Schwarz on the remaining masses) still reaches the
query's threshold, and the survivors are compacted. The threshold starts at
the k-th best score against a small set of candidates that all groups share
and rises within a group, so it never exceeds the true k-th best score: no
result is lost.

Each group returns k rows per query at most; the best of all chunks are picked
in a second step. Group sizes are bounded by ``query_block`` and ``chunk``.

Semantics: vectors that are null, empty or hold a null or non-finite component
take no part, nor do rows without an id; vectors of another length than a query
are not its candidates; rows equal in id and vector count once; rows that share
the query's id are never its candidates; equal scores go to the smaller id.
Integer sums beyond 64 bits raise OverflowError."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
QUERY_BLOCK = 512
CHUNK = 8192
DIMS_AT_ONCE = 16
SEEDS = 2048                   # candidates that give every query its first threshold


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(True))) \
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of both fit a double exactly."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top >= 2 ** 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return top < 2 ** 53


def _keep_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def branch_and_bound(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, floor: np.ndarray, k: int,
                     step: int = DIMS_AT_ONCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best (scores, ids) of one chunk that reach
    ``floor``, a lower bound of its k-th best score."""
    kind = np.float64 if _exact(q, c) else np.int64
    # dimensions with most mass first, so that the remaining mass falls quickly
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(0), kind="stable")
    qs, cols = q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))
    blocks = [slice(i, min(i + step, c.shape[1])) for i in range(0, c.shape[1], step)]

    def rest(m: np.ndarray) -> np.ndarray:
        """Square roots of what remains after each block, a little too large."""
        mass = np.stack([(m[b].astype(np.float64) ** 2).sum(0) for b in blocks])
        return np.sqrt(np.cumsum(mass[::-1], 0)[::-1] - mass) * (1 + 1e-9) + 1e-6

    c_rest, q_rest = rest(cols), rest(np.ascontiguousarray(qs.T))
    first = qs[:, blocks[0]] @ cols[blocks[0]]
    found = []
    for i in range(len(qs)):
        low = float(floor[i])
        live = np.flatnonzero((first[i] + q_rest[0, i] * c_rest[0] >= low) & (c_ids != q_ids[i]))
        part = first[i, live]
        for n, b in enumerate(blocks[1:], 1):
            if len(live) > k:                          # the k-th best sure score may beat the first threshold
                sure = part - q_rest[n - 1, i] * c_rest[n - 1, live]
                low = max(low, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
                stay = part + q_rest[n - 1, i] * c_rest[n - 1, live] >= low
                live, part = live[stay], part[stay]
            part = part + qs[i, b] @ cols[b][:, live]
        found.append(_keep_best(part.astype(np.int64), c_ids[live], k))
    return found


def search(df: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, chunk: int = CHUNK,
           seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score) of two frames (id, v): the k best rows of
    ``df`` for every row of ``queries``."""
    n, nq = df.count(), queries.count()
    n_chunks, n_blocks = max(1, math.ceil(n / chunk)), max(1, math.ceil(nq / query_block))
    # rows with the smallest hashes: bounded by a parameter, shared by all groups for the first thresholds
    start = df.select("id", "v", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h", "id").limit(seeds).select("id", "v").collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["v"]) for r in start}:
        rows = [r for r in start if len(r["v"]) == size]
        by_size[size] = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(by_size)

    def deal(x: DataFrame, own: str, parts: int, other: str, others: int, is_query: bool) -> DataFrame:
        # dealt by id and contents, which are distinct: neither a hot id nor a hot vector gathers in one chunk
        where = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
        return x.select("id", "v", F.size("v").alias("dims"), F.lit(is_query).alias("is_query"), where.alias(own)) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))) \
            .select("id", "v", "dims", "is_query", "block", "chunk")

    both = deal(queries, "block", n_blocks, "chunk", n_chunks, True) \
        .unionByName(deal(df, "chunk", n_chunks, "block", n_blocks, False))

    def work(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        is_query = f["is_query"].to_numpy()
        q, c = f[is_query], f[~is_query]
        if len(q) and len(c):
            qv, cv = np.stack(q["v"].to_list()).astype(np.int64), np.stack(c["v"].to_list()).astype(np.int64)
            q_ids, c_ids = q["id"].to_numpy(), c["id"].to_numpy()
            floor = np.full(len(q), -np.inf)
            seed_ids, seed = shared.value.get(qv.shape[1], (None, None))
            if seed is not None:
                s = qv.astype(np.float64) @ seed.T.astype(np.float64) if _exact(qv, seed) else qv @ seed.T
                for i in range(len(q)):
                    own = s[i][seed_ids != q_ids[i]]
                    if len(own) >= k:
                        floor[i] = np.partition(own, len(own) - k)[len(own) - k]
            for i, (scores, ids) in zip(q_ids, branch_and_bound(qv, q_ids, cv, c_ids, floor, k)):
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    near = both.groupBy("block", "chunk", "dims").applyInPandas(work, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The k best other rows for every row whose id is divisible by ``every``."""
    rows = quantised(df, id_col, vec_col).distinct()
    return search(rows, rows.where(F.col("id") % every == 0), k)


def oracle(every: int = 50, k: int = 5) -> str:
    """DuckDB SQL for :func:`top_k` (ids unique)."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
