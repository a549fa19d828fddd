"""Exact nearest-centroid assignment and exact k nearest neighbours.

Centroids are the small side: k * d doubles, held on the driver and broadcast,
with their size checked. Vectors stream through in Arrow batches and never
shuffle. Where neither side is small, both are dealt into blocks, each pair of
blocks is one task, and the best of every block are merged. The relational
forms express the same joins with DataFrame operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, CENTROID_BLOCK, require
from ..functions import vectors as V

#: Vectors worked on at once: with a block of centroids, 32 MB of distances.
SLICE = 4096
#: Bytes of doubles in a block of either side of a search between two large tables.
BLOCK_BYTES = 32 << 20


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column as rows x d doubles."""
    flat = column.flatten()
    require(len(flat) == len(column) * d, f"vectors must have width {d}")
    return np.asarray(flat, dtype=np.float64).reshape(len(column), d)


def collected(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centroid ids and matrix, ordered by id, as arrays from the start."""
    rows = centroids.select("cid", "centroid").toArrow().combine_chunks()
    ids, flat = np.asarray(rows["cid"]).astype(np.int32), np.asarray(rows["centroid"].combine_chunks().flatten(), dtype=np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1 if len(ids) else 0)[order]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row of the nearest centroid; the lowest row wins ties. Blocks of centroids bound the memory."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for k in range(0, len(c), CENTROID_BLOCK):
        part = c[k : k + CENTROID_BLOCK]
        d2 = x @ (-2.0 * part.T)  # short of the vectors' own lengths, which rank nothing
        d2 += (part * part).sum(axis=1)
        j = d2.argmin(axis=1)
        v = d2[rows, j]
        if np.isnan(v).any():
            np.nan_to_num(d2, copy=False, nan=np.inf)
            j = d2.argmin(axis=1)
            v = d2[rows, j]
        better = v < best
        best[better], at[better] = v[better], j[better] + k
    return at


def assign(df: DataFrame, ids: np.ndarray, c: np.ndarray) -> DataFrame:
    """(vec_id, cid, d2) of each vector, by matrix products on Arrow batches. Narrow: no shuffle. Too many centroids to broadcast: `assign_blocks`."""
    require(c.ndim == 2 and len(c) > 0, "n_clusters must be positive")
    require(c.nbytes <= BROADCAST_BYTES, "too many centroids to broadcast; use assign_blocks")
    shared = df.sparkSession.sparkContext.broadcast((ids, c))

    def kernel(batches):
        cid, m = shared.value
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), SLICE):
                part = batch.slice(a, SLICE)
                x = matrix(part.column(1), m.shape[1])
                at = nearest(x, m)
                d2 = ((x - m[at]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cid[at]), pa.array(d2)], names=["vec_id", "cid", "d2"])

    return df.select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, cid int, d2 double")


def assign_blocks(df: DataFrame, centroids: DataFrame, d: int) -> DataFrame:
    """The same for any number of centroids (cid, centroid): nothing is broadcast or collected."""
    found = knn_blocks(df, centroids, 1, d)
    return found.select(F.col("query_id").alias("vec_id"), F.col("neighbor_id").cast("int").alias("cid"), "d2")


def checked_small(centroids: DataFrame, d: int) -> DataFrame:
    """Centroids to broadcast, once counted and found small enough."""
    require(centroids.count() * d * 8 <= BROADCAST_BYTES, "too many centroids to broadcast; use assign_blocks or knn_blocks")
    return F.broadcast(centroids)


def assign_relational(df: DataFrame, centroids: DataFrame, d: int) -> DataFrame:
    """The same by DataFrame functions alone: every vector meets all centroids as one array and keeps the least (d2, cid), so ties go to the lowest id. No pair becomes a row, nothing shuffles."""
    every = checked_small(centroids.select("cid", "centroid"), d).agg(F.collect_list(F.struct("cid", "centroid")).alias("all"))
    near = F.array_min(F.transform("all", lambda c: F.struct(V.l2_squared("embedding", c["centroid"]).alias("d2"), c["cid"].alias("cid"))))
    found = df.select("vec_id", "embedding").crossJoin(F.broadcast(every)).select("vec_id", near.alias("at"))
    return found.where("at is not null").select("vec_id", "at.cid", "at.d2")


def knn(queries: DataFrame, c_ids: np.ndarray, c: np.ndarray, k: int, pad: bool = False) -> DataFrame:
    """(query_id, rank, neighbor_id, d2): the k nearest, ties by lower id. pad: missing ranks have null neighbours."""
    require(k > 0, "k must be positive")
    require(c.nbytes <= BROADCAST_BYTES, "too many points to broadcast; use knn_blocks")
    shared = queries.sparkSession.sparkContext.broadcast((c_ids, c))
    d = c.shape[1]

    def kernel(batches):
        cid, m = shared.value
        have = min(k, len(m))
        for batch in batches:
            x = matrix(batch.column(1), d)
            for a in range(0, len(x), SLICE):
                part = x[a : a + SLICE]
                n, width = len(part), k if pad else have
                ids, exact = top(part, cid, m, have)
                near = np.zeros((n, width), dtype=np.int32)
                dist, gone = np.zeros((n, width)), np.ones((n, width), dtype=bool)
                near[:, :have], dist[:, :have], gone[:, :have] = ids, exact, False
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n).take(pa.array(np.repeat(np.arange(n), width))),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)),
                        pa.array(near.ravel(), mask=gone.ravel()),
                        pa.array(dist.ravel(), mask=gone.ravel()),
                    ],
                    names=["query_id", "rank", "neighbor_id", "d2"],
                )

    return queries.select("vec_id", "embedding").mapInArrow(kernel, "query_id long, rank int, neighbor_id int, d2 double")


def top(x: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact squared distances of the k nearest rows of m for each row of x, ties by lower id; k <= len(m)."""
    xx = (x * x).sum(axis=1)
    keep_d, keep_i = np.empty((len(x), 0)), np.empty((len(x), 0), dtype=np.int64)
    for b in range(0, len(m), CENTROID_BLOCK):  # merge block by block
        y = m[b : b + CENTROID_BLOCK]
        d2 = x @ (-2.0 * y.T)
        d2 += (y * y).sum(axis=1)
        d2 += xx[:, None]
        have = min(k + TIES, len(y))
        some = np.argpartition(d2, have - 1, axis=1)[:, :have] if have < len(y) else np.broadcast_to(np.arange(len(y)), d2.shape)
        keep_d = np.concatenate([keep_d, np.take_along_axis(d2, some, 1)], axis=1)
        keep_i = np.concatenate([keep_i, some + b], axis=1)
    exact = np.empty(keep_d.shape)
    for a in range(0, len(x), 256):  # candidates are measured again, by differences
        exact[a : a + 256] = ((x[a : a + 256, None, :] - m[keep_i[a : a + 256]]) ** 2).sum(axis=2)
    # More candidates tie with the last one than were kept: such rows are measured against all.
    order = np.lexsort((ids[keep_i], exact), axis=1)[:, :k]
    out_i, out_d = np.take_along_axis(keep_i, order, 1), np.take_along_axis(exact, order, 1)
    for r in np.flatnonzero(_crowded(keep_d, out_d, len(m), k)):
        d2 = ((x[r] - m) ** 2).sum(axis=1)
        order = np.lexsort((ids, d2))[:k]
        out_i[r], out_d[r] = order, d2[order]
    return ids[out_i], out_d


#: Candidates of a block beyond the k asked for.
TIES = 8


def _crowded(keep_d: np.ndarray, out_d: np.ndarray, n: int, k: int) -> np.ndarray:
    """Rows whose kept candidates may not hold all that are as near as the k-th: a block gave k + TIES no farther than it."""
    slack = 1e-9 * (1 + np.abs(out_d[:, -1]))
    out, at = np.zeros(len(keep_d), dtype=bool), 0
    for b in range(0, n, CENTROID_BLOCK):
        have = min(k + TIES, min(CENTROID_BLOCK, n - b))
        if have == k + TIES:
            out |= keep_d[:, at : at + have].max(axis=1) <= out_d[:, -1] + slack
        at += have
    return out


def knn_blocks(queries: DataFrame, points: DataFrame, k: int, d: int) -> DataFrame:
    """(query_id, rank, neighbor_id, d2): k nearest of `points` (cid, centroid) where both sides may be large.

    Both are dealt into blocks of BLOCK_BYTES by a hash of their ids. Each pair
    of blocks is one task's work, which gives k rows a query; a ranking, limited
    before its shuffle, merges them. A query row moves once for each block of
    points, a point once for each block of queries; nothing is broadcast and
    nothing reaches the driver but two counts. Null ids on either side take no
    part.
    """
    require(k > 0, "k must be positive")
    rows = max(1, BLOCK_BYTES // (8 * d))
    q = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    p = points.where("cid is not null").select(F.col("cid").cast("long").alias("id"), F.col("centroid").cast("array<double>").alias("v"))
    n_q, n_p = (max(1, -(-x.count() // rows)) for x in (q, p))
    n_p = max(n_p, min(8, queries.sparkSession.sparkContext.defaultParallelism))  # small tables use all cores, too

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)
        return df.select("id", "v", mine, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "neighbor_id", "d2"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        x, y = (matrix(t.column("v").combine_chunks(), d) for t in (left, right))
        ids, asked = np.asarray(right.column("id")), np.asarray(left.column("id"))
        have = min(k, len(y))
        found = [top(x[a : a + SLICE], ids, y, have) for a in range(0, len(x), SLICE)]
        near, dist = (np.concatenate([f[i] for f in found]).ravel() for i in (0, 1))
        return pa.table([pa.array(np.repeat(asked, have)), pa.array(near), pa.array(dist)], names=names)

    grouped = dealt(q, "qb", n_q, "pb", n_p).groupBy("qb", "pb").cogroup(dealt(p, "pb", n_p, "qb", n_q).groupBy("qb", "pb"))
    best = grouped.applyInArrow(meet, "query_id long, neighbor_id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbor_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "d2")


def knn_relational(queries: DataFrame, points: DataFrame, k: int, d: int, block_rows: int = 8192) -> DataFrame:
    """k nearest of `points` (cid, centroid) by a join and a ranking: both sides are rows of a block each, every block of queries meets every block of points, and each of these rows becomes k rows a query, by matrix products.

    Every pair is measured; none becomes a row. A task holds one row, two
    blocks, at a time; blocks of queries move once for each block of points,
    points once. Null ids on either side take no part.
    """
    require(k > 0, "k must be positive")

    def packed(df: DataFrame, key: str, vector: str, name: str, least: int) -> tuple[DataFrame, int]:
        rows = df.where(F.col(key).isNotNull()).select(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).alias("row"))
        n = max(least, -(-rows.count() // block_rows))
        block = F.pmod(F.xxhash64("row.id"), F.lit(n)).cast("int").alias(name)
        held = rows.groupBy(block).agg(F.collect_list("row").alias("rows"))
        return held.select(name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_v")), n

    def meet(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asked, x, ids, y = (batch.column(c)[row].values for c in range(4))
                x, y, ids = matrix(x, d), matrix(y, d), np.asarray(ids)
                have = min(k, len(y))
                for a in range(0, len(x), SLICE):
                    near, dist = top(x[a : a + SLICE], ids, y, have)
                    told = [pa.array(np.repeat(np.asarray(asked)[a : a + SLICE], have)), pa.array(near.ravel()), pa.array(dist.ravel())]
                    yield pa.RecordBatch.from_arrays(told, names=["query_id", "neighbor_id", "d2"])

    held, blocks = packed(points, "cid", "centroid", "p", min(8, queries.sparkSession.sparkContext.defaultParallelism))  # small tables use all cores, too
    asked = packed(queries, "vec_id", "embedding", "q", 1)[0].withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = asked.join(held, "p").select("q_ids", "q_v", "p_ids", "p_v").mapInArrow(meet, "query_id long, neighbor_id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbor_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "d2")


def other_neighbors(found: DataFrame, k: int) -> DataFrame:
    """Of k + 1 neighbours a query, found among all rows, the k nearest besides the query's own row, ranked anew."""
    anew = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    others = found.where(F.col("neighbor_id") != F.col("query_id")).withColumn("rank", anew)
    return others.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "d2")


def dot_products(df: DataFrame, c: np.ndarray, effective_d: int | None = None) -> DataFrame:
    """(vec_id, dots): products with each row of c over the first `effective_d` dimensions."""
    e = c.shape[1] if effective_d is None else min(effective_d, c.shape[1])
    shared = df.sparkSession.sparkContext.broadcast(c)

    def kernel(batches):
        m = shared.value
        for batch in batches:
            out = matrix(batch.column(1), m.shape[1])[:, :e] @ m[:, :e].T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(m)).cast(pa.list_(pa.float64()))], names=["vec_id", "dots"])

    return df.select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, dots array<double>")


def survivors(df: DataFrame, threshold: float, value: str = "d2") -> DataFrame:
    """Candidates strictly below a threshold."""
    return df.where(F.col(value) < threshold)
