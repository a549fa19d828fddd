"""Exact k nearest neighbours of two large tables over inverted lists, ruled out by the triangle inequality.

Points lie in the list of their nearest pivot. Sorted by (list, distance to the
pivot), they are cut into blocks, so that a block is a shell around one pivot
and a large list has many of them. A query at distance a from a pivot is at
least a - high or low - a away from every point of a shell [low, high]. The
first round searches each query's nearest lists, just as many as hold k points;
the k-th distance found bounds the second round, which searches every shell
elsewhere that the bound does not rule out. Pivots and list sizes are held by
every task, under the limit of a broadcast; shells, points and queries never.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, require
from ..sources.storage import Store
from . import distance as D

#: Points of a block, and queries that meet it together, at most.
BLOCK_ROWS = 4096
#: Distances to pivots held at once.
SEEN = 1 << 22
_BLOCK = "block long, list int, low double, high double, n long, ids array<long>, v array<double>"


@dataclass
class Lists:
    """`blocks`: (block, list, low, high, n, ids, v), a row a block; `pivots` with the size and the radius of each one's list."""

    blocks: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    store: Store

    def release(self) -> None:
        self.store.release()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d2 = x @ (-2.0 * c.T)
    d2 += (c * c).sum(axis=1)
    d2 += (x * x).sum(axis=1)[:, None]
    return np.sqrt(np.maximum(d2, 0.0))


def build(points: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS) -> Lists:
    """Lists of `points` (cid, centroid); points with a null id take no part. One range shuffle of the points, stored."""
    require(len(pivots) > 0 and pivots.nbytes <= BROADCAST_BYTES, "too many pivots to broadcast, or none")
    spark, d = points.sparkSession, pivots.shape[1]
    shared, store = spark.sparkContext.broadcast(pivots), Store(spark)

    def dealt(batches):
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, D.SLICE):
                part = batch.slice(a, D.SLICE)
                x = D.matrix(part.column(1), d)
                at = D.nearest(x, c)
                away = np.sqrt(((x - c[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(away), part.column(0), part.column(1)], names=["list", "away", "id", "v"])

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * block_rows:
                rows = pa.Table.from_batches(held).combine_chunks()
                runs, left = _runs(np.asarray(rows["list"]), block_rows, last=False)
                for run in runs:
                    yield packed(rows, run, block)
                    block += 1
                held, n = rows.slice(left).to_batches(), rows.num_rows - left
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            for run in _runs(np.asarray(rows["list"]), block_rows, last=True)[0]:
                yield packed(rows, run, block)
                block += 1

    def packed(rows: pa.Table, run: slice, block: int) -> pa.RecordBatch:
        part = rows.slice(run.start, run.stop - run.start)
        away, v = np.asarray(part["away"]), part["v"].combine_chunks().flatten()
        columns = [[block], [part["list"][0].as_py()], [float(away.min())], [float(away.max())], [len(away)]]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part["id"].combine_chunks(), v)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns, kinds, strict=True)), *lists], names=["block", "list", "low", "high", "n", "ids", "v"])

    p = points.where("cid is not null").select(F.col("cid").cast("long").alias("id"), F.col("centroid").cast("array<double>").alias("v"))
    rows = store.plain(p.mapInArrow(dealt, "list int, away double, id long, v array<double>"), "dealt")
    order = ["list", "away", "id"]
    blocks = store.plain(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK), "shells")
    store.discard(rows)
    told = blocks.groupBy("list").agg(F.sum("n").alias("n"), F.max("high").alias("high")).toArrow()  # a row a list at most
    size, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    at = np.asarray(told["list"])
    size[at], radius[at] = np.asarray(told["n"]), np.asarray(told["high"])
    return Lists(blocks, pivots, size, radius, store)


def _runs(lists: np.ndarray, most: int, last: bool) -> tuple[list[slice], int]:
    """Runs of one list, `most` rows at most; unless these rows are the last ones, a run that may go on is left: where it begins."""
    edges = np.append(np.flatnonzero(np.append(True, np.diff(lists) != 0)), len(lists))
    out = [slice(k, min(k + most, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(a, b, most)]
    if last or not out or out[-1].stop - out[-1].start == most:
        return out, len(lists)
    return out[:-1], out[-1].start


def _lists_of(queries: DataFrame, lists: Lists, k: int, first: bool) -> DataFrame:
    """(id, v, tau, list, away): each query's lists. first: the nearest ones that hold k points; else the others within tau."""
    shared = queries.sparkSession.sparkContext.broadcast((lists.pivots, lists.size, lists.radius))
    names = ["id", "v", "tau", "list", "away"]

    def kernel(batches):
        c, size, radius = shared.value
        some = np.flatnonzero(size)
        c, size, radius = c[some], size[some], radius[some]
        step = max(1, SEEN // max(1, len(c)))
        for batch in batches:
            for a in range(0, batch.num_rows if len(some) else 0, step):
                part = batch.slice(a, step)
                away = _distances(D.matrix(part.column(1), c.shape[1]), c)
                order = np.argsort(away, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                near = np.zeros(away.shape, dtype=bool)
                np.put_along_axis(near, order, held - size[order] < k, axis=1)
                if not first:
                    tau = np.asarray(part.column(2))[:, None]
                    near = ~near & (away - radius <= tau + _slack(tau))
                q, at = np.nonzero(near)
                rows = part.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(some[at].astype(np.int32)), pa.array(away[q, at])], names=names)

    return queries.select("id", "v", "tau").mapInArrow(kernel, "id long, v array<double>, tau double, list int, away double")


def _slack(tau):
    """What rounding may take from a bound."""
    return 1e-7 * (1 + tau)


def candidates(queries: DataFrame, lists: Lists, k: int, first: bool) -> DataFrame:
    """(id, v, block, n): the blocks that a round searches for each query (id, v, tau)."""
    shells = lists.blocks.select("block", "list", "low", "high", "n")
    pairs = _lists_of(queries, lists, k, first).join(shells, "list")
    if not first:
        slack = 1e-7 * (1 + F.col("tau"))
        pairs = pairs.where((F.col("away") - F.col("high") <= F.col("tau") + slack) & (F.col("low") - F.col("away") <= F.col("tau") + slack))
    return pairs.select("id", "v", "block", "n")


def _met(pairs: DataFrame, lists: Lists, k: int, parts: int) -> DataFrame:
    """(query_id, neighbor_id, d2): of each block the k nearest to each query that searches it; queries of a block meet it in bounded parts."""
    d = lists.pivots.shape[1]
    names = ["query_id", "neighbor_id", "d2"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        x = D.matrix(left["v"].combine_chunks(), d)
        ids, y = np.asarray(right["ids"].combine_chunks().flatten()), np.asarray(right["y"].combine_chunks().flatten()).reshape(-1, d)
        have = min(k, len(y))
        found = [D.top(x[a : a + D.SLICE], ids, y, have) for a in range(0, len(x), D.SLICE)]
        near, dist = (np.concatenate([f[i] for f in found]).ravel() for i in (0, 1))
        return pa.table([pa.array(np.repeat(np.asarray(left["id"]), have)), pa.array(near), pa.array(dist)], names=names)

    asked = pairs.select("id", "v", "block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    wanted = asked.select(F.col("block").alias("of"), F.col("part").alias("by")).distinct()
    payload = lists.blocks.select(F.col("block").alias("of"), "ids", F.col("v").alias("y")).join(wanted, "of")
    return asked.groupBy("block", "part").cogroup(payload.groupBy("of", "by")).applyInArrow(meet, "query_id long, neighbor_id long, d2 double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_lists(queries: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(query_id, rank, neighbor_id, d2): the k nearest points of each query (vec_id, embedding), ties by lower id; exact for any pivots.

    Query ids are unique, null ids take no part. Each round groups queries by
    block, pre-ranked in the task that met it.
    """
    require(k > 0, "k must be positive")
    q = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    parts = max(1, -(-q.count() // BLOCK_ROWS))
    begun = q.withColumn("tau", F.lit(float("inf")))
    near = lists.store.plain(_best(_met(candidates(begun, lists, k, True), lists, k, parts), k), "near")
    tau = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt("d2").alias("tau"))
    bounded = q.join(tau, "id", "left").select("id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    rest = _met(candidates(bounded, lists, k, False), lists, k, parts)
    found = _best(near.drop("rank").unionByName(rest), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "d2")
