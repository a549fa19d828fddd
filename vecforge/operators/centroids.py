"""Centroid maintenance: sums, means, shift, repair of empty and small clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import F32_EPSILON, PERTURBATION
from ..functions import vectors as V
from . import distance as D

#: Rows of partial sums that are added up at once.
BRANCH = 64
#: Bytes of sums that a task holds, and of those of one block of clusters, where clusters are too many for one array.
TASK_BYTES, SUM_BYTES = 64 << 20, 1 << 20


def cluster_sums(assigned: DataFrame, d: int, tasks: int) -> DataFrame:
    """(cid, size, cost, total) of (cid, d2, embedding) for any number of clusters: reduced in bounded pieces of a task, then by blocks of clusters, in groups of BRANCH pieces where there are more."""
    most = max(1, TASK_BYTES // (8 * d))
    block = max(1, SUM_BYTES // (8 * d))
    kinds = "cid int, size long, cost double, total array<double>"
    names = ["cid", "size", "cost", "total"]

    def reduced(cid: np.ndarray, size: np.ndarray, cost: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        order = np.argsort(cid, kind="stable")
        ids, first = np.unique(cid[order], return_index=True)
        sums = [np.add.reduceat(v[order], first, axis=0) for v in (size, cost, x)]
        return [pa.array(ids.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]), pa.FixedSizeListArray.from_arrays(pa.array(sums[2].ravel()), d).cast(pa.list_(pa.float64()))]

    def piece(batches):
        held, n = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), D.matrix(batch.column(2), d)))
            n += batch.num_rows
            if n >= most:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    def told(held):
        cid, d2, x = (np.concatenate(v) for v in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(reduced(cid, np.ones(len(cid), dtype=np.int64), d2, x), names=names)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        return pa.table(reduced(*(np.asarray(rows[c]) for c in names[:3]), D.matrix(rows["total"].combine_chunks(), d)), names=names)

    pieces = assigned.select("cid", "d2", "embedding").mapInArrow(piece, kinds)
    at = F.floor(F.col("cid") / block).alias("block")
    while tasks > BRANCH:
        tasks = -(-tasks // BRANCH)
        pieces = pieces.select("*", at, F.pmod(F.xxhash64("cid", "cost", "size"), F.lit(tasks)).alias("salt")).groupBy("block", "salt").applyInArrow(add, kinds)
    return pieces.select("*", at).groupBy("block").applyInArrow(add, kinds)


def means(labelled: DataFrame, d: int, tasks: int = 1) -> DataFrame:
    """(cid, centroid, size) of (cid, embedding): the mean of each group, from sums of bounded pieces of a task."""
    sums = cluster_sums(labelled.select("cid", F.lit(0.0).alias("d2"), "embedding"), d, tasks)
    return sums.select("cid", F.transform("total", lambda x: x / F.col("size")).alias("centroid"), "size")


def partial_sums(pieces: DataFrame, tasks: int) -> DataFrame:
    """Sums of (cid, size, cost, kept, total) rows by cid; each task has reduced its rows to one a cluster, so tasks * k rows shuffle.

    Beyond BRANCH tasks the sums of a cluster are first added up in groups of
    about BRANCH rows, so no group ever holds a row of every task.
    """

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows.column("total")[0]))
        for chunk in rows.column("total").chunks:
            total += np.asarray(chunk.flatten()).reshape(len(chunk), -1).sum(axis=0)
        one = [[rows.column("cid")[0].as_py()], *([sum(rows.column(c).to_pylist())] for c in ("size", "cost", "kept")), [total.tolist()]]
        return pa.table(dict(zip(("cid", "size", "cost", "kept", "total"), one, strict=True)), schema=rows.select(["cid", "size", "cost", "kept", "total"]).schema)

    while tasks > BRANCH:
        tasks = -(-tasks // BRANCH)
        salt = F.pmod(F.xxhash64("cost", "size", F.lit(tasks)), F.lit(tasks)).alias("salt")
        pieces = pieces.select("*", salt).groupBy("cid", "salt").applyInArrow(add, SUMS)
    return pieces.groupBy("cid").applyInArrow(add, SUMS)


def updated(df: DataFrame, ids: np.ndarray, c: np.ndarray, tasks: int = 1) -> DataFrame:
    """(cid, size, cost, kept, total): assignment of the vectors to centroids and the sums of each cluster, in one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast((ids, c))

    def kernel(batches):
        cid, m = shared.value
        total, size, cost = np.zeros(m.shape), np.zeros(len(m), dtype=np.int64), np.zeros(len(m))
        for batch in batches:
            all_x = D.matrix(batch.column(1), m.shape[1])
            for a in range(0, len(all_x), D.SLICE):
                x = all_x[a : a + D.SLICE]
                at = D.nearest(x, m)
                cost += np.bincount(at, weights=((x - m[at]) ** 2).sum(axis=1), minlength=len(m))
                accumulate(at, x, len(m), total, size)
        held = np.flatnonzero(size)
        if len(held):
            yield sums_batch(held, size, cost, np.zeros(len(m), dtype=np.int64), total, cid)

    return partial_sums(df.select("vec_id", "embedding").mapInArrow(kernel, SUMS), tasks)


def accumulate(cid: np.ndarray, x: np.ndarray, k: int, into: np.ndarray, size: np.ndarray) -> None:
    """Add a batch's vectors to its clusters' sums."""
    order = np.argsort(cid, kind="stable")
    ids, first = np.unique(cid[order], return_index=True)
    into[ids] += np.add.reduceat(x[order], first, axis=0)
    size += np.bincount(cid, minlength=k)


def sums_batch(cids: np.ndarray, size: np.ndarray, cost: np.ndarray, kept: np.ndarray, total: np.ndarray, names: np.ndarray | None = None) -> pa.RecordBatch:
    """Sums of the clusters at these places, called by their place or by `names`."""
    ids = cids if names is None else names[cids]
    arrays = pa.FixedSizeListArray.from_arrays(pa.array(total[cids].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(size[cids]), pa.array(cost[cids]), pa.array(kept[cids]), arrays], names=["cid", "size", "cost", "kept", "total"])


def summed(pieces: DataFrame, d: int) -> tuple[np.ndarray, ...]:
    """cid, size, cost, kept and total of partial sums, by cid, as arrays from the start: one row a cluster."""
    rows = pieces.toArrow().sort_by("cid")
    total = rows["total"].combine_chunks().flatten() if rows.num_rows else []
    return (*(np.asarray(rows[c]) for c in ("cid", "size", "cost", "kept")), np.asarray(total, dtype=np.float64).reshape(-1, d))


SUMS = "cid int, size long, cost double, kept long, total array<double>"


def normalised(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), F32_EPSILON)


def shift(new: np.ndarray, old: np.ndarray) -> float:
    """Total squared movement."""
    return float(((new - old) ** 2).sum())


def shift_relational(new: DataFrame, old: DataFrame) -> DataFrame:
    pairs = new.join(old.withColumnRenamed("centroid", "was"), "cid")
    return pairs.agg(F.sum(V.l2_squared("centroid", "was")).alias("shift"))


def split_empty(c: np.ndarray, sizes: np.ndarray, n: int, rng: np.random.Generator) -> int:
    """Give each empty cluster one half of a populous one, nudged apart by 1 / 1024; in place. Returns how many."""
    k, done = len(c), 0
    wave = np.where(np.arange(c.shape[1]) % 2 == 0, PERTURBATION, -PERTURBATION)
    for empty in np.flatnonzero(sizes == 0):
        if sizes.max(initial=0) < 2:
            break
        donor = 0
        while rng.random() >= (sizes[donor] - 1) / max(n - k, 1):
            donor = (donor + 1) % k
        c[empty] = c[donor] * (1 + wave)
        c[donor] = c[donor] * (1 - wave)
        half = sizes[donor] // 2
        sizes[empty], sizes[donor] = half, sizes[donor] - half
        done += 1
    return done


def pull_small(c: np.ndarray, sizes: np.ndarray, n: int, rng: np.random.Generator) -> int:
    """Pull centroids of clusters up to a quarter of the average size towards large ones; in place. Returns how many."""
    k, done = len(c), 0
    average = n // k
    limit = int(average * 0.25)
    large = np.flatnonzero(sizes >= average)
    for small in np.flatnonzero((sizes > 0) & (sizes <= limit)):
        if not len(large):
            break
        at, span = 0, n - average * k + k
        while rng.random() >= (sizes[large[at]] - average + 1) / span:
            at = (at + 1) % len(large)
        weight = min(int(sizes[small]), 7)
        c[small] = (weight * c[small] + c[large[at]]) / (weight + 1)
        done += 1
    return done


def consolidated(total: np.ndarray, sizes: np.ndarray, old: np.ndarray, n: int, seed: int, aggressive: bool, angular: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, then repair, then unit length if asked for: centroids, adjusted sizes, number of repairs."""
    c = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], old)
    sizes = sizes.copy()
    rng = np.random.default_rng(seed)
    done = split_empty(c, sizes, n, rng)
    if aggressive:
        done += pull_small(c, sizes, n, rng)
    return (normalised(c) if angular else c), sizes, done
