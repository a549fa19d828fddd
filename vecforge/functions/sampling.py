"""Seeded order, samples and first centroids; the same rows come out for any partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, FlatConfig, require


def seeded_key(seed: int, vec_id: str = "vec_id") -> Column:
    """A uniform key of each id; ordering by (key, id) is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")))


def sample_size(n: int, k: int, fraction: float, most_per_cluster: int | None) -> int:
    """Rows to train on. The fraction counts as a 32-bit float, so 0.7 of 10 is 6."""
    if fraction == 1.0:
        return n
    size = int(math.floor(n * float(np.float32(fraction))))
    return size if most_per_cluster is None else min(size, k * most_per_cluster)


def sampled(n: Column, k: int, fraction: Column, most_per_cluster: int | None) -> Column:
    """`sample_size` of columns."""
    size = F.floor(n * fraction.cast("float").cast("double"))
    return F.when(fraction == 1.0, n).otherwise(size if most_per_cluster is None else F.least(size, F.lit(k * most_per_cluster))).cast("int")


def first_rows(df: DataFrame, n: int, seed: int, vec_id: str = "vec_id") -> DataFrame:
    """The first n rows of the seeded order, as an exact distributed selection.

    Keys are counted by their first four hex digits (65,536 counts at most);
    rows before the boundary digits are taken as they are, and only the
    boundary's rows are sorted. No global sort, no single-task limit.
    """
    head = F.substring(seeded_key(seed, vec_id), 1, 4)
    counts = sorted((r["h"], r["count"]) for r in df.groupBy(head.alias("h")).count().collect())
    taken = 0
    for h, c in counts:
        if taken + c > n:
            last = df.where(head == h).orderBy(seeded_key(seed, vec_id), vec_id).limit(n - taken)
            return df.where(head < h).unionByName(last)
        taken += c
    return df


def first_centroids(df: DataFrame, k: int, seed: int) -> DataFrame:
    """(cid, centroid): the first k vectors of the seeded order. k rows, so the ranking's one task is small."""
    some = df.orderBy(seeded_key(seed), "vec_id").limit(k)
    rank = F.row_number().over(Window.orderBy(seeded_key(seed), "vec_id")) - 1
    return some.select(rank.cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))


def first_matrix(df: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same on the driver, ids and matrix: the k best of every task meet there and nothing is shuffled to be numbered."""
    rows = df.orderBy(seeded_key(seed), "vec_id").limit(k).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    n = rows.num_rows
    flat = np.array(rows["v"].combine_chunks().flatten(), dtype=np.float64) if n else np.zeros(0)
    return np.arange(n, dtype=np.int32), flat.reshape(n, -1 if n else 0)


def training_sample(df: DataFrame, n: int, k: int, cfg: FlatConfig, capped: bool = True) -> DataFrame:
    size = sample_size(n, k, cfg.sampling_fraction, cfg.max_points_per_cluster if capped else None)
    require(size >= k, "Not enough samples to train the requested number of clusters")
    return df if size == n else first_rows(df, size, cfg.seed)


def uniform_key(seed: int, vec_id: str = "vec_id") -> Column:
    """A uniform number in [0, 1) of each id."""
    return F.conv(F.substring(seeded_key(seed, vec_id), 1, 12), 16, 10).cast("double") / float(16**12)


def shares(sizes: np.ndarray) -> np.ndarray:
    """Upper ends of each cluster's share of [0, 1), proportional to max(size, 1)."""
    weights = np.maximum(sizes, 1)
    return np.cumsum(weights) / float(weights.sum())


def drawn(ends: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The cluster in whose share each number lies: a binary search a number."""
    return np.minimum(np.searchsorted(ends, u, side="right"), len(ends) - 1)


def weighted_seed(sizes: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """(vec_id, cid): a cluster for each id, drawn with chances proportional to max(size, 1).

    `sizes` has one row a cluster; its shares, 12 bytes a cluster, are held by
    every task, under the limit of a broadcast, so that no plan grows with k.
    """
    rows = sizes.select("cid", "size").toArrow().sort_by("cid")
    require(rows.num_rows > 0, "n_clusters must be positive")
    require(rows.num_rows * 12 <= BROADCAST_BYTES, "too many clusters to broadcast")
    shared = ids.sparkSession.sparkContext.broadcast((np.asarray(rows["cid"]).astype(np.int32), shares(np.asarray(rows["size"]))))

    def kernel(batches):
        cid, ends = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid[drawn(ends, np.asarray(batch.column(1)))])], names=["vec_id", "cid"])

    return ids.select("vec_id", uniform_key(seed + 1).alias("u")).mapInArrow(kernel, "vec_id long, cid int")
