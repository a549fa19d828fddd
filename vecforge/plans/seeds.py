"""Seeds of a pruned search over the training vectors: a centroid for each that is likely its nearest.

A vector of the training sample starts from its last assignment in training,
which a stored table gives by a join on vec_id. For the others it depends on
the share that was sampled: none without sampling; above WEIGHTED_SHARE a draw
by cluster sizes; below it the representative of the nearest cluster of a
smaller model that is trained on the centroids. A seed bounds its vector's
search from the start; the result is the same from any seed but for the
approximation of pruning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FlatConfig
from ..functions import sampling as S
from ..operators import distance as D
from ..sources.tables import centroid_table

#: Fixed values of the choice of seeds: the share of vectors above which those outside the sample are drawn by size, and the iterations of the model over the centroids.
WEIGHTED_SHARE = 0.8
MESO_ITERS = 10


def stored(assigned: DataFrame) -> DataFrame:
    """(vec_id, prev_cid) of a table of assignments, one row an id. On a bucketed table neither this nor a join on vec_id exchanges rows."""
    return assigned.groupBy("vec_id").agg(F.min("cid").alias("prev_cid")).hint("shuffle_hash")


def known(rows: DataFrame, assigned: DataFrame | None, k: int) -> DataFrame:
    """`rows` with prev_cid: the last assignment in training; null where there is none or it is no centroid of k."""
    if assigned is None:
        return rows.withColumn("prev_cid", F.lit(None).cast("int"))
    return rows.join(stored(assigned), "vec_id", "left").withColumn("prev_cid", F.when(F.col("prev_cid") < k, F.col("prev_cid")))


@dataclass(frozen=True)
class BySize:
    """Seeds from a uniform number of each vector: the cluster in whose share it lies."""

    ends: np.ndarray

    def __call__(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        return S.drawn(self.ends, u)


@dataclass(frozen=True)
class ByMeso:
    """Seeds from the vectors: the representative of the nearest cluster of centroids."""

    meso: np.ndarray
    representative: np.ndarray

    def __call__(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self.representative[D.nearest(x, self.meso)]


def by_size(sizes: np.ndarray) -> BySize:
    """Seeds drawn with chances proportional to max(size, 1)."""
    return BySize(S.shares(sizes))


def by_meso(spark: SparkSession, c: np.ndarray, cfg: FlatConfig) -> ByMeso:
    """Seeds from a model of sqrt(k) clusters over the k centroids: the last centroid of the vector's nearest cluster, 0 if it has none."""
    from .flat import KMeans

    settings = FlatConfig(iters=MESO_ITERS, sampling_fraction=1.0, seed=cfg.seed, angular=cfg.angular, suppress_warnings=True, data_already_rotated=True)
    model = KMeans(max(1, math.isqrt(len(c))), c.shape[1], settings)
    model.fit(centroid_table(spark, c).select(F.col("cid").cast("long").alias("vec_id"), F.col("centroid").alias("embedding")))
    model.release()
    meso = model.centroids_
    last = np.zeros(len(meso), dtype=np.int64)
    np.maximum.at(last, D.nearest(c, meso), np.arange(len(c)))
    return ByMeso(meso, last)
