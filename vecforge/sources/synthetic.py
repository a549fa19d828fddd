"""Synthetic vectors, equal for any partitioning: each row has a generator of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import F32_EPSILON


def _generated(spark: SparkSession, n: int | DataFrame, d: int, row, partitions: int | None) -> DataFrame:
    """Vectors 0 to n - 1, or one for each vec_id of a table."""

    def kernel(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a in range(0, len(ids), 2048):
                part = ids[a : a + 2048]
                x = np.stack([row(int(i)) for i in part]).astype(np.float32)
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(part), arrays], names=["vec_id", "embedding"])

    if isinstance(n, DataFrame):
        base = n.where("vec_id is not null").select(n["vec_id"].cast("long").alias("id"))
    else:
        base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return base.mapInArrow(kernel, "vec_id long, embedding array<float>")


def blobs(spark: SparkSession, n: int | DataFrame, d: int, centers: int, normalize: bool = False, std: float = 1.0, spread: float = 10.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Gaussian blobs: centers N(0, spread), a random center plus N(0, std) for each row."""
    middle = np.random.default_rng(seed).normal(0.0, spread, (centers, d))

    def row(i: int) -> np.ndarray:
        rng = np.random.default_rng([seed, i + 1])
        x = middle[rng.integers(centers)] + rng.normal(0.0, std, d)
        return x / max(float(np.sqrt((x * x).sum())), F32_EPSILON) if normalize else x

    return _generated(spark, n, d, row, partitions)


def uniform(spark: SparkSession, n: int | DataFrame, d: int, low: float = -1.0, high: float = 1.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    return _generated(spark, n, d, lambda i: np.random.default_rng([seed, i]).uniform(low, high, d), partitions)


def separated(spark: SparkSession, n: int, d: int, k: int, seed: int = 42) -> DataFrame:
    """Well separated clusters: vector i belongs to cluster i mod k."""
    offset = np.where(np.arange(d) % 2 == 0, 5.0, -5.0)
    return _generated(spark, n, d, lambda i: 20.0 * (i % k) + offset + np.random.default_rng([seed, i]).normal(0.0, 0.5, d), None)
