"""Schemas of the engine's tables and checks of vector columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ClusteringError

CENTROIDS = "cid int, centroid array<double>"
ASSIGNMENTS = "vec_id long, cid int, d2 double"
ITER_STATS = "iteration int, objective double, shift double, split int, recall double, not_pruned_pct double, partial_d int, is_gemm_only boolean"
HIER_STATS = "phase string, meso_id int, " + ITER_STATS
KNN = "query_id long, rank int, neighbor_id int, d2 double"


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The two columns the kernels need, so that scans read nothing else."""
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))


def bad_rows(df: DataFrame, d: int):
    """Rows that are no vector of width d: null id or array, other width, null elements."""
    e = F.col("embedding")
    return df.where(F.col("vec_id").isNull() | e.isNull() | (F.size(e) != d) | F.exists(e, lambda x: x.isNull()))


def checked(df: DataFrame, d: int, drop: bool = False) -> DataFrame:
    """Vectors of width d; others raise, or are left out with `drop`."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == d) & ~F.exists(e, lambda x: x.isNull())
    if drop:
        return df.where(good)
    n = bad_rows(df, d).count()
    if n:
        raise ClusteringError(f"{n} rows are no vectors of width {d}; pass drop=True to leave them out")
    return df
