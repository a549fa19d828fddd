"""A stored two-level index: fine clusters under their meso clusters, and the vectors laid out by both.

A search descends to a vector's nearest meso cluster and its fine centroids;
what it finds there is proved, or the search widened, by the meso clusters'
radii: a fine centroid is at least the distance to its meso centroid, less the
radius, away. Assignment is exact. Vectors are stored in the order (meso, cid,
distance), so that files and row groups hold runs of clusters and a filter on
cid reads those alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BROADCAST_BYTES, require
from ..operators import distance as D
from ..schema import vectors
from .hierarchical import HierarchicalKMeans

_ROWS = "meso int, cid int, vec_id long, away double, embedding array<float>"


class TwoLevelIndex:
    """`c[cid]` are the fine centroids, `meso_of[cid]` the meso cluster of each; `meso` are the meso centroids."""

    def __init__(self, c: np.ndarray, meso: np.ndarray, meso_of: np.ndarray):
        require(len(c) == len(meso_of) > 0, "n_clusters must be positive")
        require(c.nbytes <= BROADCAST_BYTES, "too many centroids to broadcast; use assign_blocks")
        self.c, self.meso, self.meso_of = c, meso, meso_of
        self.order = np.argsort(meso_of, kind="stable")  # of one meso by cid
        self.start = np.searchsorted(meso_of[self.order], np.arange(len(meso) + 1))
        away = np.sqrt(((c - meso[meso_of]) ** 2).sum(axis=1))
        self.radius = np.full(len(meso), -np.inf)
        np.maximum.at(self.radius, meso_of, away)

    @classmethod
    def of(cls, model: HierarchicalKMeans) -> "TwoLevelIndex":
        require(model.trained, "the index requires training first")
        return cls(model.centroids_, model.meso_centroids_, model.meso_of_)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest fine centroid of each vector and its squared distance, ties to the lowest id, and the multiplications it took."""
        n, d = x.shape
        away = x @ (-2.0 * self.meso.T)
        away += (self.meso * self.meso).sum(axis=1)
        away += (x * x).sum(axis=1)[:, None]
        away = np.sqrt(np.maximum(away, 0.0))
        away[:, np.diff(self.start) == 0] = np.inf  # without fine clusters
        best, at = np.full(n, np.inf), np.full(n, len(self.c))
        xx, work = (x * x).sum(axis=1), away.size * d

        def visit(j: int, rows: np.ndarray) -> int:
            ids = self.order[self.start[j] : self.start[j + 1]]
            y = self.c[ids]
            d2 = x[rows] @ (-2.0 * y.T) + (y * y).sum(axis=1) + xx[rows, None]
            k = d2.argmin(axis=1)
            value, cid = d2[np.arange(len(rows)), k], ids[k]
            better = (value < best[rows]) | ((value == best[rows]) & (cid < at[rows]))
            best[rows[better]], at[rows[better]] = value[better], cid[better]
            return d2.size * d

        # Each vector's meso clusters by rising distance, until even the largest radius reaches none of the rest.
        ranked, furthest = np.argsort(away, axis=1, kind="stable"), self.radius.max()
        going = np.arange(n)
        for turn in range(len(self.meso)):
            bound = np.sqrt(np.maximum(best[going], 0.0))
            bound += 1e-7 * (1 + bound)
            reach = away[going, ranked[going, turn]]
            going, bound, reach = (v[reach - furthest <= bound] for v in (going, bound, reach))
            if not len(going):
                break
            to = ranked[going, turn]
            some = np.flatnonzero(reach - self.radius[to] <= bound)
            for j in np.unique(to[some]).tolist():
                work += visit(j, going[some[to[some] == j]])
        return at, ((x - self.c[at]) ** 2).sum(axis=1), work

    def _placed(self, df: DataFrame, work: Accumulator | None = None) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)
        names = ["meso", "cid", "vec_id", "away", "embedding"]

        def kernel(batches):
            index = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, D.SLICE):
                    part = batch.slice(a, D.SLICE)
                    at, d2, products = index.search(D.matrix(part.column(1), index.c.shape[1]))
                    if work is not None:
                        work.add(products)
                    yield pa.RecordBatch.from_arrays([pa.array(index.meso_of[at].astype(np.int32)), pa.array(at.astype(np.int32)), part.column(0), pa.array(np.sqrt(d2)), part.column(1)], names=names)

        return vectors(df).mapInArrow(kernel, _ROWS)

    def assign(self, df: DataFrame, work: Accumulator | None = None) -> DataFrame:
        """(vec_id, cid, d2): exact nearest fine centroid. Narrow: no shuffle."""
        return self._placed(df, work).select("vec_id", "cid", (F.col("away") * F.col("away")).alias("d2"))

    def write(self, df: DataFrame, path: str) -> None:
        """Store vectors as (meso, cid, vec_id, away, embedding), sorted over all files by (meso, cid, away), in row groups of 8 MB, beside the table of clusters."""
        key = ["meso", "cid", "away", "vec_id"]
        rows = self._placed(df.where("vec_id is not null")).repartitionByRange(*key).sortWithinPartitions(*key)
        rows.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/vectors")
        spark = df.sparkSession
        held = spark.read.parquet(f"{path}/vectors").groupBy("meso", "cid").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        every = spark.createDataFrame([(int(m), i, v) for i, (m, v) in enumerate(zip(self.meso_of, self.c.tolist(), strict=True))], "meso int, cid int, centroid array<double>")
        rows = every.join(held, ["meso", "cid"], "left").select("meso", "cid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), "centroid")
        of_meso = rows.groupBy("meso").agg(F.sum("n").alias("of")).withColumn("before", F.coalesce(F.sum("of").over(Window.orderBy("meso").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a meso cluster
        within = F.coalesce(F.sum("n").over(Window.partitionBy("meso").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows.join(F.broadcast(of_meso.select("meso", "before")), "meso").select("meso", "cid", "n", (F.col("before") + within).alias("start"), "radius", "centroid").write.parquet(f"{path}/clusters")

    @staticmethod
    def clusters(spark: SparkSession, path: str) -> DataFrame:
        """(meso, cid, n, start, radius, centroid) of a stored index: how many vectors each cluster has, where they begin in the order of all, and how far they reach."""
        return spark.read.parquet(f"{path}/clusters")

    @staticmethod
    def members(spark: SparkSession, path: str, cids: list[int]) -> DataFrame:
        """The stored vectors of some clusters; files and row groups without them are not read."""
        return spark.read.parquet(f"{path}/vectors").where(F.col("cid").isin(cids))
