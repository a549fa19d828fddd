"""Training with more centroids than the driver or a broadcast holds: centroids are a table from the first iteration to the last.

Vectors are stored once, bucketed by vec_id. An iteration assigns them block
against block, stores (vec_id, cid, d2) in the same buckets and joins the two
without an exchange; sums are reduced in their tasks, then by blocks of
clusters. Means, shift and repairs are DataFrame operations on the centroid
table. The driver gets counts, the cost and the shift.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PERTURBATION, FlatConfig, check_shape, require
from ..functions import sampling as S
from ..functions import vectors as V
from ..operators import centroids as C
from ..operators import distance as D
from ..schema import ITER_STATS, vectors
from ..sources.storage import Store
from .flat import stops

#: Clusters whose shares are added up in one task; the driver holds one number for as many.
RANGE = 1 << 16


def numbered(df: DataFrame, k: int, seed: int) -> DataFrame:
    """(cid, centroid): the first k vectors of the seeded order, numbered without a global sort: in each range of the order, after the counts of those before."""
    head = F.substring(S.seeded_key(seed), 1, 4)
    some = S.first_rows(df, k, seed).select("vec_id", "embedding", head.alias("h"), S.seeded_key(seed).alias("key"))
    counts = sorted((r["h"], r["count"]) for r in some.groupBy("h").count().collect())  # 65,536 at most
    before, starts = 0, []
    for h, n in counts:
        starts.append((h, before))
        before += n
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "h string, start long"))
    place = F.row_number().over(Window.partitionBy("h").orderBy("key", "vec_id")) - 1
    rows = some.withColumn("place", place).join(start, "h").select((F.col("start") + F.col("place")).cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))
    return rows.where(F.col("cid") < k)  # the boundary's range may have been taken whole


def drawn_rows(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(cid, chosen): for each item (cid, u) the row of `weights` (cid, w) in whose share of [0, 1) its u lies, by cid; w are whole and positive.

    Shares are added up range by range, RANGE clusters each; the driver holds
    one sum a range. Items find their range by a binary search and their row in it
    by one ordering of both.
    """
    spark = items.sparkSession
    ranged = weights.select(F.col("cid").alias("chosen"), "w", F.floor(F.col("cid") / RANGE).alias("range"))
    totals = sorted((r["range"], r.w) for r in ranged.groupBy("range").agg(F.sum("w").alias("w")).collect())
    ends = np.cumsum([w for _, w in totals])
    ids = np.array([r for r, _ in totals], dtype=np.int64)
    total = int(ends[-1])

    def find(batches):
        for batch in batches:
            at = np.asarray(batch.column(1)) * total
            place = np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[place]), pa.array(at - (ends[place] - np.diff(ends, prepend=0)[place]))], names=["cid", "range", "at"])

    asked = items.select("cid", "u").mapInArrow(find, "cid int, range long, at double")
    begin = F.sum("w").over(Window.partitionBy("range").orderBy("chosen")) - F.col("w")
    rows = ranged.select(F.lit(None).cast("int").alias("cid"), "range", begin.cast("double").alias("at"), F.col("chosen").cast("int").alias("chosen"))
    both = rows.unionByName(asked.withColumn("chosen", F.lit(None).cast("int")))
    last = F.last("chosen", ignorenulls=True).over(Window.partitionBy("range").orderBy("at", F.col("chosen").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("chosen", last).where("cid is not null").select("cid", "chosen")


def _nudged(c: Column, times: Column, up: bool) -> Column:
    """A centroid after `times` splits: pushed away as the part that stays, once more towards the other side if `up`."""

    def value(x: Column, i: Column) -> Column:
        wave = F.when(i % 2 == 0, F.lit(PERTURBATION)).otherwise(F.lit(-PERTURBATION))
        stayed = x * F.pow(1 - wave, times)
        return stayed * (1 + wave) if up else stayed

    return F.transform(c, value)


def split_empty(c: DataFrame, seed: int, store: Store) -> tuple[DataFrame, int]:
    """The repair of empty clusters on a table (cid, centroid, size): each gets one half of a populous cluster, drawn by size - 1; returns how many.

    Several may draw one donor, which is split as many times, in the order of
    their ids: sizes halve, centroids are nudged apart by PERTURBATION each
    time. Whoever would split a single row draws again, so the sizes stay positive.
    """
    done, number = 0, 0
    while True:
        empty = c.where(F.coalesce("size", F.lit(0)) == 0).select("cid")
        donors = c.where("size > 1")
        left = empty.count()
        if not left or donors.isEmpty():
            return c, done
        number += 1
        draws = drawn_rows(empty.withColumn("u", S.uniform_key(seed + number, "cid")), donors.select("cid", (F.col("size") - 1).alias("w")))
        turn = F.row_number().over(Window.partitionBy("chosen").orderBy("cid")) - 1
        told = donors.select(F.col("cid").alias("chosen"), F.col("centroid").alias("of"), F.col("size").alias("whole"))
        pairs = draws.withColumn("turn", turn).join(told, "chosen").where(F.pow(F.lit(2.0), F.col("turn")) < F.col("whole"))
        pairs = store.plain(pairs, "splits")
        before = F.ceil(F.col("whole") / F.pow(F.lit(2.0), F.col("turn")))
        new = pairs.select("cid", _nudged(F.col("of"), F.col("turn"), True).alias("given"), F.floor(before / 2).cast("long").alias("got"))
        times = pairs.groupBy(F.col("chosen").alias("cid")).agg(F.count(F.lit(1)).alias("times"))
        joined = c.join(new, "cid", "left").join(times, "cid", "left")
        kept = F.when(F.col("times").isNotNull(), _nudged(F.col("centroid"), F.col("times"), False)).otherwise(F.col("centroid"))
        size = F.when(F.col("times").isNotNull(), F.ceil(F.col("size") / F.pow(F.lit(2.0), F.col("times"))).cast("long")).otherwise(F.col("size"))
        after = store.plain(joined.select("cid", F.coalesce("given", kept).alias("centroid"), F.coalesce("got", size).alias("size")), "split")
        store.discard(pairs)
        done += left - after.where(F.coalesce("size", F.lit(0)) == 0).count()
        c = after


def pull_small(c: DataFrame, n: int, k: int, seed: int, store: Store) -> tuple[DataFrame, int]:
    """The repair of small clusters on a table (cid, centroid, size): those up to a quarter of the average are pulled towards large ones, drawn by what they have beyond the average; returns how many."""
    average = n // k
    large = c.where(F.col("size") >= average).select("cid", "centroid", (F.col("size") - average + 1).alias("w"))
    small = c.where((F.col("size") > 0) & (F.col("size") <= int(average * 0.25)))
    done = small.count()
    if not done or large.isEmpty():
        return c, 0
    draws = drawn_rows(small.select("cid", S.uniform_key(seed, "cid").alias("u")), large.select("cid", "w"))
    to = draws.join(large.select(F.col("cid").alias("chosen"), F.col("centroid").alias("to")), "chosen").select("cid", "to")
    weight = F.least(F.col("size"), F.lit(7))
    pulled = F.zip_with("centroid", "to", lambda x, y: (weight * x + y) / (weight + 1))
    out = c.join(to, "cid", "left").select("cid", F.when(F.col("to").isNotNull(), pulled).otherwise(F.col("centroid")).alias("centroid"), "size")
    return store.plain(out, "pulled"), done


class BlockedKMeans:
    """k-means over (vec_id, embedding) whose centroids are a table: `centroids` (cid, centroid) after `fit`. Assignment is exact; ids of vectors are unique."""

    def __init__(self, n_clusters: int, d: int, config: FlatConfig | None = None):
        check_shape(n_clusters, d)
        self.k, self.d, self.cfg = n_clusters, d, config or FlatConfig()
        self.centroids: DataFrame | None = None
        self.stats: list[tuple] = []
        self._store: Store | None = None

    def fit(self, df: DataFrame) -> "BlockedKMeans":
        cfg = self.cfg
        require(self.centroids is None, "The clustering has already been trained")
        df = vectors(df).where("vec_id is not null")
        n = df.count()
        require(n > 0, "n must be positive")
        require(n >= self.k, "n must be >= n_clusters (n < k)")
        size = S.sample_size(n, self.k, cfg.sampling_fraction, cfg.max_points_per_cluster)
        self._store = store = Store(df.sparkSession, size, self.d)
        sample = store.bucketed(S.training_sample(df, n, self.k, cfg), "sample")
        c = store.plain(numbered(sample, self.k, cfg.seed), "centroids")
        cost = 0.0
        for number in range(1, cfg.iters + 1):
            before = cost
            c, cost, moved, repairs = self._iterate(sample, size, c)
            self.stats.append((number, cost, moved, repairs, 0.0, -1.0, 0, True))
            if stops(cfg, number, moved, cost, before):
                break
        store.discard(sample)
        self.centroids = c
        return self

    def _iterate(self, sample: DataFrame, n: int, c: DataFrame) -> tuple[DataFrame, float, float, int]:
        cfg, store = self.cfg, self._store
        found = store.bucketed(D.assign_blocks(sample, c, self.d), "step")
        sums = store.plain(C.cluster_sums(sample.join(found.hint("shuffle_hash"), "vec_id"), self.d, store.buckets), "sums")
        cost = sums.agg(F.sum("cost")).first()[0]
        mean = F.transform("total", lambda x: x / F.col("size"))
        joined = c.join(sums, "cid", "left").select("cid", F.coalesce(mean, "centroid").alias("centroid"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        new = store.plain(joined, "means")
        store.discard(found)
        store.discard(sums)
        repaired, repairs = split_empty(new, cfg.seed, store)
        if cfg.use_aggressive_split:
            repaired, more = pull_small(repaired, n, self.k, cfg.seed, store)
            repairs += more
        value = V.normalized("centroid") if cfg.angular else F.col("centroid")
        after = store.plain(repaired.select("cid", value.alias("centroid")), "centroids")
        moved = C.shift_relational(after, c).first()[0]
        for table in (new, repaired, c):
            store.discard(table)
        return after, float(cost), float(moved), repairs

    def iter_stats(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.stats, ITER_STATS)

    def assign(self, df: DataFrame) -> DataFrame:
        """(vec_id, cid, d2) of any vectors, block against block."""
        require(self.centroids is not None, "assign requires centroids or training first")
        return D.assign_blocks(vectors(df), self.centroids, self.d)

    def release(self) -> None:
        """Remove the stored centroids."""
        if self._store is not None:
            self._store.release()
