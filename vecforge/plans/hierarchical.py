"""Two-level training: sqrt(k) meso clusters, then fine clusters inside each in parallel, then optional global iterations."""

from __future__ import annotations

import hashlib
import json
import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FlatConfig, HierConfig, check_shape, prunes, require
from ..functions.sampling import seeded_key, training_sample
from ..operators import centroids as C
from ..operators import distance as D
from ..operators.rotation import Rotation, Split
from ..schema import HIER_STATS, vectors
from ..sources.tables import centroid_table
from ..timing import Stopwatch
from .flat import KMeans, State, iterate, stops


def half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def fine_budget(sizes: list[int], k: int) -> list[int]:
    """Fine clusters of each meso cluster: by share of the rows left, one at least if it has rows, never more than its rows; k in all.

    The last non-empty meso takes what is left; what exceeds its rows goes to the largest mesos with room.
    """
    require(sum(sizes) >= k, "n must be >= n_clusters (n < k)")
    out, left_k, left_n = [0] * len(sizes), k, sum(sizes)
    filled = [i for i, s in enumerate(sizes) if s > 0]
    for pos, i in enumerate(filled):
        later = len(filled) - pos - 1
        want = half_up(left_k * sizes[i] / left_n) if later else left_k
        if left_k > later:
            want = min(want, left_k - later)
        out[i] = min(max(1, want), sizes[i])
        left_k, left_n = left_k - out[i], left_n - sizes[i]
    while left_k > 0:
        i = max((j for j in filled if out[j] < sizes[j]), key=lambda j: (sizes[j], -j))
        more = min(left_k, sizes[i] - out[i])
        out[i], left_k = out[i] + more, left_k - more
    while left_k < 0:  # more non-empty mesos than k: the smallest ones share
        i = min((j for j in filled if out[j] > 0), key=lambda j: (sizes[j], j))
        out[i], left_k = out[i] - 1, left_k + 1
    return out


def local_kmeans(x: np.ndarray, ids: np.ndarray, k: int, iters: int, seed: int, cfg: FlatConfig) -> tuple[np.ndarray, list[tuple]]:
    """k-means of one group in memory, with the same order, repair and stop rule as the distributed trainer."""
    order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))[:k]
    c, cost, stats = x[order].copy(), 0.0, []
    for number in range(1, iters + 1):
        at = D.nearest(x, c)
        before, cost = cost, float(((x - c[at]) ** 2).sum())
        total, size = np.zeros_like(c), np.zeros(k, dtype=np.int64)
        C.accumulate(at, x, k, total, size)
        new, _, splits = C.consolidated(total, size, c, len(x), cfg.seed, cfg.use_aggressive_split, cfg.angular)
        moved = C.shift(new, c)
        c = new
        stats.append((number, cost, moved, splits, 0.0, -1.0, 0, True))
        if stops(cfg, number, moved, cost, before):
            break
    return c, stats


def marked(df: DataFrame, c: np.ndarray) -> DataFrame:
    """(meso, vec_id, embedding): every vector with its nearest centroid. Narrow, no join."""
    shared = df.sparkSession.sparkContext.broadcast(c)

    def kernel(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, D.SLICE):
                part = batch.slice(a, D.SLICE)
                at = D.nearest(D.matrix(part.column(1), shared.value.shape[1]), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *part.columns], names=["meso", "vec_id", "embedding"])

    element = df.schema["embedding"].dataType.simpleString()
    return df.select("vec_id", "embedding").mapInArrow(kernel, f"meso int, vec_id long, embedding {element}")


def together(rows: DataFrame, budget: dict[int, int], counts: dict[int, int], cfg: HierConfig) -> tuple[dict[int, np.ndarray], list[tuple]]:
    """Fine centroids of several meso clusters that are too large for one task: one job an iteration trains them all.

    First centroids are each meso's first rows of the seeded order; sums and the
    stop rule are each meso's own. A meso that has stopped keeps its centroids.
    """
    of = rows.where(F.col("meso").isin(list(budget)))
    rank = F.row_number().over(Window.partitionBy("meso").orderBy(seeded_key(cfg.seed), "vec_id"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in budget.items() for x in pair]), F.col("meso"))
    first = of.withColumn("rank", rank).where(F.col("rank") <= max(budget.values())).where(F.col("rank") <= wanted)
    found: dict[int, list] = {i: [] for i in budget}
    for r in first.select("meso", "rank", "embedding").collect():  # a row a fine centroid
        found[r.meso].append((r["rank"], r.embedding))
    c = {i: np.array([v for _, v in sorted(x)], dtype=np.float64) for i, x in found.items()}
    active, cost, stats = set(budget), dict.fromkeys(budget, 0.0), []
    tasks = of.select(F.spark_partition_id().alias("p")).distinct().count()
    for number in range(1, cfg.iters_fineclustering + 1):
        start = dict(zip(sorted(active), np.cumsum([0, *(budget[i] for i in sorted(active))]).tolist(), strict=False))
        shared = rows.sparkSession.sparkContext.broadcast((start, {i: c[i] for i in active}))

        def kernel(batches):
            at_of, m = shared.value
            d = next(iter(m.values())).shape[1]
            k = sum(len(x) for x in m.values())
            total, size, cost_ = np.zeros((k, d)), np.zeros(k, dtype=np.int64), np.zeros(k)
            for batch in batches:
                which = np.asarray(batch.column(0))
                for i in np.unique(which).tolist():
                    some = batch.filter(pa.array(which == i))
                    for a in range(0, some.num_rows, D.SLICE):
                        x = D.matrix(some.column(2).slice(a, D.SLICE), d)
                        at = D.nearest(x, m[i])
                        cost_ += np.bincount(at + at_of[i], weights=((x - m[i][at]) ** 2).sum(axis=1), minlength=k)
                        C.accumulate(at + at_of[i], x, k, total, size)
            held = np.flatnonzero(size)
            if len(held):
                yield C.sums_batch(held, size, cost_, np.zeros(k, dtype=np.int64), total)

        sums = {r.cid: r for r in C.partial_sums(of.where(F.col("meso").isin(sorted(active))).select("meso", "vec_id", "embedding").mapInArrow(kernel, C.SUMS), tasks).collect()}
        shared.destroy()
        for i in sorted(active):
            mine = [(j, sums[start[i] + j]) for j in range(budget[i]) if start[i] + j in sums]
            total, size = np.zeros_like(c[i]), np.zeros(budget[i], dtype=np.int64)
            for j, r in mine:
                total[j], size[j] = r.total, r["size"]
            before, cost[i] = cost[i], float(sum(r.cost for _, r in mine))
            new, _, splits = C.consolidated(total, size, c[i], counts[i], cfg.seed, cfg.use_aggressive_split, cfg.angular)
            moved = C.shift(new, c[i])
            c[i] = new
            stats.append(("fine", i, number, cost[i], moved, splits, 0.0, -1.0, 0, True))
            if stops(cfg, number, moved, cost[i], before):
                active.discard(i)
        if not active:
            break
    return c, stats


class HierarchicalKMeans:
    """Two-level k-means over (vec_id, embedding)."""

    def __init__(self, n_clusters: int, d: int, config: HierConfig | None = None):
        check_shape(n_clusters, d)
        self.k, self.d, self.cfg = n_clusters, d, config or HierConfig()
        if n_clusters <= 128 and not self.cfg.suppress_warnings:
            warnings.warn("two-level training is meant for more than 128 clusters", stacklevel=2)
        self.trained, self.stats, self.seconds, self.centroids_ = False, [], 0.0, None
        self.meso_centroids_ = self.meso_of_ = None  # the first level, and the cluster there of each fine centroid

    def fit(self, df: DataFrame) -> "HierarchicalKMeans":
        cfg, watch = self.cfg, Stopwatch()
        require(not self.trained, "already trained")
        df = vectors(df)
        n = df.count()
        require(n > 0, "n must be positive")
        require(n >= self.k, "n must be >= n_clusters (n < k)")
        sample = training_sample(df, n, self.k, cfg, capped=False)
        rotation = None
        if not cfg.unrotate_centroids and not cfg.data_already_rotated:
            rotation = Rotation(self.d, cfg.seed, cfg.epsilon)
            sample = rotation.apply(sample)
        sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
        size = sample.count()

        n_meso = max(1, half_up(math.sqrt(self.k)))
        meso = KMeans(n_meso, self.d, FlatConfig(**{f: getattr(cfg, f) for f in FlatConfig.__dataclass_fields__} | {"iters": cfg.iters_mesoclustering, "sampling_fraction": 1.0, "unrotate_centroids": True, "data_already_rotated": False}))
        meso.fit(sample)
        meso.release()
        self.stats = [("meso", -1, *s) for s in meso.stats]
        rows = marked(sample, meso.centroids_).persist(StorageLevel.MEMORY_AND_DISK)
        counts = {r.meso: r["count"] for r in rows.groupBy("meso").count().collect()}
        budget = fine_budget([counts.get(i, 0) for i in range(n_meso)], self.k)
        offset = np.concatenate([[0], np.cumsum(budget)]).astype(int)
        self.meso_centroids_, self.meso_of_ = meso.centroids_, np.repeat(np.arange(n_meso), budget)
        most = max(1, cfg.max_group_bytes // (8 * self.d))
        large = [i for i in range(n_meso) if counts.get(i, 0) > most and budget[i]]
        self.centroids_ = np.zeros((self.k, self.d))
        if large:
            found, stats = together(rows, {i: budget[i] for i in large}, counts, cfg)
            for i in large:
                self.centroids_[offset[i] : offset[i + 1]] = found[i]
            self.stats += stats

        shares, settings, k_of = budget, cfg, "meso int, local int, centroid array<double>, stats string"

        def fine(key, pdf: pd.DataFrame) -> pd.DataFrame:
            i = int(key[0])
            if not shares[i]:
                return pd.DataFrame({"meso": [], "local": [], "centroid": [], "stats": []})
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            c, stats = local_kmeans(x, pdf["vec_id"].to_numpy(), shares[i], settings.iters_fineclustering, settings.seed, settings)
            return pd.DataFrame({"meso": i, "local": np.arange(len(c)), "centroid": list(c), "stats": [json.dumps(stats)] + [None] * (len(c) - 1)})

        small = rows.where(~F.col("meso").isin(large)) if large else rows
        for r in small.groupBy("meso").applyInPandas(fine, k_of).orderBy("meso", "local").toLocalIterator():  # k rows
            self.centroids_[offset[r.meso] + r.local] = r.centroid
            if r.stats:
                self.stats += [("fine", r.meso, *s) for s in json.loads(r.stats)]
        rows.unpersist()

        if cfg.iters_refinement:
            split = Split.of(self.d)
            pruned = prunes(cfg, self.d, self.k)
            turn = Rotation(self.d, cfg.seed, cfg.epsilon) if pruned else None
            work = turn.apply(sample).persist(StorageLevel.MEMORY_AND_DISK) if pruned else sample
            c = turn.rotate(self.centroids_) if pruned else self.centroids_
            state = State(c, split.partial(3))
            for number in range(1, cfg.iters_refinement + 1):
                iterate(work, size, state, cfg, turn, split, pruned, number)
            self.centroids_ = turn.unrotate(state.c) if pruned else state.c
            self.stats += [("refinement", -1, *s) for s in state.stats]
        sample.unpersist()
        watch.toc()
        self.trained, self.seconds = True, watch.milliseconds / 1000
        return self

    def centroids(self, df: DataFrame) -> DataFrame:
        return centroid_table(df.sparkSession, self.centroids_)

    def iter_stats(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.stats, HIER_STATS)

    def assign(self, df: DataFrame, c: np.ndarray | None = None) -> DataFrame:
        c = self.centroids_ if c is None else np.asarray(c, dtype=np.float64)
        require(c is not None, "assign requires centroids or training first")
        return D.assign(vectors(df), np.arange(len(c), dtype=np.int32), c)
