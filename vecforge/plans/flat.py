"""One-level training: one Spark job an iteration, assignment and centroid sums fused in one narrow pass."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_BYTES, F32_EPSILON, RECALL_PATIENCE, FlatConfig, check_shape, prunes, require
from ..functions.sampling import first_matrix, first_rows, sample_size, training_sample, uniform_key
from ..operators import centroids as C
from ..operators import distance as D
from ..operators.pruned import assign_pruned, seeded_search, seeds_of
from ..operators.rotation import Rotation, Split, tuned_partial_d
from ..schema import ITER_STATS, vectors
from ..sources.models import ModelStore
from ..sources.storage import Store
from ..sources.tables import centroid_table
from ..timing import Stopwatch
from .seeds import WEIGHTED_SHARE, by_meso, by_size, known, stored


@dataclass
class State:
    """What an iteration hands to the next."""

    c: np.ndarray
    partial: int
    tasks: int = 1
    cost: float = 0.0
    multiplications: int = 0
    stats: list[tuple] = field(default_factory=list)
    sizes: np.ndarray | None = None
    step: DataFrame | None = None  # the stored table of the last iteration
    assigned: DataFrame | None = None  # its assignments


#: What an iteration with a store writes: a row of each assignment, and rows of sums, which have a size.
STEP = f"vec_id long, {C.SUMS}"


def iterate(sample: DataFrame, n: int, state: State, cfg: FlatConfig, rotation: Rotation | None, split: Split, pruned: bool, number: int, store: Store | None = None) -> float:
    """Assign to the current centroids, replace them by repaired means, note the statistics; returns the shift.

    One narrow pass gives the sums of each task. With a `store` the same pass
    writes the assignments beside them, bucketed like the sample, and a pruned
    search starts from those of the iteration before: a join of equal buckets,
    without an exchange. Without one, a pruned search bounds itself by the
    prefix products that it needs anyway.
    """
    c, partial = state.c, state.partial
    spark = sample.sparkSession
    work = spark.sparkContext.accumulator(0)
    if not pruned and store is None:
        pieces = C.updated(sample, np.arange(len(c), dtype=np.int32), c, state.tasks)
    else:
        ratios = rotation.ratios if rotation is not None else None
        seeded = pruned and state.assigned is not None
        shared = spark.sparkContext.broadcast((c, ratios))
        keep = store is not None

        def kernel(batches):
            m, r = shared.value
            k, d = m.shape
            total, size, cost, kept = np.zeros((k, d)), np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros(k, dtype=np.int64)
            for batch in batches:
                all_x = D.matrix(batch.column(1), d)
                seeds = seeds_of(batch.column(2), k) if seeded else np.full(len(all_x), -1)
                for a in range(0, len(all_x), D.SLICE):
                    x = all_x[a : a + D.SLICE]
                    if pruned:
                        at, d2, count, products = seeded_search(x, seeds[a : a + D.SLICE], m, r, split, partial)
                        work.add(products)
                        kept += np.bincount(at, weights=count, minlength=k).astype(np.int64)
                    else:
                        at = D.nearest(x, m)
                        d2 = ((x - m[at]) ** 2).sum(axis=1)
                    cost += np.bincount(at, weights=d2, minlength=k)
                    C.accumulate(at, x, k, total, size)
                    if keep:
                        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(at)), pa.array(at.astype(np.int32)), *none], names=_STEP_NAMES)
            held = np.flatnonzero(size)
            if len(held):
                sums = C.sums_batch(held, size, cost, kept, total)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), *sums.columns], names=_STEP_NAMES) if keep else sums

        rows = sample.join(stored(state.assigned), "vec_id", "left") if seeded else sample
        told = rows.select("vec_id", "embedding", *(["prev_cid"] if seeded else [])).mapInArrow(kernel, STEP if keep else C.SUMS)
        if keep:
            step = store.bucketed(told, "step", dealt=True)
            told = step.where("size is not null").select("cid", "size", "cost", "kept", "total")
        pieces = C.partial_sums(told, state.tasks)
    cids, sizes, costs, kepts, totals = C.summed(pieces, c.shape[1])
    k, d = c.shape
    total, size = np.zeros((k, d)), np.zeros(k, dtype=np.int64)
    total[cids], size[cids] = totals, sizes
    if pruned or store is not None:
        shared.destroy()
    if store is not None:
        store.discard(state.step)
        state.step, state.assigned = step, step.where("size is null").select("vec_id", "cid")
    cost = float(costs.sum())
    share = int(kepts.sum()) / (n * k) if pruned else -1.0
    new, state.sizes, splits = C.consolidated(total, size, c, n, cfg.seed, cfg.use_aggressive_split, cfg.angular)
    moved = C.shift(new, c)
    state.multiplications += work.value if pruned else n * k * d
    state.stats.append((number, cost, moved, splits, 0.0, float(share), partial if pruned else 0, not pruned))
    if pruned:
        state.partial = tuned_partial_d(partial, share, split.vertical, cfg.min_not_pruned_pct, cfg.max_not_pruned_pct, cfg.adjustment_factor_for_partial_d)
    state.c, state.cost = new, cost
    if cfg.verbose:
        print(f"iteration {number}: objective {cost:.6g}, shift {moved:.6g}, {splits} repairs")
    return moved


_STEP_NAMES = ["vec_id", "cid", "size", "cost", "kept", "total"]


def stops(cfg: FlatConfig, number: int, moved: float, cost: float, before: float, patience: "Patience | None" = None, recall: float = 0.0) -> bool:
    """Small total shift, from the second iteration a cost that hardly falls or rises, or, where recall is tracked, no better recall for a while."""
    if not cfg.early_termination:
        return False
    if moved < cfg.tol or (number > 1 and cost / max(before, F32_EPSILON) > 1 - cfg.tol):
        return True
    return patience is not None and patience.ends(recall, cfg.recall_tol)


@dataclass
class Patience:
    """Ends training once recall has failed to improve by more than the tolerance RECALL_PATIENCE times in a row."""

    best: float = 0.0
    without: int = 0

    def ends(self, recall: float, tol: float) -> bool:
        if recall - self.best > tol:
            self.best, self.without = recall, 0
            return False
        self.without += 1
        return self.without >= RECALL_PATIENCE


class Recall:
    """Recall of a search that looks into each query's nearest clusters only, against the true neighbours in the training sample.

    The neighbours are found once, exactly, block against block, and stored
    with both vectors, a row a pair; an iteration is one narrow job over them.
    """

    def __init__(self, queries: DataFrame, sample: DataFrame, d: int, k: int, cfg: FlatConfig):
        self.store = Store(sample.sparkSession)
        points = sample.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))
        near = D.knn_blocks(queries, points, cfg.recall_neighbours, d).select("query_id", "neighbor_id")
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
        found = sample.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("y"))
        self.pairs = self.store.plain(near.join(found, "neighbor_id").join(asked, "query_id").select("x", "y"), "truth")
        self.probes = max(1, int(k * cfg.explored))

    def of(self, c: np.ndarray) -> float:
        shared, probes = self.pairs.sparkSession.sparkContext.broadcast(c), self.probes

        def kernel(batches):
            m = shared.value
            step = max(1, (1 << 22) // len(m))
            hit = total = 0
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    x, y = (D.matrix(batch.column(i).slice(a, step), m.shape[1]) for i in (0, 1))
                    home = D.nearest(y, m)
                    d2 = x @ (-2.0 * m.T) + (m * m).sum(axis=1)
                    own = d2[np.arange(len(x)), home][:, None]
                    # the neighbour's cluster is explored if fewer than `probes` are nearer to the query; ties by lower id
                    nearer = (d2 < own) | ((d2 == own) & (np.arange(len(m)) < home[:, None]))
                    hit += int((nearer.sum(axis=1) < probes).sum())
                    total += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([hit]), pa.array([total])], names=["hit", "total"])

        r = self.pairs.mapInArrow(kernel, "hit long, total long").agg(F.sum("hit"), F.sum("total")).first()
        return r[0] / r[1] if r[1] else 0.0


class KMeans:
    """k-means over (vec_id, embedding) DataFrames. `fit` once, then `assign` any vectors."""

    def __init__(self, n_clusters: int, d: int, config: FlatConfig | None = None):
        check_shape(n_clusters, d)
        self.k, self.d, self.cfg = n_clusters, d, config or FlatConfig()
        self.split = Split.of(d)
        self.trained, self.stats, self.seconds = False, [], 0.0
        self.centroids_: np.ndarray | None = None
        self.sizes_: np.ndarray | None = None
        self._store: Store | None = None
        self._sample = self.assigned_ = None

    @property
    def uses_pruning(self) -> bool:
        return prunes(self.cfg, self.d, self.k)

    def _rotation(self) -> Rotation:
        return Rotation(self.d, self.cfg.seed, self.cfg.epsilon)

    def fit(self, df: DataFrame, queries: DataFrame | None = None, n_queries: int = 0, versions: ModelStore | None = None) -> "KMeans":
        """Train. Pruned training works in the rotated domain, exact training needs no rotation.

        With `queries` (vec_id, embedding), the first n_queries of their seeded
        order (0: all), or with that many sampled from the vectors themselves,
        each iteration notes its recall, and training ends early once recall no
        longer improves. With `versions` each iteration is stored; a training of
        the same shape, settings (but for the number of iterations) and number
        of vectors goes on after the last one that is.
        """
        cfg, watch = self.cfg, Stopwatch()
        require(not self.trained, "The clustering has already been trained")
        require(not (n_queries > 0 and queries is None and not cfg.sample_queries), "Queries must be provided if n_queries > 0 and sample_queries is off")
        df = vectors(df)
        n = df.count()
        require(n > 0, "n must be positive")
        require(n >= self.k, "n must be >= n_clusters (n < k)")
        require(self.k * self.d * 8 <= BROADCAST_BYTES, "too many centroids to broadcast; use BlockedKMeans")
        sample = training_sample(df, n, self.k, cfg)
        rotated = (self.uses_pruning or not cfg.unrotate_centroids) and not cfg.data_already_rotated
        rotation = self._rotation() if self.uses_pruning or rotated else None
        if rotated:
            sample = rotation.apply(sample)
        if self.uses_pruning:
            size = sample_size(n, self.k, cfg.sampling_fraction, cfg.max_points_per_cluster)
            self._store = Store(df.sparkSession, size, self.d)
            sample = self._store.bucketed(sample.select("vec_id", "embedding"), "sample")
            tasks = self._store.buckets
        else:
            sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
            size = sample.count()
            tasks = sample.select(F.spark_partition_id().alias("p")).distinct().count() if size > C.BRANCH * 1000 else 1
        same = {k: v for k, v in asdict(cfg).items() if k not in ("iters", "verbose", "suppress_warnings")} | {"k": self.k, "d": self.d, "n": n}
        begun = versions.latest(df.sparkSession) if versions is not None else None
        if begun is None:
            # The seeded order is the same for all rows and the sample, so the first centroids are the sample's first rows.
            state, done = State(first_matrix(sample, self.k, cfg.seed)[1], self.split.partial(), tasks), 0
        else:
            done, c, told = begun
            require(told["same"] == same, "the stored training has another shape, other settings or other vectors")
            state = State(c, told["partial"], tasks, told["cost"], told["multiplications"], [tuple(x) for x in told["stats"]], np.array(told["sizes"]))
        tracked, patience = None, None
        if queries is not None or n_queries > 0:
            asked = vectors(df if queries is None else queries)
            asked = first_rows(asked, n_queries, cfg.seed + 1) if n_queries > 0 else asked
            tracked, patience = Recall(rotation.apply(asked) if rotated else asked, sample, self.d, self.k, cfg), Patience(*(begun[2]["patience"] if begun else ()))
        ended = begun is not None and begun[2]["ended"]
        for number in range(cfg.iters + 1 if ended else done + 1, cfg.iters + 1):
            before = state.cost
            moved = iterate(sample, size, state, cfg, rotation, self.split, self.uses_pruning and number > 1, number, self._store)
            recall = 0.0
            if tracked is not None:
                recall = tracked.of(state.c)
                state.stats[-1] = (*state.stats[-1][:4], recall, *state.stats[-1][5:])
            ended = stops(cfg, number, moved, state.cost, before, patience, recall)
            if versions is not None:
                told = {"same": same, "partial": state.partial, "cost": state.cost, "multiplications": state.multiplications, "stats": state.stats, "sizes": state.sizes.tolist(), "patience": [patience.best, patience.without] if patience else [], "ended": ended}
                versions.save(df.sparkSession, number, state.c, told)
            if ended:
                break
        if tracked is not None:
            tracked.store.release()
        self.working_ = state.c  # in the training's domain
        self.centroids_ = rotation.unrotate(state.c) if rotated and cfg.unrotate_centroids else state.c
        self.stats, self.trained, self.multiplications = state.stats, True, state.multiplications
        self.sizes_, self.assigned_ = state.sizes, state.assigned
        if self._store is None:
            sample.unpersist()
        else:
            self._sample = sample
        watch.toc()
        self.rotated, self.seconds = rotated, watch.milliseconds / 1000
        return self

    def release(self) -> None:
        """Remove the stored sample and assignments of a pruned training; later searches of the training vectors go without seeds."""
        if self._store is not None:
            self._store.release()
        self._store = self._sample = self.assigned_ = None

    def centroids(self, df: DataFrame) -> DataFrame:
        """(cid, centroid) as a DataFrame of df's session."""
        return centroid_table(df.sparkSession, self.centroids_)

    def iter_stats(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.stats, ITER_STATS)

    def assign(self, df: DataFrame, c: np.ndarray | None = None) -> DataFrame:
        """Exact nearest centroid of any vectors: (vec_id, cid, d2). Works untrained with centroids given."""
        c = self.centroids_ if c is None else np.asarray(c, dtype=np.float64)
        require(c is not None, "assign requires centroids or training first")
        return D.assign(vectors(df), np.arange(len(c), dtype=np.int32), c)

    def _seeded(self, df: DataFrame | None, c: np.ndarray) -> tuple[DataFrame, Callable | None]:
        """Training vectors in the search's domain with their stored seeds and uniform numbers, and what gives the others a seed."""
        if df is None:
            require(self._sample is not None, "no training vectors are stored; pass them")
            rows = self._sample
        else:
            rows = vectors(df) if self.cfg.data_already_rotated else self._rotation().apply(vectors(df))
        rows = known(rows, self.assigned_, len(c)).withColumn("u", uniform_key(self.cfg.seed + 1))
        share = self.cfg.sampling_fraction
        if share == 1.0 or self.assigned_ is None:
            return rows, None
        return rows, by_size(self.sizes_[: len(c)]) if share > WEIGHTED_SHARE else by_meso(rows.sparkSession, c, self.cfg)

    def _searched(self, centroids: np.ndarray | None) -> np.ndarray:
        """Checked centroids, of any number, for a search of the training vectors."""
        require(self.trained, "assign_training_points requires training first")
        c = self.centroids_ if centroids is None else np.asarray(centroids, dtype=np.float64)
        require(c.ndim == 2 and len(c) > 0 and c.shape[1] == self.d, f"centroids must have width {self.d}")
        return c

    def _turned(self, c: np.ndarray) -> np.ndarray:
        """Centroids of the vectors' domain in that of the search."""
        return self._rotation().rotate(c) if not self.cfg.data_already_rotated and self.cfg.unrotate_centroids else c

    def training_seeds(self, df: DataFrame | None = None) -> DataFrame:
        """(vec_id, prev_cid): where `assign_training_points` starts each training vector; null: from its least prefix."""
        c = self._turned(self._searched(None))
        rows, fill = self._seeded(df, c)
        if fill is None:
            return rows.select("vec_id", "prev_cid")
        shared = rows.sparkSession.sparkContext.broadcast(fill)

        def kernel(batches):
            for batch in batches:
                seeds, x = seeds_of(batch.column(2), len(c)), D.matrix(batch.column(1), c.shape[1])
                gap = np.flatnonzero(seeds < 0)
                if len(gap):
                    seeds[gap] = shared.value(x[gap], np.asarray(batch.column(3))[gap])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seeds.astype(np.int32))], names=["vec_id", "prev_cid"])

        return rows.select("vec_id", "embedding", "prev_cid", "u").mapInArrow(kernel, "vec_id long, prev_cid int")

    def assign_training_points(self, df: DataFrame | None = None, centroids: np.ndarray | None = None, work: Accumulator | None = None) -> DataFrame:
        """Pruned assignment of the training vectors: (vec_id, cid, d2), to the trained centroids or to any others of their width.

        Each search starts from the vector's assignment in training; vectors
        outside the sample are seeded as `seeds` tells. Without `df` the stored
        sample is searched, whose join with the assignments exchanges nothing;
        other tables meet them by vec_id. Pruning depends on the number of the
        centroids searched: with too few of them the assignment is exact.
        """
        c = self._searched(centroids)
        if not prunes(self.cfg, self.d, len(c)):
            if not self.cfg.suppress_warnings:
                warnings.warn("pruning is unavailable for this shape; assigning exactly", stacklevel=2)
            require(df is not None, "no training vectors are stored; pass them")
            return self.assign(df, c)
        c = self._turned(c)
        rows, fill = self._seeded(df, c)
        found = assign_pruned(rows, c, self._rotation().ratios, self.split, self.split.partial(), "prev_cid", fill, "u", work)
        return found.select("vec_id", "cid", "d2")
