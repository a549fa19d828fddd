"""The stored two-level index, versions of a model, and sizes that follow moving vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.config import ClusteringError, FlatConfig, HierConfig
from vecforge.operators import distance as D
from vecforge.plans.flat import KMeans
from vecforge.plans.hierarchical import HierarchicalKMeans
from vecforge.plans.index import TwoLevelIndex
from vecforge.sources import synthetic
from vecforge.sources.models import ModelStore
from vecforge.streaming import assign as streams


def near(rows):
    return {r.vec_id: (r.cid, round(r.d2, 6)) for r in rows.collect()}


def test_index_equals_flat_assignment_with_fewer_products(spark, tmp_path):
    apart = F.transform("embedding", lambda x, i: x + F.when(i == F.col("vec_id") % 8, 60.0).otherwise(0.0))  # eight groups of blobs
    df = synthetic.blobs(spark, 3000, 16, 60).withColumn("embedding", apart.cast("array<float>")).persist()
    m = HierarchicalKMeans(64, 16, HierConfig(suppress_warnings=True, iters_refinement=1)).fit(df)
    index, work = TwoLevelIndex.of(m), spark.sparkContext.accumulator(0)
    assert near(index.assign(df, work)) == near(m.assign(df))
    assert 0 < work.value < 0.6 * 3000 * 64 * 16
    index.write(df, f"{tmp_path}/index")
    clusters = index.clusters(spark, f"{tmp_path}/index").orderBy("meso", "cid").collect()
    assert sum(r.n for r in clusters) == 3000 and len(clusters) == 64
    assert [r.start for r in clusters] == np.cumsum([0, *(r.n for r in clusters)])[:-1].tolist()
    cids = [r.cid for r in clusters if r.n][:3]
    got = index.members(spark, f"{tmp_path}/index", cids)
    assert {r.vec_id for r in got.collect()} == {i for i, (c, _) in near(m.assign(df)).items() if c in cids}
    assert "PushedFilters: [In(cid" in got._jdf.queryExecution().executedPlan().toString()
    for r in clusters:
        assert np.allclose(r.centroid, m.centroids_[r.cid])


def test_index_ties_and_empty_mesos():
    rng = np.random.default_rng(1)
    c = np.repeat(rng.integers(-2, 3, (20, 3)), 2, axis=0).astype(float)
    meso, of = rng.normal(size=(7, 3)), rng.permutation(np.arange(40) % 5)  # two mesos have none
    x = rng.integers(-2, 3, (200, 3)).astype(float)
    at, d2, _ = TwoLevelIndex(c, meso, of).search(x)
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    assert at.tolist() == exact.argmin(1).tolist() and np.allclose(d2, exact.min(1))
    with pytest.raises(ClusteringError, match="training first"):
        TwoLevelIndex.of(HierarchicalKMeans(200, 3))


@pytest.mark.parametrize("pruned", [False, True])
def test_training_goes_on_from_its_last_version(spark, tmp_path, pruned):
    df = synthetic.blobs(spark, 1000, 16, 12).persist()
    cfg = lambda n, **more: FlatConfig(**({"iters": n, "sampling_fraction": 0.8, "early_termination": False, "force_pruning": pruned} | more))
    versions = ModelStore(f"{tmp_path}/versions")
    KMeans(12, 16, cfg(3)).fit(df, versions=versions)
    assert versions.versions(spark) == [2, 3]
    # What a broken run leaves is no version.
    spark.range(1).write.parquet(f"{tmp_path}/versions/iteration=000004/centroids")
    assert versions.versions(spark) == [2, 3]
    got, want = KMeans(12, 16, cfg(5)).fit(df, versions=versions), KMeans(12, 16, cfg(5)).fit(df)
    assert np.allclose(got.centroids_, want.centroids_) and [s[0] for s in got.stats] == [1, 2, 3, 4, 5]
    assert np.allclose([s[1:3] for s in got.stats], [s[1:3] for s in want.stats]) and versions.versions(spark) == [4, 5]
    assert near(got.assign_training_points(df)) == near(want.assign_training_points(df))
    with pytest.raises(ClusteringError, match="other settings"):
        KMeans(12, 16, cfg(6, seed=1)).fit(df, versions=versions)
    with pytest.raises(ClusteringError, match="other vectors"):
        KMeans(12, 16, cfg(6)).fit(df.where("vec_id > 0"), versions=versions)


def test_an_ended_training_stays_ended(spark, tmp_path):
    df = synthetic.separated(spark, 500, 8, 4).persist()
    versions, cfg = ModelStore(f"{tmp_path}/v", kept=1), FlatConfig(iters=30, tol=1e-2)
    first = KMeans(4, 8, cfg).fit(df, versions=versions)
    again = KMeans(4, 8, cfg).fit(df, versions=versions)
    assert len(first.stats) == len(again.stats) < 30 and (first.centroids_ == again.centroids_).all() and len(versions.versions(spark)) == 1


def test_sizes_follow_moving_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(6, 4))
    x = rng.normal(size=(300, 4))
    batches = [[(i, x[i].tolist(), 1) for i in range(300)], [(i, x[(7 * i) % 300].tolist(), 2 + i % 2) for i in range(0, 300, 2)] + [(0, x[5].tolist(), 9), (0, x[9].tolist(), 4)], [(i, x[0].tolist(), 0) for i in range(50)] + [(None, x[0].tolist(), 5), (7, None, 8)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read_stream(spark, f"{tmp_path}/in", "vec_id long, embedding array<float>, at long", 1)
        streams.write_assignments(streams.moves(stream, c, "at"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        last: dict[int, tuple[int, list]] = {}
        for i, v, at in (r for b in batches[: k + 1] for r in b):
            if i is not None and v is not None and at >= last.get(i, (-1, None))[0]:
                last[i] = (at, v)
        home = D.nearest(np.array([v for _, v in last.values()], dtype=np.float32).astype(float), c)
        got = {r.cid: r["size"] for r in streams.sizes_of(spark.read.parquet(f"{tmp_path}/out")).collect()}
        assert got == {int(i): int(n) for i, n in zip(*np.unique(home, return_counts=True), strict=True)}
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("delta")).first()[0] == 300
