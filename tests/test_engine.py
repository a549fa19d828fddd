"""Properties of the clustering engine, on shapes small enough for a test run."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge import queries
from vecforge.config import ClusteringError, FlatConfig, HierConfig
from vecforge.functions import sampling as S
from vecforge.functions import vectors as V
from vecforge.operators import centroids as C
from vecforge.operators import distance as D
from vecforge.operators import gemm as G
from vecforge.operators import metrics as M
from vecforge.operators.pruned import search
from vecforge.operators.rotation import Rotation, Split, tuned_partial_d
from vecforge.plans.flat import KMeans
from vecforge.plans.hierarchical import HierarchicalKMeans, fine_budget
from vecforge.schema import checked
from vecforge.sources import synthetic, tables
from vecforge.streaming import assign as stream_assign
from vecforge.timing import Stopwatch


@pytest.mark.parametrize("d", [16, 50, 128, 256])
def test_rotation_keeps_lengths_and_distances(d):
    r, rng = Rotation(d, 42), np.random.default_rng(0)
    x = rng.uniform(-1, 1, (50, d))
    y = r.rotate(x)
    assert np.allclose(r.m @ r.m.T, np.eye(d), atol=1e-10)
    assert np.allclose(r.unrotate(y), x, atol=1e-10)
    assert np.allclose((y**2).sum(1), (x**2).sum(1))
    assert np.allclose(y @ y.T, x @ x.T)
    assert np.array_equal(Rotation(d, 42).m, r.m) and not np.allclose(Rotation(d, 43).m, r.m)


def test_ratios():
    assert Rotation(128, epsilon=1.5).ratios[32] == pytest.approx(0.4002, abs=1e-4)
    assert Rotation(768, epsilon=1.1).ratios[96] == pytest.approx(0.1546, abs=1e-4)
    r = Rotation(64).ratios
    assert r[0] == r[64] == 1.0 and r[63] > 1


def test_split_is_whole_blocks_and_covers_all():
    for d in [*range(1, 300), 384, 512, 768, 1024, 1536, 4096]:
        s = Split.of(d)
        assert s.horizontal % 64 == 0 and s.horizontal + s.vertical == d and s.vertical > 0
        assert d > 64 or s.horizontal == 0
    assert [(Split.of(d).horizontal, Split.of(d).partial()) for d in (128, 257, 768, 1536)] == [(64, 32), (192, 32), (576, 96), (1152, 192)]


def test_tuning():
    assert tuned_partial_d(32, 0.1, 64) == 44 and tuned_partial_d(32, 0.01, 64) == 26
    assert tuned_partial_d(16, 0.0, 64) == 16 and tuned_partial_d(60, 0.9, 64) == 64 and tuned_partial_d(32, 0.04, 64) == 32


def test_columns_tell_the_same(spark):
    rows = spark.range(1, 1400).select(F.col("id").cast("int").alias("d"))
    h, v, p = V.dimension_split(F.col("d"))
    assert [tuple(r) for r in rows.orderBy("d").select(h, v, p).collect()] == [(Split.of(d).horizontal, Split.of(d).vertical, Split.of(d).partial()) for d in range(1, 1400)]
    rates = [0.0, 0.01, 0.03, 0.04, 0.05, 0.06, 0.9]
    cases = spark.createDataFrame([(p, r) for p in (16, 18, 20, 32, 64, 96, 191, 192) for r in rates], "p int, r double")
    assert all(x.n == tuned_partial_d(x.p, x.r, 192) for x in cases.withColumn("n", V.tuned_partial(F.col("p"), F.col("r"), 192)).collect())
    sizes = spark.createDataFrame([(n, f) for n in (10, 999, 70_000) for f in queries.FRACTIONS], "n long, f double")
    for cap in (None, 8):
        assert all(x.s == S.sample_size(x.n, 16, x.f, cap) for x in sizes.withColumn("s", S.sampled(F.col("n"), 16, F.col("f"), cap)).collect())


def test_sample_size_widens_the_float():
    assert [S.sample_size(10, 2, f, 256) for f in (0.7, 0.9, 0.3, 1.0)] == [6, 8, 3, 10]
    assert S.sample_size(10_000, 2, 0.5, 256) == 512


def test_first_rows_is_the_seeded_order(spark):
    df = spark.range(2000).withColumnRenamed("id", "vec_id")
    want = [r.vec_id for r in df.orderBy(S.seeded_key(42), "vec_id").limit(700).collect()]
    got = {r.vec_id for r in S.first_rows(df.repartition(7), 700, 42).collect()}
    assert got == set(want)


def test_fit_and_assign(spark):
    df = synthetic.blobs(spark, 1000, 32, 10)
    m = KMeans(10, 32).fit(df)
    assert m.trained and m.centroids_.shape == (10, 32)
    rows = m.assign(df).toPandas()
    assert len(rows) == 1000 and rows.cid.between(0, 9).all()
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    for r in rows.itertuples():
        d2 = ((x[r.vec_id] - m.centroids_) ** 2).sum(1)
        assert d2[r.cid] <= d2.min() * (1 + 1e-4) and r.d2 == pytest.approx(d2[r.cid])
    with pytest.raises(ClusteringError, match="already been trained"):
        m.fit(df)


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda: KMeans(0, 4), "n_clusters must be positive"),
        (lambda: KMeans(4, 0), "dimensionality must be positive"),
        (lambda: FlatConfig(iters=0), "iters must be positive"),
        (lambda: FlatConfig(sampling_fraction=0), "sampling_fraction must be positive"),
        (lambda: FlatConfig(sampling_fraction=1.5), "sampling_fraction must be <= 1.0"),
        (lambda: FlatConfig(metric="ip"), "l2"),
        (lambda: HierConfig(iters_mesoclustering=0), "iters_mesoclustering must be positive"),
        (lambda: HierConfig(iters_fineclustering=0), "iters_fineclustering must be positive"),
    ],
)
def test_error_contract(make, message):
    with pytest.raises(ClusteringError, match=message):
        make()


def test_error_contract_of_fit(spark):
    few = synthetic.uniform(spark, 3, 4)
    with pytest.raises(ClusteringError, match="n must be positive"):
        KMeans(2, 4).fit(few.where("vec_id < 0"))
    with pytest.raises(ClusteringError, match=r"n must be >= n_clusters \(n < k\)"):
        KMeans(5, 4).fit(few)
    with pytest.raises(ClusteringError, match="Not enough samples"):
        KMeans(3, 4).fit(few)
    with pytest.raises(ClusteringError, match="Queries must be provided"):
        KMeans(1, 4, FlatConfig(sampling_fraction=1.0)).fit(few, n_queries=2)
    with pytest.raises(ClusteringError, match="requires training first"):
        KMeans(2, 4).assign_training_points(few)


def test_early_stop(spark):
    df = synthetic.separated(spark, 2000, 16, 5).persist()
    early = KMeans(5, 16, FlatConfig(iters=40, tol=1e-2)).fit(df)
    never = KMeans(5, 16, FlatConfig(iters=12, early_termination=False)).fit(df)
    assert len(early.stats) < 40 and len(never.stats) == 12


def test_angular_centroids_are_unit(spark):
    m = KMeans(20, 16, FlatConfig(angular=True)).fit(synthetic.blobs(spark, 2000, 16, 20, normalize=True))
    assert np.allclose(np.linalg.norm(m.centroids_, axis=1), 1, atol=1e-9)


def test_rotated_data_gives_the_same_clusters(spark):
    df = synthetic.blobs(spark, 1500, 64, 12).persist()
    a = KMeans(12, 64, FlatConfig(sampling_fraction=1.0)).fit(df)
    r = Rotation(64)
    b = KMeans(12, 64, FlatConfig(sampling_fraction=1.0, data_already_rotated=True)).fit(r.apply(df))
    assert np.allclose(r.unrotate(b.centroids_), a.centroids_, atol=1e-3)


def test_pruned_search_agrees():
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 10, (300, 128))
    x = middle[rng.integers(300, size=2000)] + rng.normal(0, 1, (2000, 128))
    r, split = Rotation(128), Split.of(128)
    xr, cr = r.rotate(x), r.rotate(middle)
    truth = D.nearest(x, middle)
    for seeds in (rng.integers(300, size=2000), None):
        at, d2, count, work = search(xr, seeds, cr, r.ratios, split, split.partial())
        assert (at == truth).mean() >= 0.98 and np.allclose(d2, ((xr - cr[at]) ** 2).sum(1))
    assert work < 0.5 * len(x) * 300 * 128  # with a bound of its own: less than half of an exact search's products


def test_pruned_training(spark):
    df = synthetic.blobs(spark, 3000, 128, 300).persist()
    m = KMeans(260, 128, FlatConfig(iters=3, sampling_fraction=0.9)).fit(df)
    assert m.uses_pruning and m.stats[0][5] == -1 and 0 < m.stats[-1][5] < 1
    assert M.agreement(m.assign_training_points(df), m.assign(df)).first()[0] >= 0.98
    exact = 2700 * 260 * 128
    assert m.multiplications < exact + 0.5 * (len(m.stats) - 1) * exact  # the first iteration is exact
    other = m.centroids_[::-1].copy()
    assert M.agreement(m.assign_training_points(df, other), m.assign(df, other)).first()[0] >= 0.98
    assert m.assign_training_points(df, other[:5]).orderBy("vec_id").collect() == m.assign(df, other[:5]).orderBy("vec_id").collect()  # any number of centroids
    with pytest.raises(ClusteringError, match="centroids must have width"):
        m.assign_training_points(df, other[:, :5])
    assert m.assign(df).select("cid").distinct().count() >= 200


def test_ties_go_to_the_lowest_id(spark):
    c = np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.cid for r in D.assign(df, np.arange(3, dtype=np.int32), c).collect()} == {0: 0, 1: 0}
    cents = tables.centroid_table(spark, c)
    assert {r.vec_id: r.cid for r in D.assign_relational(df, cents, 2).collect()} == {0: 0, 1: 0}
    assert [r.neighbor_id for r in D.knn(df.where("vec_id = 0"), np.arange(3, dtype=np.int32), c, 3).orderBy("rank").collect()] == [0, 1, 2]
    padded = D.knn(df.where("vec_id = 0"), np.arange(3, dtype=np.int32), c, 4, pad=True).orderBy("rank").collect()
    assert padded[3].neighbor_id is None and padded[3].d2 is None


def test_product_takes_all_rows(spark, sf):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], dtype=np.float64)
    got = np.zeros((64, 64))
    for r in queries.QUERIES["gemm_dims"](spark, sf).collect():
        got[r.i, r.j] = r.value
    assert np.abs(got - x.T @ x).max() < 1e-5
    assert G.gram_of_dims(spark.createDataFrame([], "vec_id long, embedding array<float>"), 2).where("value != 0").count() == 0


@pytest.mark.parametrize("name", ["knn_topk", "knn_sql"])
def test_neighbours_come_from_all_rows(spark, sf, name):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = queries.QUERIES[name](spark, sf).collect()
    k = max(r.rank for r in found)
    got = {(r.query_id, r.rank): r.neighbor_id for r in found}
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        order = [ids[i] for i in np.lexsort((ids, ((x - x[q]) ** 2).sum(axis=1))) if i != q]
        want |= {(ids[q], r + 1): order[r] for r in range(k)}
    assert got == want and any(n % 20 == 0 for n in got.values())


def test_searches_in_blocks_broadcast_nothing(spark, monkeypatch):
    """Many small blocks, copies that tie, more neighbours asked for than there are, null ids."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 8 * 4 * 10)
    monkeypatch.setattr(D, "TIES", 1)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.integers(-2, 3, (30, 4)), 3, axis=0).astype(float)
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (None, [0.0] * 4)], "vec_id long, embedding array<float>")
    p = df.toDF("cid", "centroid")
    found = D.knn_blocks(df, p, 5, 4)
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in found.collect()}
    want = {(q, r + 1): int(i) for q in range(90) for r, i in enumerate(np.lexsort((np.arange(90), ((x - x[q]) ** 2).sum(1)))[:5])}
    assert got == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert D.knn_blocks(df.where("vec_id < 2"), p.where("cid < 3"), 5, 4).count() == 6
    assert D.knn_blocks(df.limit(0), p, 5, 4).count() == 0 and D.knn_blocks(df, p.limit(0), 5, 4).count() == 0
    near = {r.vec_id: r.cid for r in D.assign_blocks(df, p.where("cid < 20"), 4).collect()}
    assert near == {i: int(D.nearest(x[i : i + 1], x[:20])[0]) for i in range(90)}


def test_joined_blocks_measure_pairs_as_products(spark, monkeypatch):
    """Blocks on both sides, copies that tie across them, null ids, few points; a query's vector does not move once for each block of points, nor is a pair measured value by value."""
    monkeypatch.setattr(D, "SLICE", 8)
    monkeypatch.setattr(D, "TIES", 1)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(-2, 3, (30, 4)), 3, axis=0).astype(float)
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (None, [0.0] * 4)], "vec_id long, embedding array<float>")
    p = df.toDF("cid", "centroid")
    for rows in (7, 1000):
        found = D.knn_relational(df, p, 5, 4, block_rows=rows)
        got = {(r.query_id, r["rank"]): (r.neighbor_id, r.d2) for r in found.collect()}
        d2 = ((x[:, None] - x) ** 2).sum(axis=2)
        assert got == {(q, r + 1): (int(i), d2[q, i]) for q in range(90) for r, i in enumerate(np.lexsort((np.arange(90), d2[q]))[:5])}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan and plan.index("Generate") < plan.index("collect_list")
    assert D.knn_relational(df.where("vec_id < 2"), p.where("cid < 3"), 5, 4).count() == 6
    assert D.knn_relational(df.limit(0), p, 5, 4).count() == 0 and D.knn_relational(df, p.limit(0), 5, 4).count() == 0
    with pytest.raises(Exception, match="vectors must have width"):
        D.knn_relational(df, p, 5, 3).collect()


def test_too_much_to_broadcast_is_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 100)
    df = spark.createDataFrame([(0, [1.0] * 8)], "vec_id long, embedding array<float>")
    c = np.zeros((2, 8))
    for search_ in (lambda: D.assign(df, np.arange(2), c), lambda: D.knn(df, np.arange(2), c, 1), lambda: D.assign_relational(df, tables.centroid_table(spark, c), 8)):
        with pytest.raises(ClusteringError, match="blocks"):
            search_()


def test_products(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(7, 6))
    table = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")

    def of(rows, shape):
        out = np.zeros(shape)
        for r in rows.collect():
            out[r.i, r.j] = r.value
        return out

    assert np.allclose(of(G.product(table(a), table(b), trans_a=True), (5, 6)), a.T @ b)
    assert np.allclose(of(G.product(table(a), table(b.T), columns_a=5), (7, 7)), a @ b.T[:5])
    assert np.allclose(of(G.product(table(a), table(b), trans_b=True, columns_a=3, columns_b=3), (7, 7)), a[:, :3] @ b[:, :3].T)
    both = rng.normal(size=(6, 5))
    assert np.allclose(of(G.product(table(a.T), table(both), True, True), (7, 6)), a @ both.T)
    m = rng.normal(size=(4, 3))
    got = {r.vec_id: r["product"] for r in G.rows_times(table(a), m, columns=4).collect()}
    assert np.allclose([got[i] for i in range(7)], a[:, :4] @ m)
    got = {r.vec_id: r["product"] for r in G.rows_times(table(a), rng.normal(size=(2, 5)), trans_b=True).collect()}
    assert len(got[0]) == 2


def test_stopwatch_adds_up():
    w = Stopwatch()
    w.tic()
    w.toc()
    once = w.milliseconds
    w.tic()
    w.toc()
    assert 0 <= once <= w.milliseconds
    w.reset()
    assert w.milliseconds == 0


def test_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(C, "BRANCH", 3)
    df = synthetic.uniform(spark, 400, 6, partitions=20)
    c = np.random.default_rng(2).normal(size=(5, 6))
    rows = {r.cid: r for r in C.updated(df, np.arange(5, dtype=np.int32), c, 20).collect()}
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    at = D.nearest(x, c)
    for i in np.unique(at).tolist():
        assert rows[i]["size"] == (at == i).sum() and np.allclose(rows[i].total, x[at == i].sum(0)) and rows[i].cost == pytest.approx(((x[at == i] - c[i]) ** 2).sum())


def test_own_row_is_left_out_among_copies(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    base = v.select(F.col("vec_id").cast("int").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))
    for found in (D.knn(v, *D.collected(base), 3), D.knn_relational(v, base, 3, 2), D.knn_blocks(v, base, 3, 2)):
        got = sorted((r.query_id, r.rank, r.neighbor_id) for r in D.other_neighbors(found, 2).collect())
        assert got == [(q, r + 1, n) for q in range(5) for r, n in enumerate([n for n in range(5) if n != q][:2])]


def test_repairs():
    c, sizes = np.random.default_rng(0).normal(size=(6, 4)), np.array([50, 0, 30, 0, 15, 5])
    new, sz = c.copy(), sizes.copy()
    assert C.split_empty(new, sz, 100, np.random.default_rng(1)) == 2
    assert (sz > 0).all() and sz.sum() == 100
    small = c.copy()
    assert C.pull_small(small, np.array([60, 1, 30, 2, 5, 2]), 100, np.random.default_rng(1)) == 3


def test_balance(spark):
    a = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(8)], "vec_id long, cid int")
    r = M.balance(a, 4).first()
    assert (r["mean"], r["min"], r["max"]) == (2.0, 0, 6)
    assert r.geometric_mean == pytest.approx(12**0.5) and r.stdev == pytest.approx(np.std([6, 2, 0, 0]))


def test_budget_is_exact():
    for sizes, k in (([10, 0, 5, 1], 6), ([3, 3, 3], 9), ([100, 1, 1, 0], 20), ([5, 5, 0], 3), ([1, 1, 1, 1, 96], 40)):
        b = fine_budget(sizes, k)
        assert sum(b) == k and all(x <= s for x, s in zip(b, sizes, strict=True)) and all(x > 0 for x, s in zip(b, sizes, strict=True) if s)


def test_hierarchical(spark):
    df = synthetic.blobs(spark, 2000, 16, 40).persist()
    m = HierarchicalKMeans(40, 16, HierConfig(suppress_warnings=True, iters_refinement=2)).fit(df)
    assert m.centroids_.shape == (40, 16) and {s[0] for s in m.stats} == {"meso", "fine", "refinement"}
    out = m.assign(df)
    assert out.agg(F.sum("d2")).first()[0] < KMeans(6, 16, FlatConfig(sampling_fraction=1.0)).fit(df).assign(df).agg(F.sum("d2")).first()[0]
    big = HierarchicalKMeans(40, 16, HierConfig(suppress_warnings=True, max_group_bytes=100 * 8 * 16)).fit(df)
    small = HierarchicalKMeans(40, 16, HierConfig(suppress_warnings=True)).fit(df)
    # Groups too large for one task are trained together by distributed iterations, to the same centroids.
    assert np.allclose(big.centroids_, small.centroids_) and sorted(s[:3] for s in big.stats) == sorted(s[:3] for s in small.stats)
    with pytest.warns(UserWarning):
        HierarchicalKMeans(20, 16)


def test_checked_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (None, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    assert checked(df, 2, drop=True).count() == 1
    with pytest.raises(ClusteringError, match="3 rows"):
        checked(df, 2)


def test_generators_ignore_partitioning(spark):
    a = synthetic.blobs(spark, 100, 8, 5, partitions=1).orderBy("vec_id").collect()
    assert a == synthetic.blobs(spark, 100, 8, 5, partitions=7).orderBy("vec_id").collect()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, fmt):
    df = synthetic.uniform(spark, 20, 4)
    tables.write_vectors(df, f"{tmp_path}/{fmt}", fmt)
    assert tables.read_vectors(spark, f"{tmp_path}/{fmt}", fmt).orderBy("vec_id").collect() == df.orderBy("vec_id").collect()


def test_stream_equals_batch(spark, tmp_path):
    df = synthetic.uniform(spark, 200, 4)
    df.write.parquet(f"{tmp_path}/in")
    c = np.random.default_rng(0).normal(size=(5, 4))
    q = stream_assign.write_assignments(stream_assign.assigned_stream(stream_assign.read_stream(spark, f"{tmp_path}/in"), c), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("vec_id").collect()
    assert got == D.assign(df, np.arange(5, dtype=np.int32), c).orderBy("vec_id").collect()


def test_windowed_sizes(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.array(F.col("id").cast("float") % 2, F.lit(0.0).cast("float")).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream_assign.windowed_sizes(stream, np.array([[0.0, 0.0], [1.0, 0.0]]), "ts").writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sizes").agg(F.sum("size")).first()[0] == 60 and spark.table("sizes").count() == 6


def test_kernels_match_columns(spark):
    df = synthetic.uniform(spark, 50, 8)
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=float)
    pairs = df.crossJoin(df.select(F.col("vec_id").alias("w"), F.col("embedding").alias("b")))
    for r in pairs.select("vec_id", "w", V.l2_squared("embedding", "b").alias("d"), V.dot("embedding", "b").alias("p")).collect()[:300]:
        assert r.d == pytest.approx(((x[r.vec_id] - x[r.w]) ** 2).sum()) and r.p == pytest.approx(x[r.vec_id] @ x[r.w])


@pytest.mark.parametrize("seeded", [False, True])
def test_pruned_search_holds_few_distances_at_once(seeded):
    """A slice of vectors with nothing to prune: all pairs are measured, some MB at a time."""
    rng = np.random.default_rng(12)
    x, c = rng.standard_normal((4096, 128)), rng.standard_normal((300, 128))
    split, seeds = Split.of(128), (rng.integers(0, 300, 4096) if seeded else None)
    want = D.nearest(x, c)
    tracemalloc.start()
    at, d2, _, _ = search(x, seeds, c, Rotation(128, 42, 8.0).ratios, split, split.partial())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (at == want).all() and np.allclose(d2, ((x - c[want]) ** 2).sum(axis=1))
    assert peak < 48 << 20
