"""Stored seeds, centroid tables, inverted lists, tiles and recall, against brute force and the in-memory forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.config import ClusteringError, FlatConfig
from vecforge.functions import sampling as S
from vecforge.operators import centroids as C
from vecforge.operators import distance as D
from vecforge.operators import gemm as G
from vecforge.operators import lists as L
from vecforge.operators import metrics as M
from vecforge.operators import slabs
from vecforge.plans import blocked
from vecforge.plans.blocked import BlockedKMeans
from vecforge.plans.flat import KMeans
from vecforge.sources import synthetic
from vecforge.sources.storage import Store
from vecforge.sources.tables import centroid_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors_of(spark, m, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")


# --- seeds -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    df = synthetic.blobs(spark, 3000, 128, 300).persist()
    return df, KMeans(260, 128, FlatConfig(iters=3, sampling_fraction=1.0)).fit(df)


def test_stored_seeds_exchange_nothing_and_save_products(spark, trained):
    df, m = trained
    work = [spark.sparkContext.accumulator(0) for _ in range(2)]
    seeded = m.assign_training_points(work=work[0])
    assert "Exchange" not in plan(seeded) and "ShuffledHashJoin" in plan(seeded)
    exact = m.assign(df)
    assert M.agreement(seeded, exact).first()[0] >= 0.98 and seeded.count() == 3000
    spark.sparkContext.setJobGroup("", "")
    work[0].value = 0
    seeded.write.format("noop").mode("overwrite").save()
    held, m.assigned_ = m.assigned_, None
    m.assign_training_points(df, work=work[1]).write.format("noop").mode("overwrite").save()
    m.assigned_ = held
    assert 0 < work[0].value < work[1].value


def test_seeds_of_the_sample_are_its_last_assignments(spark, trained):
    df, m = trained
    # The last iteration assigned to centroids whose means are the trained ones.
    told = m.training_seeds(df).join(df, "vec_id").groupBy("prev_cid").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.prev_cid: r.n for r in told.collect()}
    whole = {i: int(n) for i, n in enumerate(m.sizes_) if n}
    assert sum(sizes.values()) == 3000 and sum(sizes.get(i) == n for i, n in whole.items()) > 200


@pytest.mark.parametrize("share", [0.9, 0.5])
def test_vectors_outside_the_sample_get_seeds(spark, share):
    df = synthetic.blobs(spark, 2000, 128, 280).persist()
    m = KMeans(260, 128, FlatConfig(iters=2, sampling_fraction=share)).fit(df)
    seeds = m.training_seeds(df)
    assert seeds.count() == 2000 and seeds.where("prev_cid is null or prev_cid < 0 or prev_cid >= 260").count() == 0
    assert M.agreement(m.assign_training_points(df), m.assign(df)).first()[0] >= 0.98
    more = np.concatenate([m.centroids_, m.centroids_[:40] + 0.5])
    assert M.agreement(m.assign_training_points(df, more), m.assign(df, more)).first()[0] >= 0.98
    m.release()
    assert M.agreement(m.assign_training_points(df), m.assign(df)).first()[0] >= 0.98
    with pytest.raises(ClusteringError, match="stored"):
        m.assign_training_points()


def test_repeated_ids_keep_their_rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    df = vectors_of(spark, x).unionByName(vectors_of(spark, x[:50]))
    m = KMeans(6, 8, FlatConfig(iters=2, sampling_fraction=1.0, force_pruning=True, epsilon=8.0)).fit(df)
    assert m.assign_training_points(df).count() == m.assign_training_points().count() == 350


def test_weighted_draws_do_not_grow_the_plan(spark):
    sizes = spark.range(100_000).select(F.col("id").cast("int").alias("cid"), (F.col("id") % 7).alias("size"))
    got = S.weighted_seed(sizes, spark.range(20_000).withColumnRenamed("id", "vec_id"), 3)
    assert len(plan(got)) < 5000
    drawn = got.groupBy((F.col("cid") % 7).alias("w")).count().collect()
    share = {r.w: r["count"] / 20_000 for r in drawn}
    for w, s in share.items():
        assert s == pytest.approx(max(w, 1) / 22, rel=0.2)


# --- centroids in a table ----------------------------------------------------------------------------------------


def test_blocked_training_equals_the_other(spark, monkeypatch):
    df = synthetic.blobs(spark, 1500, 16, 30).persist()
    cfg = FlatConfig(iters=4, sampling_fraction=0.8, early_termination=False)
    want = KMeans(30, 16, cfg).fit(df)
    for name, value in (("BLOCK_BYTES", 4000), ("BROADCAST_BYTES", 100)):
        monkeypatch.setattr(D, name, value)
    monkeypatch.setattr(C, "TASK_BYTES", 3000)
    monkeypatch.setattr(C, "SUM_BYTES", 600)
    monkeypatch.setattr(C, "BRANCH", 2)
    m = BlockedKMeans(30, 16, cfg).fit(df)
    c = np.array([r.centroid for r in m.centroids.orderBy("cid").collect()])
    assert np.allclose(c, want.centroids_)
    assert np.allclose([s[1:3] for s in m.stats], [s[1:3] for s in want.stats])
    assert m.assign(df).count() == 1500
    m.release()


def test_numbers_follow_the_seeded_order(spark):
    df = vectors_of(spark, np.random.default_rng(0).normal(size=(500, 3))).repartition(5)
    for k in (1, 37, 500):
        got = blocked.numbered(df, k, 42).orderBy("cid").collect()
        want = S.first_centroids(df, k, 42).orderBy("cid").collect()
        assert [(r.cid, r.centroid) for r in got] == [(r.cid, r.centroid) for r in want]


def test_draws_go_to_shares(spark, monkeypatch):
    monkeypatch.setattr(blocked, "RANGE", 4)
    rng = np.random.default_rng(5)
    w = {int(i): int(rng.integers(1, 50)) for i in rng.choice(40, 25, replace=False)}
    items = {100 + i: float(u) for i, u in enumerate([0.0, *rng.random(200), 1 - 1e-12])}
    got = blocked.drawn_rows(spark.createDataFrame(list(items.items()), "cid int, u double"), spark.createDataFrame(list(w.items()), "cid int, w long"))
    ids = sorted(w)
    ends = np.cumsum([w[i] for i in ids])
    assert {r.cid: r.chosen for r in got.collect()} == {i: ids[int(np.searchsorted(ends, u * ends[-1], side="right"))] for i, u in items.items()}


def test_blocked_repairs(spark, monkeypatch):
    monkeypatch.setattr(blocked, "RANGE", 8)
    rng = np.random.default_rng(2)
    c = rng.normal(size=(60, 6))
    sizes = np.where(np.arange(60) % 3 == 0, 0, np.where(np.arange(60) % 3 == 1, 2, 40))
    df = spark.createDataFrame([(i, c[i].tolist(), int(sizes[i])) for i in range(60)], "cid int, centroid array<double>, size long")
    store = Store(spark)
    out, done = blocked.split_empty(df, 7, store)
    rows = {r.cid: r for r in out.collect()}
    assert done == 20 and sum(r["size"] for r in rows.values()) == sizes.sum() and min(r["size"] for r in rows.values()) > 0
    for i in range(0, 60, 3):  # near one of the others
        assert min(np.abs(np.array(rows[i].centroid) - c[j]).max() for j in range(60) if j % 3) < 0.1
    # One donor and several empty clusters: as one after another.
    one = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 100), *((i, [0.0] * 3, 0) for i in range(1, 5))], "cid int, centroid array<double>, size long")
    got = {r.cid: r for r in blocked.split_empty(one, 1, store)[0].collect()}
    want, left = np.vstack([[1.0, 2.0, 3.0], np.zeros((4, 3))]), np.array([100, 0, 0, 0, 0])
    C.split_empty(want, left, 100, _Always())
    assert [got[i]["size"] for i in range(5)] == left.tolist() and np.allclose([got[i].centroid for i in range(5)], want)
    # Nothing to give: empty clusters stay.
    none = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 0)], "cid int, centroid array<double>, size long")
    assert blocked.split_empty(none, 1, store)[1] == 0
    crowded = spark.createDataFrame([(0, [1.0], 3), *((i, [0.0], 0) for i in range(1, 9))], "cid int, centroid array<double>, size long")
    out, done = blocked.split_empty(crowded, 1, store)
    assert done == 2 and sorted(r["size"] for r in out.collect()) == [0] * 6 + [1] * 3
    small = spark.createDataFrame([(0, [1.0], 90), (1, [3.0], 2), (2, [5.0], 8)], "cid int, centroid array<double>, size long")
    out, done = blocked.pull_small(small, 100, 3, 1, store)
    assert done == 2 and {r.cid: r.centroid[0] for r in out.collect()} == {0: 1.0, 1: pytest.approx(7 / 3), 2: pytest.approx(36 / 8)}
    store.release()
    assert store.tables == {}


class _Always:
    """Draws that always take the first donor that may give."""

    def random(self):
        return 0.0


# --- inverted lists ----------------------------------------------------------------------------------------------


def test_lists_find_all_neighbours_and_leave_most_blocks(spark):
    df = synthetic.blobs(spark, 4000, 16, 40).persist()
    p = df.select(F.col("vec_id").alias("cid"), F.col("embedding").cast("array<double>").alias("centroid"))
    q = df.where("vec_id % 20 = 0")
    pivots = KMeans(40, 16, FlatConfig(iters=3)).fit(df).centroids_
    lists = L.build(p, pivots, block_rows=50)
    assert lists.blocks.agg(F.sum("n"), F.max("n")).first() == (4000, 50)
    got = sorted(map(tuple, L.knn_lists(q, lists, 5).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(map(tuple, D.knn_blocks(q, p, 5, 16).collect()))]
    asked = q.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    tau = {r[0]: r[3] ** 0.5 for r in got if r[1] == 5}
    bounded = asked.join(spark.createDataFrame(list(tau.items()), "id long, tau double"), "id")
    met = sum(L.candidates(x, lists, 5, f).agg(F.sum("n")).first()[0] or 0 for x, f in ((asked.withColumn("tau", F.lit(0.0)), True), (bounded, False)))
    assert met < 0.5 * 200 * 4000
    lists.release()


def test_lists_with_ties_few_points_and_nulls(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.integers(-2, 3, (30, 4)), 3, axis=0).astype(float)
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (None, [0.0] * 4)], "vec_id long, embedding array<double>")
    p = df.toDF("cid", "centroid")
    want = {(q, r + 1): int(i) for q in range(90) for r, i in enumerate(np.lexsort((np.arange(90), ((x - x[q]) ** 2).sum(1)))[:5])}
    for pivots in (x[:1], x[:20:3], np.full((2, 4), 1e6)):
        lists = L.build(p, pivots, block_rows=7)
        assert {(r.query_id, r["rank"]): r.neighbor_id for r in L.knn_lists(df, lists, 5).collect()} == want
    few = L.build(p.where("cid < 3"), x[:2])
    assert L.knn_lists(df.where("vec_id < 4"), few, 5).count() == 12
    assert L.knn_lists(df, L.build(p.limit(0), x[:2]), 5).count() == 0 and L.knn_lists(df.limit(0), few, 5).count() == 0


# --- slabs -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("d, width", [(256, 64), (20, 8), (5, 64)])
def test_slabs_read_later_dimensions_of_few_vectors(spark, d, width):
    df = synthetic.blobs(spark, 1200, d, 30, seed=3)
    df = df.unionByName(df.where("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 5000)).unionByName(spark.createDataFrame([(None, [0.0] * d)], df.schema))
    c = np.random.default_rng(3).normal(0.0, 10.0, (30, d))
    c = np.concatenate([c, c[:2]])  # ties
    stored = slabs.write(df, d, width)
    found, read = slabs.assign(stored, c)
    want = {r.vec_id: r.cid for r in D.assign(df.where("vec_id is not null"), np.arange(32, dtype=np.int32), c).collect()}
    assert {r.vec_id: r.cid for r in found.collect()} == want and read[0] == 1220 == found.count()
    assert slabs.assign(stored, c[2:])[0].count() == 1220
    # Another time, with centroids that have moved a little: most vectors are decided by the first slab.
    moved = c + np.random.default_rng(1).normal(0.0, 0.05, c.shape)
    before = D.assign(df.where("vec_id is not null and vec_id <> 7"), np.arange(32, dtype=np.int32), c)
    found, again = slabs.assign(stored, moved, before, c)
    want = {r.vec_id: r.cid for r in D.assign(df.where("vec_id is not null"), np.arange(32, dtype=np.int32), moved).collect()}
    assert {r.vec_id: r.cid for r in found.collect()} == want
    if d == 256:
        assert sum(again[1:]) < 0.5 * sum(read[1:])
        scan = plan(stored.rows.select("vec_id", "rests", "s0"))
        assert "s0" in scan and "s1" not in scan
    stored.release()
    with pytest.raises(ClusteringError, match="width"):
        slabs.assign(stored, c[:, 1:])


# --- tiles -------------------------------------------------------------------------------------------------------


def test_products_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE_ROWS", 4)
    monkeypatch.setattr(G, "TILE_COLUMNS", 3)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(17, 11)), rng.normal(size=(11, 8))

    def of(rows, shape):
        out = np.zeros(shape)
        found = rows.collect()
        assert len(found) == len({(r.i, r.j) for r in found}) == out.size
        for r in found:
            out[r.i, r.j] = r.value
        return out

    table = lambda m: vectors_of(spark, m).repartition(3)
    assert np.allclose(of(G.product(table(a), table(b)), (17, 8)), a @ b)
    assert np.allclose(of(G.product(table(a.T), table(b), trans_a=True), (17, 8)), a @ b)
    assert np.allclose(of(G.product(table(a), table(b.T), trans_b=True), (17, 8)), a @ b)
    assert np.allclose(of(G.product(table(a.T), table(b.T), True, True), (17, 8)), a @ b)
    assert np.allclose(of(G.product(table(a), table(b), columns_a=5, columns_b=7), (17, 7)), a[:, :5] @ b[:5, :7])
    apart = vectors_of(spark, b, first=100)
    assert G.product(table(a.T), apart, trans_a=True).count() == 0  # no id in common
    assert "Broadcast" not in plan(G.product(table(a), table(b)))


# --- recall ------------------------------------------------------------------------------------------------------


def test_recall_in_training(spark):
    df = synthetic.blobs(spark, 1500, 16, 30).persist()
    cfg = FlatConfig(iters=3, sampling_fraction=1.0, early_termination=False, recall_neighbours=5)
    m = KMeans(30, 16, cfg).fit(df, df.where("vec_id % 50 = 0"))
    x, c = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=float), m.centroids_
    home, hit = D.nearest(x, c), []
    for q in range(0, 1500, 50):
        near = np.lexsort((np.arange(1500), ((x - x[q]) ** 2).sum(1)))[:5]
        explored = np.argsort(((c - x[q]) ** 2).sum(1), kind="stable")[:3]
        hit += [home[i] in explored for i in near]
    assert m.stats[-1][4] == pytest.approx(np.mean(hit)) and m.stats[0][4] > 0
    early = KMeans(30, 16, FlatConfig(iters=30, sampling_fraction=1.0, tol=0.0, recall_tol=0.5)).fit(df, n_queries=20, queries=df)
    assert len(early.stats) == 3  # recall improves from nothing once, then fails to by so much twice
    sampled = KMeans(30, 16, FlatConfig(iters=2, sampling_fraction=1.0, sample_queries=True)).fit(df, n_queries=20)
    assert sampled.stats[-1][4] > 0


def test_too_many_centroids_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("vecforge.plans.flat.BROADCAST_BYTES", 100)
    with pytest.raises(ClusteringError, match="BlockedKMeans"):
        KMeans(5, 4).fit(synthetic.uniform(spark, 50, 4))
    assert centroid_table(spark, np.zeros((1, 2))).count() == 1
