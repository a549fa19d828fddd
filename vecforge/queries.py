"""The engine's registered queries over the test tables, and their SQL twins for DuckDB."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FlatConfig, HierConfig
from .functions import sampling as S
from .functions import vectors as V
from .operators import centroids as C
from .operators import distance as D
from .operators import gemm as G
from .operators import lists as lists_
from .operators import metrics as M
from .operators import slabs
from .operators.pruned import assign_pruned
from .operators.rotation import Rotation, Split
from .plans.blocked import BlockedKMeans
from .plans.blocked import pull_small as pull_small_rows
from .plans.blocked import split_empty as split_empty_rows
from .plans.flat import KMeans, Patience, stops
from .plans.hierarchical import HierarchicalKMeans, fine_budget, together
from .plans.index import TwoLevelIndex
from .schema import vectors
from .sources import synthetic
from .sources.models import ModelStore
from .sources.storage import Store, folder
from .sources.tables import centroid_table, from_columns, read_vectors
from .streaming import assign as streams

DIM = 64
SEED = 42
FRACTIONS = [0.1, 0.3, 0.5, 0.7, 0.9, 1.0]


def points(spark: SparkSession, sf: str) -> DataFrame:
    return read_vectors(spark, f"{sf}/embeddings.parquet")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")


def first(df: DataFrame, k: int) -> DataFrame:
    return S.first_centroids(df, k, SEED)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next one."""
    e = points(spark, sf)
    return e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b")), "a_id")


def r6(x) -> F.Column:
    return F.round(x, 6)


def l2_squared_pairs(s, sf):
    return pairs(s, sf).select("a_id", r6(V.l2_squared("a", "b")).alias("d2"))


def l2_prefix_pairs(s, sf):
    return pairs(s, sf).select("a_id", *[r6(V.l2_squared_prefix("a", "b", n)).alias(f"d2_{n}") for n in (16, 32, 100)])


def dot_pairs(s, sf):
    return pairs(s, sf).select("a_id", r6(V.dot("a", "b")).alias("dot"), r6(V.dot(V.prefix("a", 24), V.prefix("b", 24))).alias("dot_24"))


def norms_full(s, sf):
    return points(s, sf).select("vec_id", r6(V.norm_squared("embedding")).alias("norm2"))


def norms_partial(s, sf):
    return points(s, sf).select("vec_id", *[r6(V.norm_squared_prefix("embedding", p)).alias(f"norm2_{p}") for p in (8, 48, 80)])


def normalize_rows(s, sf):
    doubled = F.transform(V.doubles("embedding"), lambda x: x * 3)
    rows = points(s, sf).select("vec_id", V.normalized(doubled).alias("u"))
    return rows.select("vec_id", F.posexplode("u").alias("dim", "value")).select("vec_id", "dim", r6("value").alias("value"))


def sql_functions(s, sf):
    V.register(s)
    pairs(s, sf).createOrReplaceTempView("vecforge_pairs")
    return s.sql("select a_id, round(l2_squared(a, b), 6) as d2, round(vector_dot(a, b), 6) as dot, round(norm_squared(a), 6) as norm2 from vecforge_pairs")


def _label_means(s, sf) -> tuple[np.ndarray, np.ndarray]:
    """Mean vectors of the labels, a row each."""
    return D.collected(C.means(labelled(s, sf).select(F.col("label").alias("cid"), "embedding"), DIM))


def gemm_gram(s, sf):
    """A B^T: all vectors with the label means."""
    ids, means = _label_means(s, sf)
    rows = G.rows_times(points(s, sf), means, trans_b=True).select(F.col("vec_id").alias("i"), F.posexplode("product").alias("at", "value"))
    return rows.select("i", F.array(*[F.lit(int(x)) for x in ids])[F.col("at")].cast("int").alias("j"), r6("value").alias("value"))


def gemm_ab(s, sf):
    """A B: all vectors with the matrix of all vectors' products by dimension, over the first 48 dimensions of each."""
    e = points(s, sf)
    b = np.zeros((DIM, DIM))
    for r in G.gram_of_dims(e, DIM).collect():  # DIM * DIM rows
        b[r.i, r.j] = r.value
    return G.rows_times(e, b[:48], columns=48).select("vec_id", F.posexplode("product").alias("j", "value")).select("vec_id", "j", F.round("value", 4).alias("value"))


def gemm_transposed(s, sf):
    """A^T B over all rows, with rows wider than what counts: the first 16 columns of A, the first 24 of B."""
    e = points(s, sf)
    out = G.product(e, e, trans_a=True, columns_a=16, columns_b=24)
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("value").alias("value"))


def gemm_dims(s, sf):
    """X^T X of all vectors: the whole table's product, with DIM * DIM rows at any size."""
    return G.gram_of_dims(points(s, sf), DIM).select("i", "j", r6("value").alias("value"))


def dot_matrix(s, sf):
    e = points(s, sf)
    _, c = S.first_matrix(e, 16, SEED)
    rows = D.dot_products(e, c, 32).select("vec_id", F.posexplode("dots").alias("cid", "dot"))
    return rows.select("vec_id", "cid", r6("dot").alias("dot"))


def assign_sql(s, sf):
    """As one SQL statement over views."""
    e = points(s, sf)
    e.createOrReplaceTempView("vecforge_vectors")
    D.checked_small(first(e, 16), DIM).createOrReplaceTempView("vecforge_centroids")
    return s.sql("""
        select vec_id, at.cid, round(at.d2, 6) as d2
        from (select vec_id, array_min(transform(held, c -> struct(aggregate(zip_with(v, c.centroid, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x) as d2, c.cid as cid))) as at
              from (select vec_id, cast(embedding as array<double>) as v from vecforge_vectors) cross join (select collect_list(struct(cid, centroid)) as held from vecforge_centroids))
        where at is not null""")


def assign_sql_hof(s, sf):
    e = points(s, sf)
    return D.assign_relational(e, first(e, 16), DIM).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_arrow(s, sf):
    e = points(s, sf)
    return D.assign(e, *S.first_matrix(e, 100, SEED)).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_label_centroids(s, sf):
    e = labelled(s, sf)
    return D.assign(e, *_label_means(s, sf)).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_in_blocks(s, sf):
    """The form for more centroids than can be broadcast: all vectors to 100 centroids, block by block."""
    e = points(s, sf)
    return D.assign_blocks(e, first(e, 100), DIM).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_lineitem(s, sf):
    """Four numeric columns of every line as vectors, to the first 32 distinct ones in seeded order of their values."""
    li = s.read.parquet(f"{sf}/lineitem.parquet").withColumn("vec_id", (F.col("l_extendedprice") * 100).cast("long"))
    scaled = li.select("vec_id", (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("t"))
    v = from_columns(scaled, "vec_id", ["q", "p", "d", "t"])
    once = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    out = D.assign(v, *S.first_matrix(once, 32, SEED))
    return out.groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("d2"), 3).alias("cost"))


def _queries_and_all(s, sf):
    """Every vector whose id is divisible by 20, and all vectors."""
    e = points(s, sf)
    return e.where("vec_id % 20 = 0"), e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))


def _told(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("neighbor_id").cast("int").alias("neighbor_id"), r6("d2").alias("d2"))


def knn_topk(s, sf):
    """Ten nearest among all rows; only the query's own row is left out."""
    q, p = _queries_and_all(s, sf)
    return _told(D.other_neighbors(D.knn_blocks(q, p, 11, DIM), 10))


def knn_sql(s, sf):
    """Five nearest among all rows, by a join of blocks and a ranking."""
    q, p = _queries_and_all(s, sf)
    return _told(D.other_neighbors(D.knn_relational(q, p, 6, DIM), 5))


def knn_padded(s, sf):
    e = points(s, sf)
    out = D.knn(e, *S.first_matrix(e, 4, SEED), 6, pad=True)
    return out.select("query_id", "rank", F.coalesce("neighbor_id", F.lit(-1)).alias("neighbor_id"), F.coalesce(r6("d2"), F.lit(-1.0)).alias("d2"))


def knn_recall(s, sf):
    """How many of the ten nearest a search over the first 32 dimensions finds."""
    q, p = _queries_and_all(s, sf)
    head = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    found = D.other_neighbors(D.knn_blocks(head(q, "embedding"), head(p, "centroid"), 11, 32), 10)
    return M.recall(found, D.other_neighbors(D.knn_blocks(q, p, 11, DIM), 10)).select(r6("recall").alias("recall"))


def survivor_filter(s, sf):
    e = points(s, sf)
    head = lambda df, name: df.withColumn(name, F.slice(name, 1, 32))
    rows = head(e, "embedding").crossJoin(F.broadcast(head(first(e, 16), "centroid"))).select("vec_id", "cid", V.l2_squared("embedding", "centroid").alias("d2"))
    return D.survivors(rows, 0.8).select("vec_id", "cid", r6("d2").alias("d2"))


def forgy_init(s, sf):
    return first(points(s, sf), 16).select("cid", F.posexplode("centroid").alias("dim", "value")).select("cid", "dim", r6("value").alias("value"))


def train_sample(s, sf):
    e = points(s, sf)
    return S.first_rows(e, S.sample_size(e.count(), 16, 0.3, 256), SEED).select("vec_id")


def sample_sizes(s, sf):
    """Rows to train on for each label's vectors, by sampling fraction, two clusters of at most 16 points."""
    rows = labelled(s, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("fraction", F.explode(F.array(*map(F.lit, FRACTIONS))))
    return rows.select("label", "fraction", S.sampled(F.col("n"), 2, F.col("fraction"), 16).alias("size"))

def _assigned(s, sf, k=16):
    e = points(s, sf)
    return e, D.assign(e, *S.first_matrix(e, k, SEED))


def _iteration(s, sf, number: int, k: int = 16) -> KMeans:
    """A trainer after so many iterations on all vectors."""
    cfg = FlatConfig(iters=number, sampling_fraction=1.0, early_termination=False)
    return KMeans(k, DIM, cfg).fit(points(s, sf))


def _matrix_rows(s, c):
    return centroid_table(s, c).select("cid", F.posexplode("centroid").alias("dim", "value")).select("cid", "dim", r6("value").alias("value"))


def centroid_update(s, sf):
    """Assignment and cluster means in one pass."""
    e = points(s, sf)
    sums = C.updated(e, *S.first_matrix(e, 16, SEED))
    return sums.select("cid", "size", F.posexplode("total").alias("dim", "total")).select("cid", "dim", r6(F.col("total") / F.col("size")).alias("value"))


def lloyd_1(s, sf):
    return _matrix_rows(s, _iteration(s, sf, 1).centroids_)


def lloyd_2(s, sf):
    return _matrix_rows(s, _iteration(s, sf, 2).centroids_)


def lloyd_3(s, sf):
    return _matrix_rows(s, _iteration(s, sf, 3).centroids_)


def angular_centroids(s, sf):
    cfg = FlatConfig(iters=1, sampling_fraction=1.0, early_termination=False, angular=True)
    return _matrix_rows(s, KMeans(16, DIM, cfg).fit(points(s, sf)).centroids_)


def train_stats(s, sf):
    m = _iteration(s, sf, 3)
    return m.iter_stats(points(s, sf)).select("iteration", r6("objective").alias("objective"), r6("shift").alias("shift"), "split", "is_gemm_only")


def objective(s, sf):
    return M.objective(_assigned(s, sf)[1]).select(r6("objective").alias("objective"))


def shift_one_iter(s, sf):
    e = points(s, sf)
    return C.shift_relational(centroid_table(s, _iteration(s, sf, 1).centroids_), first(e, 16)).select(r6("shift").alias("shift"))


def cluster_sizes(s, sf):
    return M.sizes(_assigned(s, sf)[1], 16)


def balance_stats(s, sf):
    out = M.balance(_assigned(s, sf)[1], 16)
    return out.select(*[r6(c).alias(c) for c in ("mean", "geometric_mean", "stdev", "cv")], "min", "max")


def pruning_ratios(s, sf):
    """For each vector the ratio after as many dimensions as its number says, in turn from 0 to its width, by both levels' epsilon."""
    e = points(s, sf).select("vec_id", F.size("embedding").alias("d")).withColumn("visited", F.col("vec_id") % (F.col("d") + 1))
    return e.select("vec_id", "visited", *[r6(V.pruning_ratio(F.col("visited"), F.col("d"), x)).alias(name) for name, x in (("flat", 1.5), ("hierarchical", 1.1))])

def dimension_split(s, sf):
    """How vectors as wide as each part's size tells would be split."""
    d = (F.col("p_size") * 32 + F.col("p_partkey") % 33).cast("int")
    rows = s.read.parquet(f"{sf}/part.parquet").select("p_partkey", d.alias("d"))
    return rows.select("p_partkey", "d", *(c.alias(n) for n, c in zip("hvp", V.dimension_split(F.col("d")), strict=True)))

def tune_partial_d(s, sf):
    """The next prefix after a search of each label's vectors, by the share that a prefix of 32 left to them."""
    e = points(s, sf).withColumn("prev_cid", (F.col("vec_id") % 100).cast("int"))
    split = Split.of(DIM)
    out = assign_pruned(e, S.first_matrix(e, 100, SEED)[1], Rotation(DIM, SEED).ratios, split, split.partial())
    rates = out.join(labelled(s, sf).select("vec_id", "label"), "vec_id").groupBy("label").agg((F.sum("not_pruned") / (F.count(F.lit(1)) * 100)).alias("rate"))
    nexts = [V.tuned_partial(F.lit(p), F.col("rate") * f, 192).alias(name) for name, p, f in (("grown", 32, 1.0), ("shrunk", 32, 0.01), ("least", 18, 0.01), ("most", 180, 1.0))]
    return rates.select("label", r6("rate").alias("rate"), *nexts)

def rotate_norms(s, sf):
    out = Rotation(DIM, SEED).apply(points(s, sf))
    return out.select("vec_id", F.round(V.norm_squared("embedding"), 5).alias("norm2"))


def rotate_distances(s, sf):
    out = Rotation(DIM, SEED).apply(points(s, sf))
    near = out.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a")).join(out.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b")), "a_id")
    return near.select("a_id", r6(V.l2_squared("a", "b")).alias("d2"))


def rotate_roundtrip(s, sf):
    r = Rotation(DIM, SEED)
    back = r.apply(r.apply(points(s, sf)), inverse=True)
    return back.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select("vec_id", "dim", r6("value").alias("value"))


def pruned_assign(s, sf):
    """Forced pruning with an epsilon so wide that nothing near is lost: equals the exact assignment."""
    e = points(s, sf)
    r, split = Rotation(DIM, SEED, 8.0), Split.of(DIM)
    _, c = S.first_matrix(e, 100, SEED)
    rows = r.apply(e).withColumn("prev_cid", (F.col("vec_id") % 100).cast("int"))
    return assign_pruned(rows, r.rotate(c), r.ratios, split, split.partial()).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_slabs(s, sf):
    """All vectors, stored rotated in slabs of 16 dimensions, after an iteration: bounded by their assignments before, later slabs are read for undecided vectors alone."""
    e, r = points(s, sf), Rotation(DIM, SEED)
    _, c = S.first_matrix(e, 16, SEED)
    before = D.assign(e, np.arange(16, dtype=np.int32), c)
    return slabs.assign(slabs.write(r.apply(e), DIM, 16), r.rotate(_iteration(s, sf, 1).centroids_), before, r.rotate(c))[0]


def pruning_rate(s, sf):
    """Average share of centroids that the prefix leaves, bounded by the distance to a given one."""
    e = points(s, sf).withColumn("prev_cid", (F.col("vec_id") % 100).cast("int"))
    _, c = S.first_matrix(e, 100, SEED)
    split = Split.of(DIM)
    out = assign_pruned(e, c, Rotation(DIM, SEED).ratios, split, split.partial())
    return M.pruning_rate(out, 100).select(r6("not_pruned_pct").alias("not_pruned_pct"))


def pruning_thresholds(s, sf):
    """The bound that a partial distance to the next centroid in turn has to stay under, by dimensions seen."""
    e = points(s, sf)
    _, c = S.first_matrix(e, 16, SEED)
    r = Rotation(DIM, SEED)
    rows = D.assign(e, np.arange(16, dtype=np.int32), c).withColumn("visited", F.explode(F.array(*[F.lit(v) for v in (16, 32, 64)])))
    ratio = F.create_map(*[F.lit(x) for v in (16, 32, 64) for x in (v, r.threshold(1.0, v))])
    return rows.select("vec_id", "visited", r6(F.col("d2") * F.element_at(ratio, F.col("visited"))).alias("threshold"))


def pruned_agreement(s, sf):
    """Pruned assignment agrees with brute force on at least 98 % of the vectors, doubled to 128 dimensions, for 300 clusters."""
    v = points(s, sf).select("vec_id", F.concat("embedding", F.reverse("embedding")).alias("embedding")).persist()
    m = KMeans(300, 128, FlatConfig(iters=5, sampling_fraction=1.0)).fit(v)
    return M.agreement(m.assign_training_points(v), m.assign(v)).select((F.col("agreement") >= 0.98).alias("agrees"))

def assign_training(s, sf):
    """After one iteration with pruning forced, and an epsilon so wide that nothing near is lost, all vectors to the trained centroids."""
    e = points(s, sf)
    m = KMeans(16, DIM, FlatConfig(iters=1, sampling_fraction=1.0, force_pruning=True, epsilon=8.0)).fit(e)
    return m.assign_training_points(e).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_training_given(s, sf):
    """The same to centroids that are given: the first ones of the seeded order."""
    e = points(s, sf)
    m = KMeans(16, DIM, FlatConfig(iters=1, sampling_fraction=1.0, force_pruning=True, epsilon=8.0)).fit(e)
    return m.assign_training_points(e, S.first_matrix(e, 16, SEED)[1]).select("vec_id", "cid", r6("d2").alias("d2"))


def _pruned(s, sf, share: float = 1.0) -> tuple[DataFrame, KMeans]:
    """A trainer after one iteration with pruning forced and nothing near lost, on a share of the vectors, however many that is."""
    e = points(s, sf)
    return e, KMeans(16, DIM, FlatConfig(iters=1, sampling_fraction=share, max_points_per_cluster=None, force_pruning=True, epsilon=8.0)).fit(e)


def assign_training_stored(s, sf):
    """The stored training vectors joined with their stored assignments, bucket by bucket, and searched from there."""
    return _pruned(s, sf)[1].assign_training_points().select("vec_id", "cid", r6("d2").alias("d2"))


def assign_training_weighted(s, sf):
    """Nine tenths of the vectors are sampled; the others start from a draw by cluster sizes."""
    e, m = _pruned(s, sf, 0.9)
    return m.assign_training_points(e).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_training_meso(s, sf):
    """Half of the vectors are sampled; the others start from the representative of their nearest cluster of centroids."""
    e, m = _pruned(s, sf, 0.5)
    return m.assign_training_points(e).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_training_fewer(s, sf):
    """Fewer centroids than were trained, without pruning: the first five of the seeded order."""
    e = points(s, sf)
    m = KMeans(16, DIM, FlatConfig(iters=1, sampling_fraction=1.0, suppress_warnings=True)).fit(e)
    return m.assign_training_points(e, S.first_matrix(e, 5, SEED)[1]).select("vec_id", "cid", r6("d2").alias("d2"))


def assign_training_more(s, sf):
    """More centroids than were trained, with pruning: stored seeds are among the first of them."""
    e, m = _pruned(s, sf)
    return m.assign_training_points(e, S.first_matrix(e, 40, SEED)[1]).select("vec_id", "cid", r6("d2").alias("d2"))


def training_seeds(s, sf):
    """Where the search of each training vector starts, if all were sampled."""
    e, m = _pruned(s, sf)
    return m.training_seeds(e)


def training_seeds_weighted(s, sf):
    """The same if nine tenths were: seeds of the others are drawn by cluster sizes."""
    e, m = _pruned(s, sf, 0.9)
    return m.training_seeds(e)


def training_seeds_meso(s, sf):
    """The same if half of them were: seeds of the others come from a model of four clusters over the centroids."""
    e, m = _pruned(s, sf, 0.5)
    return m.training_seeds(e)


def train_recall(s, sf):
    """Recall of the true ten neighbours of every twentieth vector after each iteration, for searches that look into 3 of 16 clusters."""
    e = points(s, sf)
    cfg = FlatConfig(iters=3, sampling_fraction=1.0, early_termination=False, explored=0.2)
    m = KMeans(16, DIM, cfg).fit(e, e.where("vec_id % 20 = 0"))
    return m.iter_stats(e).select("iteration", r6("recall").alias("recall"))


def lloyd_blocked(s, sf):
    """Two iterations with the centroids in a table throughout."""
    m = BlockedKMeans(16, DIM, FlatConfig(iters=2, sampling_fraction=1.0, early_termination=False)).fit(points(s, sf))
    return m.centroids.select("cid", F.posexplode("centroid").alias("dim", "value")).select("cid", "dim", r6("value").alias("value"))


def blocked_stats(s, sf):
    e = points(s, sf)
    m = BlockedKMeans(16, DIM, FlatConfig(iters=3, sampling_fraction=1.0, early_termination=False)).fit(e)
    return m.iter_stats(e).select("iteration", r6("objective").alias("objective"), r6("shift").alias("shift"), "split", "is_gemm_only")


def _sized(s, sf, k: int, copies: int = 0) -> DataFrame:
    """(cid, centroid, size): the first k vectors of the seeded order, then the first of them once more, with their numbers of nearest vectors; copies have none."""
    e = points(s, sf)
    c = first(e, k)
    both = c.unionByName(c.where(F.col("cid") < copies).withColumn("cid", F.col("cid") + k))
    sizes = M.sizes(D.assign(e, *D.collected(both)), k + copies)
    return both.join(sizes, "cid")


def _repaired(df: DataFrame) -> DataFrame:
    return df.select("cid", F.posexplode("centroid").alias("dim", "value"), "size").select("cid", "dim", r6("value").alias("value"), "size")


def split_drawn(s, sf):
    """Eight empty clusters beside sixteen that have all vectors: each draws one to split."""
    return _repaired(split_empty_rows(_sized(s, sf, 16, 8), SEED, Store(s))[0])


def pull_drawn(s, sf):
    """Small ones among a hundred clusters are pulled towards large ones that they draw."""
    n = points(s, sf).count()
    return _repaired(pull_small_rows(_sized(s, sf, 100), n, 100, SEED, Store(s))[0])


def knn_lists(s, sf):
    """Ten nearest among all rows, from inverted lists around sixteen pivots; lists that cannot hold one are left out."""
    q, p = _queries_and_all(s, sf)
    return _told(D.other_neighbors(lists_.knn_lists(q, lists_.build(p, S.first_matrix(points(s, sf), 16, SEED)[1]), 11), 10))


def gemm_tiled(s, sf):
    """A B of two tables: all vectors with the matrix of all vectors' products by dimension, tile by tile."""
    e = points(s, sf)
    rows = G.gram_of_dims(e, DIM).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("r"))  # DIM entries a row
    b = rows.select(F.col("i").cast("long").alias("vec_id"), F.transform("r", lambda x: x["value"]).alias("embedding"))
    return G.product(e, b).select(F.col("i").alias("vec_id"), F.col("j").cast("int").alias("j"), (F.round("value", 4) + F.lit(0.0)).alias("value"))


def gemm_pairs(s, sf):
    """A B^T of two tables: all vectors with the label means, block against block."""
    ids, means = _label_means(s, sf)
    b = s.createDataFrame([(int(i), m.tolist()) for i, m in zip(ids, means, strict=True)], "vec_id long, embedding array<double>")
    return G.product(points(s, sf), b, trans_b=True).select("i", F.col("j").cast("int").alias("j"), r6("value").alias("value"))


def output_centroids(s, sf):
    """Centroids of training in the rotated domain, turned back."""
    m = KMeans(16, DIM, FlatConfig(iters=1, sampling_fraction=1.0, force_pruning=True)).fit(points(s, sf))
    return _matrix_rows(s, m.centroids_)


def early_stop(s, sf):
    """Which of four iterations on all vectors would end training, by a tolerance of 0.02 for shift and cost."""
    cfg, stats = FlatConfig(tol=0.02), _iteration(s, sf, 4).stats
    before = [0.0, *(x[1] for x in stats)]
    told = [(x[0], x[1], x[2], stops(cfg, x[0], x[2], x[1], before[i])) for i, x in enumerate(stats)]
    rows = s.createDataFrame(told, "iteration int, objective double, shift double, stops boolean")
    return rows.select("iteration", r6("objective").alias("objective"), r6("shift").alias("shift"), "stops")


def recall_patience(s, sf):
    """Which of four iterations would end training by its recall, that has to improve by 0.02."""
    p, cfg = Patience(), FlatConfig(iters=4, sampling_fraction=1.0, early_termination=False, explored=0.2)
    e = points(s, sf)
    stats = KMeans(16, DIM, cfg).fit(e, e.where("vec_id % 20 = 0")).stats
    return s.createDataFrame([(x[0], p.ends(x[4], 0.02)) for x in stats], "iteration int, stops boolean")


def weighted_seed(s, sf):
    e, a = _assigned(s, sf)
    return S.weighted_seed(M.sizes(a, 16), e, SEED).groupBy("cid").count()


def fine_budgets(s, sf):
    rows = labelled(s, sf).groupBy("label").count().orderBy("label").collect()
    budget = fine_budget([r["count"] for r in rows], 50)
    return s.createDataFrame([(r.label, r["count"], b) for r, b in zip(rows, budget, strict=True)], "label int, size long, budget int")


def hier_meso(s, sf):
    """The first level alone: 4 clusters, one iteration."""
    cfg = FlatConfig(iters=1, sampling_fraction=1.0, early_termination=False)
    return _matrix_rows(s, KMeans(4, DIM, cfg).fit(points(s, sf)).centroids_)


def hier_train(s, sf):
    m = HierarchicalKMeans(36, DIM, HierConfig(suppress_warnings=True, iters_refinement=1)).fit(points(s, sf))
    return m.iter_stats(points(s, sf)).select("phase", "meso_id", "iteration", "objective", "shift")


def hier_fine(s, sf):
    """The second level alone: in each label's group three clusters, one iteration, all groups in one job and none in one task."""
    rows = labelled(s, sf).select(F.col("label").alias("meso"), "vec_id", "embedding")
    counts = {r.meso: r["count"] for r in rows.groupBy("meso").count().collect()}
    cfg = HierConfig(iters_fineclustering=1, early_termination=False)
    found, _ = together(rows, dict.fromkeys(counts, 3), counts, cfg)
    told = [(i, j, v) for i, c in found.items() for j, v in enumerate(c.tolist())]
    rows = s.createDataFrame(told, "label int, local int, centroid array<double>")
    return rows.select("label", "local", F.posexplode("centroid").alias("dim", "value")).select("label", "local", "dim", r6("value").alias("value"))


def _two_levels(s, sf) -> HierarchicalKMeans:
    """Sixteen clusters on two levels, one iteration each."""
    return HierarchicalKMeans(16, DIM, HierConfig(suppress_warnings=True, iters_mesoclustering=1, iters_fineclustering=1)).fit(points(s, sf))


def hier_centroids(s, sf):
    """Both levels: four clusters, their shares of sixteen, and those inside each."""
    return _matrix_rows(s, _two_levels(s, sf).centroids_)


def hier_assign_index(s, sf):
    """All vectors to the sixteen, down an index that looks into other clusters only where their radius does not rule them out."""
    return TwoLevelIndex.of(_two_levels(s, sf)).assign(points(s, sf)).select("vec_id", "cid", r6("d2").alias("d2"))


def index_clusters(s, sf):
    """The stored index: each cluster's vectors, where they begin in the order of all, and how far they reach."""
    path = f"{folder(s)}/vecforge/index-{uuid.uuid4().hex}"
    TwoLevelIndex.of(_two_levels(s, sf)).write(points(s, sf), path)
    return TwoLevelIndex.clusters(s, path).select("meso", "cid", "n", "start", r6("radius").alias("radius"))


def lloyd_resumed(s, sf):
    """Two iterations, stored, and a third one by a trainer that goes on from there."""
    versions = ModelStore(f"{folder(s)}/vecforge/versions-{uuid.uuid4().hex}")
    for iters in (2, 3):
        cfg = FlatConfig(iters=iters, sampling_fraction=1.0, early_termination=False)
        m = KMeans(16, DIM, cfg).fit(points(s, sf), versions=versions)
    return _matrix_rows(s, m.centroids_)


def stream_sizes(s, sf):
    """Sizes of sixteen clusters from a stream of all vectors, whose state holds each one's latest cluster."""
    e = points(s, sf)
    path = f"{folder(s)}/vecforge/moves-{uuid.uuid4().hex}"
    stream = streams.read_stream(s, f"{sf}/embeddings.parquet*")
    streams.write_assignments(streams.moves(stream, S.first_matrix(e, 16, SEED)[1]), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return streams.sizes_of(s.read.schema("cid int, delta long").parquet(f"{path}/out"))


def hier_assign(s, sf):
    """Assignment of all vectors to two-level centroids."""
    e = points(s, sf)
    m = HierarchicalKMeans(36, DIM, HierConfig(suppress_warnings=True)).fit(e)
    return m.assign(e).select("vec_id", "cid", r6("d2").alias("d2"))


def sample_sizes_uncapped(s, sf):
    """The same without a limit, for the orders of each priority."""
    rows = s.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("fraction", F.explode(F.array(*map(F.lit, FRACTIONS))))
    return rows.select("o_orderpriority", "fraction", S.sampled(F.col("n"), 2, F.col("fraction"), None).alias("size"))

def _values(s, c: np.ndarray, sizes: np.ndarray):
    return s.createDataFrame([(i, j, float(v), int(sizes[i])) for i, row in enumerate(c) for j, v in enumerate(row)], "cid int, dim int, value double, size int").select("cid", "dim", r6("value").alias("value"), "size")


def split_empty(s, sf):
    """Repair of an empty cluster beside one that has nearly all rows: two halves, nudged apart by 1 / 1024. The vectors are the table's first two."""
    e = points(s, sf)
    c = S.first_matrix(e, 3, SEED)[1]
    sizes = np.array([98, 0, 1])
    C.split_empty(c, sizes, 99, np.random.default_rng(SEED))
    return _values(s, c, sizes)


def rebalance(s, sf):
    """Small clusters are pulled towards the only large one, by weights of their sizes up to 7."""
    c = S.first_matrix(points(s, sf), 4, SEED)[1]
    sizes = np.array([94, 1, 2, 3])
    C.pull_small(c, sizes, 100, np.random.default_rng(SEED))
    return _values(s, c, sizes)


def blobs(s, sf):
    """A normalised blob vector for each vector of the table, around as many centers as there are labels."""
    e = labelled(s, sf)
    out = synthetic.blobs(s, e, 32, e.select("label").distinct().count(), normalize=True)
    return out.select("vec_id", F.size("embedding").alias("d"), F.round(V.norm_squared("embedding"), 3).alias("norm2"))

def uniform_vectors(s, sf):
    """A uniform vector for each vector of the table: all coordinates lie in the range asked for."""
    x = F.explode("embedding")
    out = synthetic.uniform(s, points(s, sf), 16, -1.0, 1.0).select(x.alias("x"))
    return out.agg(F.count(F.lit(1)).alias("n"), (F.min("x") >= -1).alias("low"), (F.max("x") <= 1).alias("high"))

def utility_functions(s, sf):
    """Rounding up and powers of two, of every order's key."""
    key = F.col("o_orderkey")
    return s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", V.next_multiple(key, 8).alias("up8"), V.next_multiple(key, 0).alias("up0"), V.is_power_of_two(key).alias("power"))

_ALL = [
    l2_squared_pairs, l2_prefix_pairs, dot_pairs, norms_full, norms_partial, normalize_rows, sql_functions, gemm_gram, gemm_ab, gemm_transposed, gemm_dims, dot_matrix,
    assign_sql, assign_sql_hof, assign_arrow, assign_label_centroids, assign_in_blocks, assign_lineitem, knn_topk, knn_sql, knn_padded, knn_recall, survivor_filter,
    forgy_init, train_sample, sample_sizes, sample_sizes_uncapped, centroid_update, lloyd_1, lloyd_2, lloyd_3, angular_centroids, train_stats, objective, shift_one_iter,
    cluster_sizes, balance_stats, pruning_ratios, pruning_rate, pruning_thresholds, dimension_split, tune_partial_d, rotate_norms, rotate_distances, rotate_roundtrip,
    pruned_assign, pruned_agreement, assign_training, assign_training_given, output_centroids, early_stop, recall_patience, weighted_seed, fine_budgets, hier_meso, hier_fine, hier_train,
    assign_training_stored, assign_training_weighted, assign_training_meso, assign_training_fewer, assign_training_more, training_seeds, training_seeds_weighted, training_seeds_meso,
    assign_slabs, hier_centroids, hier_assign_index, index_clusters, lloyd_resumed, stream_sizes, train_recall, lloyd_blocked, blocked_stats, split_drawn, pull_drawn, knn_lists, gemm_tiled, gemm_pairs,
    hier_assign, split_empty, rebalance, blobs, uniform_vectors, utility_functions,
]
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL twins ---------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_N2 = "list_sum(list_transform({a}, lambda z: z * z))"


def _first(k: int) -> str:
    return f"c0 AS (SELECT (row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1)::INTEGER AS cid, x AS c FROM e QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) <= {k})"


def _assign(k: int, c: str = "c0", a: str = "a0") -> str:
    return f"{a} AS (SELECT vec_id, arg_min(cid, (d2, cid)) AS cid, min(d2) AS d2 FROM (SELECT vec_id, cid, {_D2.format(a='x', b='c')} AS d2 FROM e, {c}) GROUP BY vec_id)"


def _means(n: int, unit: bool = False) -> str:
    mean = f"m{n} AS (SELECT cid, i, avg(x[i]) AS v FROM e JOIN a{n - 1} USING (vec_id), range(1, {DIM + 1}) r(i) GROUP BY cid, i)"
    value = "list(v ORDER BY i)"
    if unit:
        value = "list_transform(list(v ORDER BY i), lambda z: z)"
        return f"{mean}, c{n} AS (SELECT cid, list_transform(c, lambda z: z / s) AS c FROM (SELECT cid, list(v ORDER BY i) AS c, greatest(sqrt(sum(v * v)), 1.1920929e-7) AS s FROM m{n} GROUP BY cid))"
    return f"{mean}, c{n} AS (SELECT cid, {value} AS c FROM m{n} GROUP BY cid)"


def _lloyd(n: int, k: int = 16, unit: bool = False) -> str:
    parts = [_E, _first(k), _assign(k)]
    for i in range(1, n + 1):
        parts.append(_means(i, unit))
        parts.append(_assign(k, f"c{i}", f"a{i}"))
    return "WITH " + ",\n".join(parts)


_UNROLL = f"SELECT cid, (i - 1)::INTEGER AS dim, round(c[i], 6) AS value FROM {{c}}, range(1, {DIM + 1}) r(i)"
_PAIRS = f"WITH {_E}, p AS (SELECT a.vec_id AS a_id, a.x AS a, b.x AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
_KNN = f"WITH {_E}, q AS (SELECT vec_id AS query_id, x FROM e WHERE vec_id % 20 = 0), p AS (SELECT vec_id::INTEGER AS neighbor_id, x AS c FROM e), d AS (SELECT query_id, neighbor_id, {_D2.format(a='x', b='c')} AS d2, {_D2.format(a='x[1:32]', b='c[1:32]')} AS h2 FROM q, p WHERE neighbor_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id)::INTEGER AS rank, row_number() OVER (PARTITION BY query_id ORDER BY h2, neighbor_id) AS other FROM d)"
_MEANS = f"m AS (SELECT label AS cid, i, avg(x[i]) AS v FROM e, range(1, {DIM + 1}) r(i) GROUP BY label, i), c0 AS (SELECT cid, list(v ORDER BY i) AS c FROM m GROUP BY cid)"
_VALUES = f"round(v[i], 6) AS value, size::INTEGER AS size FROM v, range(1, {DIM + 1}) r(i)"

_MD5 = "('0x' || substr(md5('{seed}:' || {of}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


def _sampled(share: float, k: int = 16) -> str:
    """One iteration of k clusters on a share of the vectors, s: first centroids c0, assignments a0 of all vectors, means c1."""
    s = f"s AS (SELECT * FROM e QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) <= floor((SELECT count(*) FROM e) * {share}::FLOAT::DOUBLE))"
    return f"WITH {_E}, {s}, {_first(k)}, {_assign(k)}, {_means(1).replace('FROM e JOIN', 'FROM s JOIN')}"


def _meso(k: int, iters: int) -> str:
    """A model of k clusters over the centroids c1 as vectors p: centroids g0, g1, ..., assignments h0, h1, ..."""
    order = f"row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id)"
    parts = [f"p AS (SELECT cid AS vec_id, c AS x FROM c1), g0 AS (SELECT {order} - 1 AS cid, x AS c FROM p QUALIFY {order} <= {k})"]
    near = lambda e, g, h: f"{h} AS (SELECT vec_id, arg_min(cid, (d2, cid)) AS cid FROM (SELECT vec_id, cid, {_D2.format(a='x', b='c')} AS d2 FROM {e}, {g}) GROUP BY vec_id)"
    for i in range(iters):
        parts.append(near("p", f"g{i}", f"h{i}"))
        parts.append(f"w{i} AS (SELECT cid, i, avg(x[i]) AS v FROM p JOIN h{i} USING (vec_id), range(1, {DIM + 1}) r(i) GROUP BY cid, i), g{i + 1} AS (SELECT cid, list(v ORDER BY i) AS c FROM w{i} GROUP BY cid)")
    return ", ".join([*parts, near("p", f"g{iters}", "home"), near("e", f"g{iters}", "near"), "last AS (SELECT cid AS meso, max(vec_id) AS c FROM home GROUP BY cid)"])


def _recall(n: int) -> str:
    """told: recall of every twentieth vector's ten neighbours after each iteration, in searches of 3 of 16 clusters."""
    pairs = f"t AS (SELECT q, p FROM (SELECT a.vec_id AS q, b.vec_id AS p, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2.format(a='a.x', b='b.x')}, b.vec_id) AS r FROM e a, e b WHERE a.vec_id % 20 = 0) WHERE r <= 10)"
    near = [f"l{i} AS (SELECT vec_id AS q, cid FROM (SELECT e.vec_id, cid, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_D2.format(a='e.x', b='c')}, cid) AS r FROM e, c{i} WHERE e.vec_id % 20 = 0) WHERE r <= 3)" for i in range(1, n + 1)]
    told = " UNION ALL ".join(f"SELECT {i}::INTEGER AS iteration, avg((l{i}.cid IS NOT NULL)::INTEGER) AS recall FROM t JOIN a{i} ON a{i}.vec_id = t.p LEFT JOIN l{i} ON l{i}.q = t.q AND l{i}.cid = a{i}.cid" for i in range(1, n + 1))
    return ", ".join([_lloyd(n), pairs, *near, f"told AS ({told})"])


_TO_C1 = f", {_assign(16, 'c1', 'a1')} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a1"
_SIZES = "z AS (SELECT i AS cid, greatest((SELECT count(*) FROM a0 JOIN s USING (vec_id) WHERE cid = i), 1) AS size FROM range(16) r(i)), u AS (SELECT cid, sum(size) OVER (ORDER BY cid) / (SELECT sum(size) FROM z) AS high FROM z)"
_DRAWN = "SELECT e.cid, (SELECT max(cid) FROM w WHERE low <= e.u * (SELECT sum(w) FROM w)) AS chosen FROM e_ e"
_ALL_ROWS = "s AS (SELECT cid, (SELECT count(*) FROM a0 WHERE a0.cid = c0.cid) AS size, c FROM c0)"

# Both levels of sixteen clusters: f1 has the fine centroids, numbered by meso cluster and place in it.
_TWO_LEVELS = (
    f"WITH RECURSIVE {_E}, {_first(4)}, {_assign(4)}, {_means(1)}, {_assign(4, 'c1', 'a1')}, "
    "z AS (SELECT cid AS meso, count(*) AS size, row_number() OVER (ORDER BY cid) AS p, count(*) OVER () AS m FROM a1 GROUP BY cid), "
    "w(p, meso, budget, k, n, first) AS (SELECT 0::BIGINT, NULL::INTEGER, 0::BIGINT, 16::BIGINT, (SELECT sum(size) FROM z)::BIGINT, 0::BIGINT UNION ALL SELECT z.p, z.meso, b, w.k - b, w.n - z.size, w.first + w.budget FROM w JOIN z ON z.p = w.p + 1, LATERAL (SELECT least(greatest(CASE WHEN z.p < z.m THEN least(floor(w.k * z.size / w.n + 0.5)::BIGINT, w.k - (z.m - z.p)) ELSE w.k END, 1), z.size) AS b)), "
    f"o AS (SELECT a1.cid AS meso, e.vec_id, x, row_number() OVER (PARTITION BY a1.cid ORDER BY md5('{SEED}:' || e.vec_id), e.vec_id) - 1 AS p FROM e JOIN a1 USING (vec_id)), "
    "f0 AS (SELECT o.meso, w.first + o.p AS cid, o.x AS c FROM o JOIN w USING (meso) WHERE o.p < w.budget), "
    f"b0 AS (SELECT vec_id, arg_min(cid, (d2, cid)) AS cid FROM (SELECT vec_id, cid, {_D2.format(a='x', b='c')} AS d2 FROM o JOIN f0 USING (meso)) GROUP BY vec_id), "
    f"g AS (SELECT cid, i, avg(x[i]) AS v FROM o JOIN b0 USING (vec_id), range(1, {DIM + 1}) r(i) GROUP BY cid, i), "
    f"f1 AS (SELECT f0.meso, f0.cid::INTEGER AS cid, t.c FROM (SELECT cid, list(v ORDER BY i) AS c FROM g GROUP BY cid) t JOIN f0 USING (cid))"
)

ORACLES = {
    "hier_centroids": _TWO_LEVELS + " " + _UNROLL.format(c="f1"),
    "hier_assign_index": f"{_TWO_LEVELS}, {_assign(16, 'f1', 'h')} SELECT vec_id, cid, round(d2, 6) AS d2 FROM h",
    "index_clusters": f"{_TWO_LEVELS}, {_assign(16, 'f1', 'h')}, n AS (SELECT cid, count(*) AS n, sqrt(max(d2)) AS radius FROM h GROUP BY cid), t AS (SELECT meso, f1.cid, coalesce(n, 0) AS n, coalesce(radius, 0) AS radius FROM f1 LEFT JOIN n USING (cid)) SELECT meso, cid, n, (sum(n) OVER (ORDER BY meso, cid) - n)::BIGINT AS start, round(radius, 6) AS radius FROM t",
    "assign_slabs": _lloyd(1) + " SELECT vec_id, cid FROM a1",
    "assign_training_stored": _lloyd(1) + " SELECT vec_id, cid, round(d2, 6) AS d2 FROM a1",
    "assign_training_weighted": _sampled(0.9) + _TO_C1,
    "assign_training_meso": _sampled(0.5) + _TO_C1,
    "assign_training_fewer": f"WITH {_E}, {_first(5)}, {_assign(5)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "assign_training_more": f"WITH {_E}, {_first(40)}, {_assign(40)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "training_seeds": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT vec_id, cid AS prev_cid FROM a0",
    "training_seeds_weighted": f"{_sampled(0.9)}, {_SIZES} SELECT e.vec_id, (CASE WHEN s.vec_id IS NOT NULL THEN a0.cid ELSE least((SELECT count(*) FROM u WHERE high <= {_MD5.format(seed=SEED + 1, of='e.vec_id')}), 15) END)::INTEGER AS prev_cid FROM e JOIN a0 ON a0.vec_id = e.vec_id LEFT JOIN s ON s.vec_id = e.vec_id",
    "training_seeds_meso": f"{_sampled(0.5)}, {_meso(4, 10)} SELECT e.vec_id, (CASE WHEN s.vec_id IS NOT NULL THEN a0.cid ELSE coalesce(l.c, 0) END)::INTEGER AS prev_cid FROM e JOIN a0 ON a0.vec_id = e.vec_id JOIN near ON near.vec_id = e.vec_id LEFT JOIN last l ON l.meso = near.cid LEFT JOIN s ON s.vec_id = e.vec_id",
    "train_recall": _recall(3) + " SELECT iteration, round(recall, 6) AS recall FROM told",
    "lloyd_blocked": _lloyd(2) + " " + _UNROLL.format(c="c2"),
    "split_drawn": f"WITH {_E}, {_first(16)}, {_assign(16)}, {_ALL_ROWS}, w AS (SELECT cid, size, size - 1 AS w, sum(size - 1) OVER (ORDER BY cid) - (size - 1) AS low FROM s WHERE size > 1), e_ AS (SELECT i AS cid, {_MD5.format(seed=SEED + 1, of='i')} AS u FROM range(16, 24) r(i)), d AS ({_DRAWN}), t AS (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY cid) - 1 AS turn FROM d), n AS (SELECT chosen, count(*) AS n FROM t GROUP BY chosen), v AS (SELECT t.cid::INTEGER AS cid, list_transform(s.c, lambda z, i: z * pow(1 - CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END / 1024, turn) * (1 + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END / 1024)) AS v, floor(ceil(s.size / pow(2, turn)) / 2)::BIGINT AS size FROM t JOIN s ON s.cid = t.chosen UNION ALL SELECT s.cid, list_transform(s.c, lambda z, i: z * pow(1 - CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END / 1024, coalesce(n, 0))), ceil(s.size / pow(2, coalesce(n, 0)))::BIGINT FROM s LEFT JOIN n ON n.chosen = s.cid) SELECT cid, (i - 1)::INTEGER AS dim, round(v[i], 6) AS value, size FROM v, range(1, {DIM + 1}) r(i)",
    "pull_drawn": f"WITH {_E}, {_first(100)}, {_assign(100)}, {_ALL_ROWS}, b AS (SELECT count(*) // 100 AS a FROM e), w AS (SELECT cid, c, size - a + 1 AS w, sum(size - a + 1) OVER (ORDER BY cid) - (size - a + 1) AS low FROM s, b WHERE size >= a), e_ AS (SELECT cid, {_MD5.format(seed=SEED, of='cid')} AS u FROM s, b WHERE size > 0 AND size <= floor(a * 0.25)), d AS ({_DRAWN}), v AS (SELECT s.cid, CASE WHEN w.c IS NULL THEN s.c ELSE list_transform(list_zip(s.c, w.c), lambda z: (least(s.size, 7) * z[1] + z[2]) / (least(s.size, 7) + 1)) END AS v, size FROM s LEFT JOIN d ON d.cid = s.cid LEFT JOIN w ON w.cid = d.chosen) SELECT cid, (i - 1)::INTEGER AS dim, round(v[i], 6) AS value, size FROM v, range(1, {DIM + 1}) r(i)",
    "knn_lists": f"{_KNN} SELECT query_id, rank, neighbor_id, round(d2, 6) AS d2 FROM r WHERE rank <= 10",
    "gemm_tiled": f"WITH {_E}, g AS (SELECT r.i, s.j, sum(x[r.i] * x[s.j]) AS v FROM e, range(1, {DIM + 1}) r(i), range(1, {DIM + 1}) s(j) GROUP BY r.i, s.j) SELECT vec_id, (j - 1)::INTEGER AS j, round(sum(x[i] * v), 4) + 0.0::DOUBLE AS value FROM e, g GROUP BY vec_id, j",
    "gemm_pairs": f"WITH {_E}, {_MEANS} SELECT vec_id AS i, cid AS j, round({_DOT.format(a='x', b='c')}, 6) AS value FROM e, c0",
    "gemm_gram": f"WITH {_E}, {_MEANS} SELECT vec_id AS i, cid AS j, round({_DOT.format(a='x', b='c')}, 6) AS value FROM e, c0",
    "gemm_ab": f"WITH {_E}, g AS (SELECT r.i, s.j, sum(x[r.i] * x[s.j]) AS v FROM e, range(1, 49) r(i), range(1, {DIM + 1}) s(j) GROUP BY r.i, s.j) SELECT vec_id, (j - 1)::INTEGER AS j, round(sum(x[i] * v), 4) AS value FROM e, g GROUP BY vec_id, j",
    "gemm_transposed": f"WITH {_E} SELECT (r.i - 1)::INTEGER AS i, (s.j - 1)::INTEGER AS j, round(sum(x[r.i] * x[s.j]), 6) AS value FROM e, range(1, 17) r(i), range(1, 25) s(j) GROUP BY r.i, s.j",
    "assign_in_blocks": f"WITH {_E}, {_first(100)}, {_assign(100)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "knn_recall": f"{_KNN} SELECT round(count(*) FILTER (rank <= 10 AND other <= 10) / count(*) FILTER (rank <= 10), 6) AS recall FROM r",
    "sample_sizes_uncapped": "SELECT o_orderpriority, fraction, (CASE WHEN fraction = 1 THEN n ELSE floor(n * fraction::FLOAT::DOUBLE) END)::INTEGER AS size FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority), (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9), (1.0)) f(fraction)",
    "pruning_rate": f"WITH {_E}, {_first(100)}, b AS (SELECT vec_id, x, {_D2.format(a='x', b='c')} AS d2 FROM e JOIN c0 ON cid = vec_id % 100) SELECT round(count(*) FILTER ({_D2.format(a='x[1:32]', b='c[1:32]')} < d2 * 0.5 * (1 + 1.5 / sqrt(32)) * (1 + 1.5 / sqrt(32))) / count(*), 6) AS not_pruned_pct FROM b, c0",
    "pruning_thresholds": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT vec_id, v::INTEGER AS visited, round(d2 * CASE WHEN v = {DIM} THEN 1 ELSE v / {DIM} * (1 + 1.5 / sqrt(v)) * (1 + 1.5 / sqrt(v)) END, 6) AS threshold FROM a0, (VALUES (16), (32), (64)) t(v)",
    "assign_training": _lloyd(1) + " SELECT vec_id, cid, round(d2, 6) AS d2 FROM a1",
    "assign_training_given": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "output_centroids": _lloyd(1) + " " + _UNROLL.format(c="c1"),
    "early_stop": _lloyd(4) + ", s AS (" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS iteration, (SELECT sum(d2) FROM a{i - 1}) AS o, (SELECT sum({_D2.format(a='n.c', b='o.c')}) FROM c{i} n JOIN c{i - 1} o USING (cid)) AS m" for i in (1, 2, 3, 4)) + ") SELECT iteration, round(o, 6) AS objective, round(m, 6) AS shift, m < 0.02 OR coalesce(o / lag(o) OVER (ORDER BY iteration) > 1 - 0.02, false) AS stops FROM s",
    "recall_patience": _recall(4).replace("WITH ", "WITH RECURSIVE ", 1) + ", w(n, best, without) AS (SELECT 0, 0::DOUBLE, 0 UNION ALL SELECT n + 1, CASE WHEN recall - best > 0.02 THEN recall ELSE best END, CASE WHEN recall - best > 0.02 THEN 0 ELSE without + 1 END FROM w JOIN told ON iteration = n + 1) SELECT n::INTEGER AS iteration, without >= 2 AS stops FROM w WHERE n > 0",
    "weighted_seed": f"WITH {_E}, {_first(16)}, {_assign(16)}, s AS (SELECT i AS cid, greatest((SELECT count(*) FROM a0 WHERE cid = i), 1) AS size FROM range(16) r(i)), u AS (SELECT cid, sum(size) OVER (ORDER BY cid) / (SELECT sum(size) FROM s) AS high FROM s), d AS (SELECT ('0x' || substr(md5('{SEED + 1}:' || vec_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS x FROM e), t AS (SELECT (SELECT count(*) FROM u WHERE high <= x) AS cid FROM d) SELECT least(cid, 15)::INTEGER AS cid, count(*) AS count FROM t GROUP BY ALL",
    "fine_budgets": "WITH RECURSIVE s AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) AS p, count(*) OVER () AS m FROM embeddings GROUP BY label), w(p, label, size, budget, k, n) AS (SELECT 0::BIGINT, NULL::INTEGER, 0::BIGINT, 0::BIGINT, 50::BIGINT, (SELECT sum(size) FROM s)::BIGINT UNION ALL SELECT s.p, s.label, s.size, b, w.k - b, w.n - s.size FROM w JOIN s ON s.p = w.p + 1, LATERAL (SELECT least(greatest(CASE WHEN s.p < s.m THEN least(floor(w.k * s.size / w.n + 0.5)::BIGINT, w.k - (s.m - s.p)) ELSE w.k END, 1), s.size) AS b)) SELECT label, size, budget::INTEGER AS budget FROM w WHERE p > 0",
    "hier_fine": f"WITH {_E}, o AS (SELECT label, vec_id, x, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS p FROM e), c AS (SELECT label, p AS cid, x AS c FROM o WHERE p < 3), a AS (SELECT vec_id, arg_min(cid, (d2, cid)) AS cid FROM (SELECT vec_id, cid, {_D2.format(a='x', b='c')} AS d2 FROM e JOIN c USING (label)) GROUP BY vec_id) SELECT label, cid::INTEGER AS local, (i - 1)::INTEGER AS dim, round(avg(x[i]), 6) AS value FROM e JOIN a USING (vec_id), range(1, {DIM + 1}) r(i) GROUP BY label, cid, i",
    "split_empty": f"WITH {_E}, {_first(3)}, v AS (SELECT k.cid, list_transform(o.c, lambda z, i: z * (1 + CASE WHEN k.cid = 2 THEN 0 WHEN (i % 2 = 1) = (k.cid = 1) THEN 1 ELSE -1 END / 1024)) AS v, [49, 49, 1][k.cid + 1] AS size FROM c0 k JOIN c0 o ON o.cid = CASE WHEN k.cid = 1 THEN 0 ELSE k.cid END) SELECT cid, (i - 1)::INTEGER AS dim, {_VALUES}",
    "rebalance": f"WITH {_E}, {_first(4)}, v AS (SELECT k.cid, list_transform(list_zip(k.c, o.c), lambda z: CASE WHEN k.cid = 0 THEN z[1] ELSE (k.cid * z[1] + z[2]) / (k.cid + 1) END) AS v, [94, 1, 2, 3][k.cid + 1] AS size FROM c0 k JOIN c0 o ON o.cid = 0) SELECT cid, (i - 1)::INTEGER AS dim, {_VALUES}",
    "l2_squared_pairs": f"{_PAIRS} SELECT a_id, round({_D2.format(a='a', b='b')}, 6) AS d2 FROM p",
    "l2_prefix_pairs": f"{_PAIRS} SELECT a_id, " + ", ".join(f"round({_D2.format(a=f'a[1:{n}]', b=f'b[1:{n}]')}, 6) AS d2_{n}" for n in (16, 32, 100)) + " FROM p",
    "dot_pairs": f"{_PAIRS} SELECT a_id, round({_DOT.format(a='a', b='b')}, 6) AS dot, round({_DOT.format(a='a[1:24]', b='b[1:24]')}, 6) AS dot_24 FROM p",
    "norms_full": f"WITH {_E} SELECT vec_id, round({_N2.format(a='x')}, 6) AS norm2 FROM e",
    "norms_partial": f"WITH {_E} SELECT vec_id, " + ", ".join(f"round({_N2.format(a=f'x[1:{p}]')}, 6) AS norm2_{p}" for p in (8, 48, 80)) + " FROM e",
    "normalize_rows": f"WITH {_E} SELECT vec_id, (i - 1)::INTEGER AS dim, round(x[i] * 3 / greatest(sqrt({_N2.format(a='list_transform(x, lambda y: y * 3)')}), 1.1920929e-7), 6) AS value FROM e, range(1, {DIM + 1}) r(i)",
    "sql_functions": f"{_PAIRS} SELECT a_id, round({_D2.format(a='a', b='b')}, 6) AS d2, round({_DOT.format(a='a', b='b')}, 6) AS dot, round({_N2.format(a='a')}, 6) AS norm2 FROM p",
    "gemm_dims": f"WITH {_E} SELECT (r.i - 1)::INTEGER AS i, (s.j - 1)::INTEGER AS j, round(sum(x[r.i] * x[s.j]), 6) AS value FROM e, range(1, {DIM + 1}) r(i), range(1, {DIM + 1}) s(j) GROUP BY r.i, s.j",
    "dot_matrix": f"WITH {_E}, {_first(16)} SELECT vec_id, cid, round({_DOT.format(a='x[1:32]', b='c[1:32]')}, 6) AS dot FROM e, c0",
    "assign_sql": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "assign_sql_hof": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "assign_arrow": f"WITH {_E}, {_first(100)}, {_assign(100)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "assign_label_centroids": f"WITH {_E}, m AS (SELECT label AS cid, i, avg(x[i]) AS v FROM e, range(1, {DIM + 1}) r(i) GROUP BY label, i), c0 AS (SELECT cid, list(v ORDER BY i) AS c FROM m GROUP BY cid), {_assign(10)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "assign_lineitem": f"""WITH v AS (SELECT trunc(l_extendedprice * 100)::BIGINT AS vec_id, [(l_quantity / 50)::FLOAT::DOUBLE, (l_extendedprice / 100000)::FLOAT::DOUBLE, (l_discount * 10)::FLOAT::DOUBLE, (l_tax * 10)::FLOAT::DOUBLE] AS x FROM lineitem),
e AS (SELECT vec_id, min(x) AS x FROM v GROUP BY vec_id), {_first(32)}, n AS (SELECT x, row_number() OVER () AS rid FROM v), d AS (SELECT rid, cid, {_D2.format(a='x', b='c')} AS d2 FROM n, c0),
t AS (SELECT arg_min(cid, (d2, cid)) AS cid, min(d2) AS d2 FROM d GROUP BY rid) SELECT cid, count(*) AS size, round(sum(d2), 3) AS cost FROM t GROUP BY cid""",
    "knn_topk": f"{_KNN} SELECT query_id, rank, neighbor_id, round(d2, 6) AS d2 FROM r WHERE rank <= 10",
    "knn_sql": f"{_KNN} SELECT query_id, rank, neighbor_id, round(d2, 6) AS d2 FROM r WHERE rank <= 5",
    "knn_padded": f"WITH {_E}, {_first(4)}, d AS (SELECT vec_id AS query_id, cid, {_D2.format(a='x', b='c')} AS d2 FROM e, c0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, cid)::INTEGER AS rank FROM d) SELECT query_id, rank, cid AS neighbor_id, round(d2, 6) AS d2 FROM r UNION ALL SELECT vec_id, i::INTEGER, -1, -1.0 FROM e, range(5, 7) t(i)",
    "survivor_filter": f"WITH {_E}, {_first(16)} SELECT vec_id, cid, round({_D2.format(a='x[1:32]', b='c[1:32]')}, 6) AS d2 FROM e, c0 WHERE {_D2.format(a='x[1:32]', b='c[1:32]')} < 0.8",
    "forgy_init": f"WITH {_E}, {_first(16)} " + _UNROLL.format(c="c0"),
    "train_sample": f"SELECT vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) <= least(floor((SELECT count(*) FROM embeddings) * 0.3::FLOAT::DOUBLE), 16 * 256)",
    "sample_sizes": "SELECT label, fraction, (CASE WHEN fraction = 1 THEN n ELSE least(floor(n * fraction::FLOAT::DOUBLE), 32) END)::INTEGER AS size FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label), (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9), (1.0)) f(fraction)",
    "centroid_update": _lloyd(1) + " SELECT cid, (i - 1)::INTEGER AS dim, round(v, 6) AS value FROM m1",
    "lloyd_1": _lloyd(1) + " " + _UNROLL.format(c="c1"),
    "lloyd_2": _lloyd(2) + " " + _UNROLL.format(c="c2"),
    "lloyd_3": _lloyd(3) + " " + _UNROLL.format(c="c3"),
    "angular_centroids": _lloyd(1, unit=True) + " " + _UNROLL.format(c="c1"),
    "train_stats": _lloyd(3) + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS iteration, round((SELECT sum(d2) FROM a{i - 1}), 6) AS objective, round((SELECT sum({_D2.format(a='n.c', b='o.c')}) FROM c{i} n JOIN c{i - 1} o USING (cid)), 6) AS shift, 0::INTEGER AS split, true AS is_gemm_only" for i in (1, 2, 3)),
    "objective": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT round(sum(d2), 6) AS objective FROM a0",
    "shift_one_iter": _lloyd(1) + f" SELECT round(sum({_D2.format(a='n.c', b='o.c')}), 6) AS shift FROM c1 n JOIN c0 o USING (cid)",
    "cluster_sizes": f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT i::INTEGER AS cid, (SELECT count(*) FROM a0 WHERE cid = i) AS size FROM range(16) r(i)",
    "balance_stats": f"WITH {_E}, {_first(16)}, {_assign(16)}, s AS (SELECT i AS cid, (SELECT count(*) FROM a0 WHERE cid = i) AS size FROM range(16) r(i)) SELECT round(avg(size), 6) AS mean, round(coalesce(exp(avg(ln(nullif(size, 0)))), 0), 6) AS geometric_mean, round(stddev_pop(size), 6) AS stdev, round(stddev_pop(size) / avg(size), 6) AS cv, min(size) AS min, max(size) AS max FROM s",
    "pruning_ratios": "SELECT vec_id, v AS visited, round(CASE WHEN v = 0 OR v = d THEN 1.0 ELSE v::DOUBLE / d * (1 + 1.5::DOUBLE / sqrt(v::DOUBLE)) * (1 + 1.5::DOUBLE / sqrt(v::DOUBLE)) END, 6) AS flat, round(CASE WHEN v = 0 OR v = d THEN 1.0 ELSE v::DOUBLE / d * (1 + 1.1::DOUBLE / sqrt(v::DOUBLE)) * (1 + 1.1::DOUBLE / sqrt(v::DOUBLE)) END, 6) AS hierarchical FROM (SELECT vec_id, len(embedding) AS d, vec_id % (len(embedding) + 1) AS v FROM embeddings)",
    "dimension_split": "WITH a AS (SELECT p_partkey, p_size * 32 + p_partkey % 33 AS d FROM part), b AS (SELECT *, CASE WHEN d <= 64 THEN 0 ELSE floor(floor(d * CASE WHEN d <= 256 THEN 0.25 ELSE 0.75 END) / 64 + 0.5) * 64 END AS h FROM a), c AS (SELECT p_partkey, d, CASE WHEN d > 64 AND h >= d THEN 64 ELSE h END AS h FROM b) SELECT p_partkey, d::INTEGER AS d, h::INTEGER AS h, (d - h)::INTEGER AS v, least(d - h, greatest(16, floor((d - h) / 2)))::INTEGER AS p FROM c",
    "tune_partial_d": f"WITH {_E}, {_first(100)}, b AS (SELECT vec_id, label, x, {_D2.format(a='x', b='c')} AS d2 FROM e JOIN c0 ON cid = vec_id % 100), t AS (SELECT label, count(*) FILTER ({_D2.format(a='x[1:32]', b='c[1:32]')} < d2 * 0.5 * (1 + 1.5 / sqrt(32)) * (1 + 1.5 / sqrt(32))) / count(*) AS r FROM b, c0 GROUP BY label) SELECT label, round(r, 6) AS rate, (CASE WHEN r * 1.0 > 0.05 THEN least(192, 32 + greatest(1, floor(32 * 0.4))) WHEN r * 1.0 < 0.03 THEN least(192, greatest(16, 32 - greatest(1, floor(32 * 0.2)))) ELSE 32 END)::INTEGER AS grown, (CASE WHEN r * 0.01 > 0.05 THEN least(192, 32 + greatest(1, floor(32 * 0.4))) WHEN r * 0.01 < 0.03 THEN least(192, greatest(16, 32 - greatest(1, floor(32 * 0.2)))) ELSE 32 END)::INTEGER AS shrunk, (CASE WHEN r * 0.01 > 0.05 THEN least(192, 18 + greatest(1, floor(18 * 0.4))) WHEN r * 0.01 < 0.03 THEN least(192, greatest(16, 18 - greatest(1, floor(18 * 0.2)))) ELSE 18 END)::INTEGER AS least, (CASE WHEN r * 1.0 > 0.05 THEN least(192, 180 + greatest(1, floor(180 * 0.4))) WHEN r * 1.0 < 0.03 THEN least(192, greatest(16, 180 - greatest(1, floor(180 * 0.2)))) ELSE 180 END)::INTEGER AS most FROM t",
    "rotate_norms": f"WITH {_E} SELECT vec_id, round({_N2.format(a='x')}, 5) AS norm2 FROM e",
    "rotate_distances": f"{_PAIRS} SELECT a_id, round({_D2.format(a='a', b='b')}, 6) AS d2 FROM p",
    "rotate_roundtrip": f"WITH {_E} SELECT vec_id, (i - 1)::INTEGER AS dim, round(x[i], 6) AS value FROM e, range(1, {DIM + 1}) r(i)",
    "pruned_assign": f"WITH {_E}, {_first(100)}, {_assign(100)} SELECT vec_id, cid, round(d2, 6) AS d2 FROM a0",
    "hier_meso": _lloyd(1, 4) + " " + _UNROLL.format(c="c1"),
    "blobs": "SELECT vec_id, 32::INTEGER AS d, 1.0::DOUBLE AS norm2 FROM embeddings",
    "uniform_vectors": "SELECT 16 * count(*) AS n, true AS low, true AS high FROM embeddings",
    "utility_functions": "SELECT o_orderkey, (ceil(o_orderkey / 8) * 8)::BIGINT AS up8, o_orderkey AS up0, o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0 AS power FROM orders",
}
ORACLES["pruned_agreement"] = "SELECT count(*) > 0 AS agrees FROM embeddings"
ORACLES["blocked_stats"] = ORACLES["train_stats"]
ORACLES["lloyd_resumed"] = ORACLES["lloyd_3"]
ORACLES["stream_sizes"] = f"WITH {_E}, {_first(16)}, {_assign(16)} SELECT cid, count(*) AS size FROM a0 GROUP BY cid"
