"""Shared helpers of the training-data operators: tables in the shared folder, column checks, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or a digest up to which a side is broadcast (some 50 MB at most); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
_OWN: dict[str, str] = {}


#: Rows and bytes in a batch between the JVM and Python: a few MB, so two workers fit beside a small heap.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < bytes_of(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


def lean(kernel: Callable) -> Callable:
    """A kernel for mapInArrow that gives its memory back when its task ends; the worker lives on, and serves other operators too."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may go without and gets a folder of its own."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vecforge-")
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vecforge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, is read again when an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that `written` gave and whose readers are done."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def few(rows: DataFrame) -> DataFrame:
    """Written rows of a few numbers, as the side of a join: broadcast up to BROADCAST_ROWS, else shuffled, where adaptive execution splits skewed keys."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def within(df: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `df` whose key is in `ids` (distinct, already written)."""
    return df.join(few(ids), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `df` whose key is not in `ids` (distinct, already written); a null key stays."""
    return df.join(few(ids), key, "left_anti")


def table(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def rounds(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Slices (start, stop) of `texts` that hold about `limit` bytes each, one text at least."""
    sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (id, component), component the smallest id reachable.

    First each task replaces its edges by a spanning forest, so that a hub's
    many edges shrink before any shuffle. Then labels travel along the edges
    and jump to their label's label until nothing changes, in a number of
    rounds that grows with the logarithm of a component's diameter. Sums and
    minima are pre-aggregated, joins may be split by adaptive execution, and
    every round is a written table. Null ends are ignored; no edges, no rows.
    """
    spark = edges.sparkSession

    def forest(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
        roots = np.array([root(x) for x in nodes.tolist()], dtype=np.int64)
        for k in range(0, len(nodes), 100_000):
            yield table(["a", "b"], [nodes[k : k + 100_000], roots[k : k + 100_000]], [pa.int64(), pa.int64()])

    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    near = written(both.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).mapInArrow(lean(forest), "a long, b long"), "forest")
    links = near.where("a != b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "labels")
    while True:
        told = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("told"))
        lower = labels.join(told, "id", "left").select("id", F.least("component", F.coalesce("told", "component")).alias("component"), F.col("component").alias("was"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = written(lower.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"), "labels")
        done = after.where("component != was").isEmpty()
        dropped(labels, lower)
        labels = after.drop("was")
        labels.written_to = after.written_to
        if done:
            dropped(near)
            return labels
