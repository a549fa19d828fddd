"""Tables between jobs in the folder that driver and executors share, bucketed by a key or plain.

Two bucketed tables of one store have equal buckets, so that a join on their key
reads bucket against bucket: no exchange, whatever their size. Tables survive
lost executors; `discard` removes one, `release` all of a store.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of doubles in a bucket.
BUCKET_BYTES = 128 << 20
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process may go without, and gets a folder of its own."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vecforge-")
    return "file://" + _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Store:
    """Tables of about `rows` rows of width d each."""

    def __init__(self, spark: SparkSession, rows: int = 1, d: int = 1, key: str = "vec_id"):
        self.spark, self.key = spark, key
        self.buckets = max(min(8, spark.sparkContext.defaultParallelism), -(-rows * d * 8 // BUCKET_BYTES))
        self.tables: dict[str, str] = {}

    def bucketed(self, df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        """`df` bucketed by the key. `dealt`: its tasks hold one bucket each already, so that nothing has to move for one file a bucket."""
        name = f"vecforge_{name}_{uuid.uuid4().hex}"
        path = f"{folder(self.spark)}/{name}"
        rows = df if dealt else df.repartition(self.buckets, self.key)
        rows.write.bucketBy(self.buckets, self.key).option("path", path).format("parquet").saveAsTable(name)
        self.tables[name] = path
        out = self.spark.table(name)
        out.stored_as = name
        return out

    def plain(self, df: DataFrame, name: str) -> DataFrame:
        name = f"vecforge_{name}_{uuid.uuid4().hex}"
        path = f"{folder(self.spark)}/{name}"
        df.write.parquet(path)
        self.tables[name] = path
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_as = name
        return out

    def discard(self, table: DataFrame | None) -> None:
        """Remove a table that this store gave; None is none."""
        name = getattr(table, "stored_as", None)
        path = self.tables.pop(name, None)
        if path is not None:
            self.spark.sql(f"drop table if exists `{name}`")
            remove(self.spark, path)

    def release(self) -> None:
        for name, path in self.tables.items():
            self.spark.sql(f"drop table if exists `{name}`")
            remove(self.spark, path)
        self.tables = {}
