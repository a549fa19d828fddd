"""Token ids as ORC files that can be read by stripe and pruned by metadata.

Columns: part (the writing task), at (ids before the document in its part),
doc_id, n_tokens, ids. Files are sorted by doc_id within disjoint ranges, so
file, stripe and row-index statistics prune ranges of ids, and Bloom filters on
doc_id prune single ids. ORC's run-length encoding version 2 packs the ids.
Readers take stripes in parallel; a document's global start is its part's start
plus `at`, so no order has to be rebuilt.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, table
from .tokenize import encoder

ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
_SCHEMA = "part int, at long, doc_id long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all texts (null: empty), append `end_id`, write in ascending doc_id order. Null ids come first, equal ids in order of their text's hash."""

    small_batches(docs.sparkSession)
    def encode(batches):
        enc, task, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        names, types = ["part", "at", "doc_id", "n_tokens", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            raw = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            values = pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32))
            columns = [pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(at + bounds[:-1]), batch.column(0), pa.array(n)]
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)] + [ids], names=names)
            at += int(bounds[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.mapInArrow(lean(encode), _SCHEMA).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: (doc_id, start, n_tokens, ids), start counting the ids of all documents before it.

    Filters on doc_id reach the files' statistics and Bloom filters; ids are read only if used.
    """
    rows = spark.read.schema(_SCHEMA).orc(path)
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a file
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    base = spark.createDataFrame(starts, "part int, base long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checked(rows: DataFrame) -> DataFrame:
    """`ids` replaced by its CRC-32 over little-endian unsigned 32-bit integers: (doc_id, start, n_tokens, ids_crc32)."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, bounds = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            found = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield table(["doc_id", "start", "n_tokens", "ids_crc32"], [*batch.columns[:3], found], [pa.int64()] * 4)

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(lean(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")
