"""Nearest-centroid assignment on streams: the batch kernel keeps no state and serves streams as it is; cluster sizes that follow moving vectors keep each one's latest cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.distance import assign, matrix, nearest
from ..schema import vectors


def read_stream(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>", files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files with vectors."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def assigned_stream(stream: DataFrame, c: np.ndarray) -> DataFrame:
    return assign(vectors(stream), np.arange(len(c), dtype=np.int32), c)


def windowed_sizes(stream: DataFrame, c: np.ndarray, time: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Cluster sizes by event-time window of a stream with `embedding` and the timestamp `time`; centroids are broadcast."""
    shared = stream.sparkSession.sparkContext.broadcast(c)

    def kernel(batches):
        m = shared.value
        for batch in batches:
            home = nearest(matrix(batch.column(1), m.shape[1]), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32))], names=["at", "cid"])

    rows = stream.select(F.col(time).cast("timestamp").alias("at"), "embedding").where("embedding is not null").mapInArrow(kernel, "at timestamp, cid int")
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "cid").agg(F.count(F.lit(1)).alias("size"))


def moves(stream: DataFrame, c: np.ndarray, at: str | None = None) -> DataFrame:
    """(cid, delta) of a stream of vectors that may come again: +1 for the cluster that a vector comes to, -1 for the one that it leaves.

    The state holds each vec_id's latest cluster, and the time `at` of it, a
    long; of rows of one id the one of the largest `at` counts, of equal ones
    the last that came, and one that is older than what is held changes nothing. Deltas add up to the sizes of the
    clusters' latest members, whatever the batches were. Rows with a null id or
    vector are left out.
    """
    rows = stream.where("vec_id is not null and embedding is not null")
    told = rows.select("vec_id", "embedding", (F.col(at) if at else F.lit(0)).cast("long").alias("at"))
    shared = stream.sparkSession.sparkContext.broadcast(c)

    def kernel(batches):
        m = shared.value
        for batch in batches:
            home = nearest(matrix(batch.column(1), m.shape[1]), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32)), batch.column(2)], names=["vec_id", "cid", "at"])

    def follow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (None, None)
        now, when = held, last
        for part in parts:
            i = len(part) - 1 - part["at"].to_numpy()[::-1].argmax()
            if when is None or part["at"].iloc[i] >= when:
                now, when = int(part["cid"].iloc[i]), int(part["at"].iloc[i])
        state.update((now, when))
        if now != held:
            out = [(now, 1), *([(held, -1)] if held is not None else [])]
            yield pd.DataFrame(out, columns=["cid", "delta"])

    assigned_ = told.mapInArrow(kernel, "vec_id long, cid int, at long")
    return assigned_.groupBy("vec_id").applyInPandasWithState(follow, "cid int, delta long", "cid int, at long", "append", GroupStateTimeout.NoTimeout)


def sizes_of(deltas: DataFrame) -> DataFrame:
    """(cid, size) from what `moves` wrote; clusters that all have left are left out."""
    return deltas.groupBy("cid").agg(F.sum("delta").alias("size")).where("size > 0")


def write_assignments(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly-once Parquet sink, for assignments and for moves; `once` handles what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
