"""Vector tables and models in files: Parquet, ORC, JSON and CSV (arrays as JSON text)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CENTROIDS, vectors


def read_vectors(spark: SparkSession, path: str, fmt: str = "parquet", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of a table; only those columns are scanned."""
    if fmt == "csv":
        rows = spark.read.schema(f"`{vec_id}` long, `{embedding}` string").option("header", True).option("enforceSchema", False).csv(path)
        return rows.select(F.col(vec_id).alias("vec_id"), F.from_json(embedding, "array<float>").alias("embedding"))
    if fmt == "json":
        return vectors(spark.read.schema(f"`{vec_id}` long, `{embedding}` array<float>").json(path), vec_id, embedding)
    return vectors(spark.read.format(fmt).load(path), vec_id, embedding)


def write_vectors(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "csv":
        df.select("vec_id", F.to_json("embedding").alias("embedding")).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.format(fmt).mode(mode).save(path)


def centroid_table(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, row) for i, row in enumerate(c.tolist())], CENTROIDS)


def from_columns(df: DataFrame, vec_id: str, columns: list[str]) -> DataFrame:
    """Vectors assembled from numeric columns; rows with a null among them are left out."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [vec_id, *columns]))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.array(*[F.col(c).cast("float") for c in columns]).alias("embedding"))
