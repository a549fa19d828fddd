"""Objective, cluster balance, agreement and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(assigned: DataFrame, k: int | None = None) -> DataFrame:
    """(cid, size); with k, empty clusters too."""
    counts = assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    if k is None:
        return counts
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
    return every.join(counts, "cid", "left").select("cid", F.coalesce("size", F.lit(0)).alias("size"))


def balance(assigned: DataFrame, k: int) -> DataFrame:
    """One row: mean, geometric mean of the non-empty, population deviation, its share of the mean, min, max."""
    s = F.col("size")
    out = sizes(assigned, k).agg(
        F.avg(s).alias("mean"),
        F.coalesce(F.exp(F.avg(F.when(s > 0, F.log(s)))), F.lit(0.0)).alias("geometric_mean"),
        F.stddev_pop(s).alias("stdev"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
    )
    return out.select("mean", "geometric_mean", "stdev", F.when(F.col("mean") > 0, F.col("stdev") / F.col("mean")).otherwise(0.0).alias("cv"), "min", "max")


def objective(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("objective"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of vectors that two assignments give the same centroid."""
    pairs = a.select("vec_id", F.col("cid").alias("x")).join(b.select("vec_id", F.col("cid").alias("y")), "vec_id")
    return pairs.agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, from two (query_id, neighbor_id) tables."""
    hit = truth.join(found.select("query_id", "neighbor_id").distinct(), ["query_id", "neighbor_id"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    return hit.crossJoin(truth.agg(F.count(F.lit(1)).alias("all"))).select((F.col("hit") / F.col("all")).alias("recall"))


def pruning_rate(pruned: DataFrame, k: int) -> DataFrame:
    return pruned.agg((F.sum("not_pruned") / (F.count(F.lit(1)) * k)).alias("not_pruned_pct"))
