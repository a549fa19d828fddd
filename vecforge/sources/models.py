"""Versions of a model in training: what an iteration leaves, so that a later run goes on from there.

A version is a folder of its own. Its centroids are written first, its state
last; one whose state was not committed is no version. The last two are kept.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..config import require
from .storage import remove
from .tables import centroid_table


class ModelStore:
    """Versions under `path`, a folder that outlives the session. `kept`: versions that stay."""

    def __init__(self, path: str, kept: int = 2):
        require(kept > 0, "kept must be positive")
        self.path, self.kept = path.rstrip("/"), kept

    def _fs(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        """Iterations that are stored whole, in order."""
        at, fs = self._fs(spark)
        if not fs.exists(at):
            return []
        path = spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = [int(n.removeprefix("iteration=")) for n in names if n.startswith("iteration=")]
        return sorted(n for n in numbers if fs.exists(path(f"{self._at(n)}/state/_SUCCESS")))

    def _at(self, number: int) -> str:
        return f"{self.path}/iteration={number:06d}"

    def save(self, spark: SparkSession, number: int, c: np.ndarray, state: dict) -> None:
        """Commit a version; a part of it that an earlier run left is replaced."""
        centroid_table(spark, c).write.mode("overwrite").parquet(f"{self._at(number)}/centroids")
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._at(number)}/state")
        for old in self.versions(spark)[: -self.kept]:
            remove(spark, self._at(old))

    def latest(self, spark: SparkSession) -> tuple[int, np.ndarray, dict] | None:
        """The last whole version: its iteration, centroids and state."""
        from ..operators.distance import collected

        found = self.versions(spark)
        if not found:
            return None
        c = collected(spark.read.parquet(f"{self._at(found[-1])}/centroids"))[1]
        return found[-1], c, json.loads(spark.read.text(f"{self._at(found[-1])}/state").first()[0])
