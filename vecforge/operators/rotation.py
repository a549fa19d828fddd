"""Random orthonormal rotation, the dimension split and pruning ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import EPSILON_FLAT, HORIZONTAL_BLOCK, HORIZONTAL_SHARE, MIN_PARTIAL_D
from .distance import matrix


@dataclass(frozen=True)
class Split:
    """How dimensions are visited: `vertical` first (its prefix by matrix product), `horizontal` in blocks."""

    horizontal: int
    vertical: int

    @classmethod
    def of(cls, d: int) -> "Split":
        if d <= HORIZONTAL_BLOCK:
            return cls(0, d)
        share = 0.25 if d <= 256 else HORIZONTAL_SHARE
        blocks = int(np.floor(int(d * share) / HORIZONTAL_BLOCK + 0.5))
        h = blocks * HORIZONTAL_BLOCK
        return cls(HORIZONTAL_BLOCK, d - HORIZONTAL_BLOCK) if h >= d else cls(h, d - h)

    def partial(self, divisor: int = 2) -> int:
        """Prefix that a pruned search starts with."""
        return min(self.vertical, max(MIN_PARTIAL_D, self.vertical // divisor))


@dataclass(frozen=True)
class Rotation:
    """x -> x M^T with M orthonormal, drawn from `seed`; lengths and distances stay."""

    d: int
    seed: int = 42
    epsilon: float = EPSILON_FLAT

    @cached_property
    def m(self) -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((self.d, self.d)))
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)

    @cached_property
    def ratios(self) -> np.ndarray:
        """Pruning ratio for 0 to d visited dimensions."""
        v = np.arange(self.d + 1, dtype=float)
        out = np.ones(self.d + 1)
        v = v[1:-1]
        out[1:-1] = v / self.d * (1 + self.epsilon / np.sqrt(v)) ** 2
        return out

    def threshold(self, best: float, visited: int) -> float:
        return float(best * self.ratios[visited])

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.m.T

    def unrotate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.m

    def apply(self, df: DataFrame, inverse: bool = False) -> DataFrame:
        """Rotated (vec_id, embedding); d * d doubles are broadcast."""
        shared = df.sparkSession.sparkContext.broadcast(self.m if inverse else self.m.T)

        def kernel(batches):
            for batch in batches:
                out = matrix(batch.column(1), len(shared.value)) @ shared.value
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["vec_id", "embedding"])

        return df.select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, embedding array<double>")


def tuned_partial_d(partial: int, not_pruned: float, vertical: int, low: float = 0.03, high: float = 0.05, factor: float = 0.2) -> int:
    """The next prefix: longer when too many candidates survive, shorter when few do."""
    if not_pruned > high:
        return min(vertical, partial + max(1, int(partial * factor * 2)))
    if not_pruned < low:
        return min(vertical, max(MIN_PARTIAL_D, partial - max(1, int(partial * factor))))
    return partial
