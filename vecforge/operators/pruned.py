"""Approximate nearest centroid with adaptive-sampling pruning on rotated vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame

from ..config import CENTROID_BLOCK, HORIZONTAL_BLOCK
from .distance import SLICE, matrix
from .rotation import Split


#: Prefix distances held at once (4 MB, some twice that beside them), and pairs measured at once (64 dimensions of both sides: 8 MB).
SEEN, PAIRS = 1 << 19, 8_000


def stages(split: Split, partial: int) -> list[tuple[int, int]]:
    """Dimension ranges after the prefix: blocks of the horizontal part, then the rest of the vertical part."""
    d = split.horizontal + split.vertical
    out = [(a, min(a + HORIZONTAL_BLOCK, d)) for a in range(split.vertical, d, HORIZONTAL_BLOCK)]
    return out + ([(partial, split.vertical)] if partial < split.vertical else [])


def search(x: np.ndarray, previous: np.ndarray | None, c: np.ndarray, ratios: np.ndarray, split: Split, partial: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid, its squared distance and the number of prefix survivors, by vector; and the multiplications that it took.

    The distance to one good centroid bounds the search from the start: to the
    previous one if told, else to the one with the least distance over the
    prefix, whose products are needed anyway. A centroid goes as soon as its
    distance over the dimensions seen reaches the bound times their ratio. Ties
    keep the centroid found before.
    """
    n, d = x.shape
    rows = max(1, SEEN // (len(c) if previous is None else min(len(c), CENTROID_BLOCK)))  # without a previous one the least prefix is sought among all centroids at once
    if n > rows:
        parts = [search(x[a : a + rows], None if previous is None else previous[a : a + rows], c, ratios, split, partial) for a in range(0, n, rows)]
        at, best, count, work = zip(*parts, strict=True)
        return np.concatenate(at), np.concatenate(best), np.concatenate(count), sum(work)
    count, work = np.zeros(n, dtype=np.int64), 0
    head = x[:, :partial]
    hh = (head * head).sum(axis=1)
    best = at = None
    if previous is not None:
        at = previous.astype(np.int64)
        best = ((x - c[at]) ** 2).sum(axis=1)
        work += n * d
    step = len(c) if previous is None else CENTROID_BLOCK
    for k in range(0, len(c), step):
        y = c[k : k + step]
        tail = y[:, :partial]
        seen = head @ (-2.0 * tail.T)  # short of hh
        seen += (tail * tail).sum(axis=1)
        work += seen.size * partial
        if at is None:
            at = seen.argmin(axis=1)
            best = ((x - c[at]) ** 2).sum(axis=1)
            work += n * d
        i, j = np.nonzero(seen < (best * ratios[partial] - hh)[:, None])
        count += np.bincount(i, minlength=n)
        other = j + k != at[i]  # its distance is known already
        i, j = i[other], j[other]
        for a in range(0, len(i), PAIRS):
            work += _refine(x, y, k, i[a : a + PAIRS], j[a : a + PAIRS], seen, hh, best, at, ratios, split, partial)
    return at, best, count, work


def _refine(x: np.ndarray, y: np.ndarray, k: int, i: np.ndarray, j: np.ndarray, seen: np.ndarray, hh: np.ndarray, best: np.ndarray, at: np.ndarray, ratios: np.ndarray, split: Split, partial: int) -> int:
    """Measure the pairs (vector i, centroid j + k) stage by stage and note better ones in `best` and `at`; returns the multiplications."""
    value, visited, work = np.maximum(seen[i, j] + hh[i], 0.0), partial, 0
    for a, b in stages(split, partial):
        if not len(i):
            return work
        apart = x[i, a:b] - y[j, a:b]
        value = value + np.einsum("ij,ij->i", apart, apart)
        work += apart.size
        visited += b - a
        stay = value < best[i] * ratios[visited]
        i, j, value = i[stay], j[stay], value[stay]
    if len(i):
        order = np.lexsort((j, value, i))
        first = np.ones(len(i), dtype=bool)
        first[1:] = i[order][1:] != i[order][:-1]
        i, j, value = i[order][first], j[order][first], value[order][first]
        better = value < best[i]
        best[i[better]], at[i[better]] = value[better], j[better] + k
    return work


def seeded_search(x: np.ndarray, seeds: np.ndarray, c: np.ndarray, ratios: np.ndarray, split: Split, partial: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """`search` from these seeds; a vector whose seed is -1 has none."""
    some = seeds >= 0
    if some.all() or not some.any():
        return search(x, seeds if some.all() else None, c, ratios, split, partial)
    at, best, count, total = np.empty(len(x), dtype=np.int64), np.empty(len(x)), np.empty(len(x), dtype=np.int64), 0
    for mine, told in ((some, seeds[some]), (~some, None)):
        at[mine], best[mine], count[mine], work = search(x[mine], told, c, ratios, split, partial)
        total += work
    return at, best, count, total


def seeds_of(column: pa.Array, k: int) -> np.ndarray:
    """Seeds as numbers; -1 for a null and for what is no centroid of k."""
    seeds = np.asarray(pc.fill_null(column, -1)).astype(np.int64)
    return np.where(seeds < k, seeds, -1)


def assign_pruned(df: DataFrame, c: np.ndarray, ratios: np.ndarray, split: Split, partial: int, previous: str | None = "prev_cid", fill: Callable | None = None, key: str | None = None, work: Accumulator | None = None) -> DataFrame:
    """(vec_id, cid, d2, not_pruned) from (vec_id, embedding), embeddings and centroids rotated, and the column of previous centroids if there is one. Narrow: no shuffle.

    Vectors whose previous centroid is null get one by `fill`, from their
    coordinates and the uniform number in the column `key`; without it their
    search starts from the least prefix. `work` adds up multiplications.
    """
    shared = df.sparkSession.sparkContext.broadcast((c, ratios, fill))

    def kernel(batches):
        m, r, missing = shared.value
        for batch in batches:
            x = matrix(batch.column(1), m.shape[1])
            for a in range(0, len(x), SLICE):
                some = x[a : a + SLICE]
                seeds = np.full(len(some), -1) if previous is None else seeds_of(batch.column(2).slice(a, len(some)), len(m))
                gap = np.flatnonzero(seeds < 0)
                if missing is not None and len(gap):
                    seeds[gap] = missing(some[gap], np.asarray(batch.column(3))[a : a + SLICE][gap])
                at, best, count, products = seeded_search(some, seeds, m, r, split, partial)
                if work is not None:
                    work.add(products)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(at)), pa.array(at.astype(np.int32)), pa.array(best), pa.array(count)], names=["vec_id", "cid", "d2", "not_pruned"])

    told = ["vec_id", "embedding", *([previous] if previous else []), *([key] if fill is not None else [])]
    return df.select(*told).mapInArrow(kernel, "vec_id long, cid int, d2 double, not_pruned long")
