"""Vectors stored in slabs of dimensions, so that a search reads later dimensions only of vectors that need them.

A row holds a vector's slabs in columns of their own, and the length of what
follows each slab. Over the dimensions read so far, a centroid's squared
distance lies between the part seen plus (a - b)^2 and that plus (a + b)^2, a
and b being the lengths of the two rests. A centroid whose least distance is
beyond another one's greatest is out; a vector with one centroid left is done.
Where vectors have been assigned before, the old distance and how far that
centroid has moved since bound the new distance from the start, before any
dimension is read. The others meet their next slab by vec_id, in tables of equal buckets: no
exchange, and of the vector table only two columns are read. Exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_BYTES, HORIZONTAL_BLOCK, require
from ..schema import vectors
from ..sources.storage import Store
from .distance import matrix

#: Distances held at once.
SEEN = 1 << 20
_LEFT = "vec_id long, bound double, cid int, cids array<int>, seen array<double>"


@dataclass
class Slabs:
    """`rows`: (vec_id, rests, s0, s1, ...), bucketed by vec_id; `edges`: where slabs begin and end."""

    rows: DataFrame
    edges: list[int]
    store: Store

    def release(self) -> None:
        self.store.release()


def write(df: DataFrame, d: int, width: int = HORIZONTAL_BLOCK) -> Slabs:
    """Store vectors of width d with unique ids; rotate them first where their lengths lie in few dimensions. Null ids take no part."""
    edges = [*range(0, d, width), d]
    n = len(edges) - 1
    v = F.col("embedding").cast("array<double>")
    square = F.transform(v, lambda x: x * x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rests = F.array(*[F.sqrt(total(F.slice(square, edges[j + 1] + 1, d))) for j in range(n - 1)], F.lit(0.0)).alias("rests")
    slabs = [F.slice(F.col("embedding"), edges[j] + 1, edges[j + 1] - edges[j]).alias(f"s{j}") for j in range(n)]
    rows = vectors(df).where("vec_id is not null")
    store = Store(df.sparkSession, rows.count(), d)
    return Slabs(store.bucketed(rows.select("vec_id", rests, *slabs), "slabs"), edges, store)


def assign(slabs: Slabs, c: np.ndarray, before: DataFrame | None = None, was: np.ndarray | None = None) -> tuple[DataFrame, list[int]]:
    """(vec_id, cid): nearest centroid of each stored vector, ties to the lowest id; and how many vectors each slab was read for.

    `before` are earlier assignments (vec_id, cid, d2), to the centroids `was`,
    which `c` numbers alike; vectors without one do without.

    A stage's undecided vectors are a stored table of their centroids left,
    with the distances so far.
    """
    require(len(c) > 0 and c.nbytes <= BROADCAST_BYTES, "too many centroids to broadcast, or none")
    require(c.shape[1] == slabs.edges[-1], f"centroids must have width {slabs.edges[-1]}")
    spark, store, n = slabs.rows.sparkSession, slabs.store, len(slabs.edges) - 1
    shared = spark.sparkContext.broadcast(c)
    rests = np.stack([np.sqrt((c[:, e:] ** 2).sum(axis=1)) for e in slabs.edges[1:]])
    rest_of = spark.sparkContext.broadcast(rests)
    done, read, left = [], [], None

    def stage(j: int, a: int, b: int, last: bool):
        def bounds(seen: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slack = 1e-9 * (1 + seen)
            return seen + (own - other) ** 2 - slack, seen + (own + other) ** 2 + slack

        def begin(batches):
            y, r = shared.value[:, a:b], rest_of.value[j]
            step = max(1, SEEN // len(y))
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    part = batch.slice(k, step)
                    x, bound = matrix(part.column(2), b - a), np.asarray(part.column(3))
                    seen = x @ (-2.0 * y.T) + (y * y).sum(axis=1) + (x * x).sum(axis=1)[:, None]
                    low, high = bounds(seen, matrix(part.column(1), n)[:, j : j + 1], r[None])
                    near = seen.argmin(axis=1) if last else None
                    some = low <= np.minimum(high.min(axis=1), bound)[:, None]
                    yield told(part.column(0), bound, some.sum(axis=1), *np.nonzero(some), seen[some], near)

        def go_on(batches):
            y, r = shared.value[:, a:b], rest_of.value[j]
            for batch in batches:
                x, own = matrix(batch.column(2), b - a), matrix(batch.column(1), n)[:, j]
                bound, count = np.asarray(batch.column(3)), np.asarray(batch.column(4).value_lengths())
                cids, seen = (np.asarray(batch.column(i).flatten()).copy() for i in (4, 5))
                of, cut = np.repeat(np.arange(len(x)), count), np.concatenate([[0], np.cumsum(count)[:-1]])
                for k in range(0, len(of), SEEN // 16):
                    s = slice(k, k + SEEN // 16)
                    seen[s] += ((x[of[s]] - y[cids[s]]) ** 2).sum(axis=1)
                low, high = bounds(seen, own[of], r[cids])
                some = low <= np.minimum(np.minimum.reduceat(high, cut), bound)[of]
                near = None
                if last:
                    order = np.lexsort((cids, seen, of))
                    near = cids[order[cut]]
                yield told(batch.column(0), bound, np.add.reduceat(some.astype(np.int64), cut), of[some], cids[some], seen[some], near)

        def told(ids, bound, count, of, cids, seen, near):
            """One centroid left, or at the last slab the nearest: cid; else what is left of them."""
            first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
            settled = np.ones(len(count), dtype=bool) if near is not None else count == 1
            cid = near if near is not None else cids[first] if len(cids) else np.zeros(0, dtype=np.int32)
            open_ = ~settled[of]
            ends = np.concatenate([[0], np.cumsum(np.where(settled, 0, count))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[open_], t)) for v, t in ((cids.astype(np.int32), pa.int32()), (seen, pa.float64()))]
            return pa.RecordBatch.from_arrays([ids, pa.array(bound), pa.array(np.asarray(cid).astype(np.int32), mask=~settled), *lists], names=["vec_id", "bound", "cid", "cids", "seen"])

        return go_on if j else begin

    bounds_of = None
    if before is not None:
        require(was is not None and was.shape == c.shape, "earlier assignments need their centroids")
        moved = spark.sparkContext.broadcast(np.sqrt(((c - was) ** 2).sum(axis=1)))

        def bound(batches):
            for batch in batches:
                at = np.sqrt(np.asarray(batch.column(2))) + moved.value[np.asarray(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at * at * (1 + 1e-9))], names=["vec_id", "bound"])

        told_before = before.where("vec_id is not null and cid is not null").select("vec_id", "cid", "d2")
        bounds_of = store.bucketed(told_before.mapInArrow(bound, "vec_id long, bound double"), "bounds")

    for j in range(n):
        source = slabs.rows.select("vec_id", "rests", f"s{j}")
        if left is not None:
            source = source.join(left.hint("shuffle_hash"), "vec_id").select("vec_id", "rests", f"s{j}", "bound", "cids", "seen")
        elif bounds_of is None:
            source = source.withColumn("bound", F.lit(float("inf")))
        else:
            source = source.join(bounds_of.hint("shuffle_hash"), "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = store.bucketed(source.mapInArrow(stage(j, slabs.edges[j], slabs.edges[j + 1], j == n - 1), _LEFT), "stage", dealt=True)
        read.append(found.count())
        done.append(found.where("cid is not null").select("vec_id", "cid"))
        left = found.where("cid is null").select("vec_id", "bound", "cids", "seen")
        if j < n - 1 and left.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, read
