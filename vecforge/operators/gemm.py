"""Matrix products of vector tables: a table (vec_id, embedding) is a matrix whose rows are its vectors.

With one side of a checked size the other one streams past it in blocks; two
large matrices are dealt into tiles, multiplied tile by tile and added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_BYTES, require
from .distance import matrix


#: Rows of a block of a matrix, and columns of a tile.
TILE_ROWS, TILE_COLUMNS = 4096, 1024
_ENTRY = "i long, j long, value double"


def _held(df: DataFrame, columns: int | None) -> DataFrame:
    """(id, v): rows with an id, cut to the columns that count."""
    v = F.col("embedding") if columns is None else F.slice("embedding", 1, columns)
    return df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _parts(df: DataFrame) -> int:
    """Blocks of rows; small tables use all cores, too."""
    return max(-(-df.count() // TILE_ROWS), min(8, df.sparkSession.sparkContext.defaultParallelism))


def _dense(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of one part; all rows of a part have one width."""
    column = rows["v"].combine_chunks()
    width = len(column.flatten()) // max(1, len(column))
    return np.asarray(rows["id"].combine_chunks()), matrix(column, width)


def _entries_of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.repeat(rows, len(columns))), pa.array(np.tile(columns, len(rows))), pa.array(values.ravel())], names=["i", "j", "value"])


_NONE = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["i", "j", "value"])


def product(a: DataFrame, b: DataFrame, trans_a: bool = False, trans_b: bool = False, columns_a: int | None = None, columns_b: int | None = None) -> DataFrame:
    """(i, j, value) of op(A) op(B) for two large matrices, both dealt into tiles that tasks multiply as arrays.

    The rows of a matrix are its vectors; only their first `columns_a` or
    `columns_b` entries count. A row index is a vec_id, a column index counts
    from 0; rows with a null id take no part, and repeated ids add up. Neither side is
    broadcast, and no entry becomes a row before tiles are multiplied.
    """
    if trans_a and trans_b:
        out = product(b, a, columns_a=columns_b, columns_b=columns_a)
        return out.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    left, right = _held(a, columns_a), _held(b, columns_b)
    if trans_a:
        return _rows_meet(left, right)
    return _pairs_meet(left, right) if trans_b else _tiles_meet(left, right)


def _summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _rows_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """A^T B: rows of one id meet in a block of ids, each block gives one product, summed in its task before the tasks' sums shuffle."""

    def by_id(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, x = _dense(rows)
        ids, at = np.unique(ids, return_inverse=True)
        out = np.zeros((len(ids), x.shape[1]))
        np.add.at(out, at, x)
        return ids, out

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        (l_ids, x), (r_ids, y) = by_id(left), by_id(right)
        _, at, to = np.intersect1d(l_ids, r_ids, assume_unique=True, return_indices=True)
        return _entries_of(np.arange(x.shape[1]), np.arange(y.shape[1]), x[at].T @ y[to]) if len(at) else _NONE

    n = max(_parts(a), _parts(b))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")
    return _summed(a.select("id", "v", block).groupBy("block").cogroup(b.select("id", "v", block).groupBy("block")).applyInArrow(meet, _ENTRY))


def _pairs_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B^T: each block of rows of A meets each of B; every entry is made once (repeated ids add up)."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        (i, x), (j, y) = _dense(left), _dense(right)
        return _entries_of(i, j, x @ y.T)

    n, m = _parts(a), max(1, -(-b.count() // TILE_ROWS))
    own = lambda k, name: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias(name)
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left, right = a.select("id", "v", own(n, "ib"), every(m, "jb")), b.select("id", "v", own(m, "jb"), every(n, "ib"))
    return left.groupBy("ib", "jb").cogroup(right.groupBy("ib", "jb")).applyInArrow(meet, _ENTRY)


def _tiles_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B: A's columns are B's row ids. Tiles (rows of A, inner index, columns of B) are multiplied, and the inner tiles of an entry added up."""
    tile = TILE_COLUMNS

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        (i, x), (k, y) = _dense(left), _dense(right)
        at, first = k % tile, right["jb"][0].as_py() * tile
        some = at < x.shape[1]
        return _entries_of(i, first + np.arange(y.shape[1]), x[:, at[some]] @ y[some])

    n = _parts(a)
    sizes = [df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (a, b)]
    inner, columns = (max(1, -(-s // tile)) for s in sizes)
    cut = lambda at: F.slice("v", at * tile + 1, tile).alias("v")
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left = a.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("ib"), every(inner, "kb"))
    left = left.select("id", cut(F.col("kb")), "ib", "kb", every(columns, "jb"))
    right = b.where(F.col("id").between(0, sizes[0] - 1)).select("id", "v", F.floor(F.col("id") / tile).cast("int").alias("kb"), every(columns, "jb"))
    right = right.select("id", cut(F.col("jb")), "kb", "jb", every(n, "ib"))
    key = ["ib", "kb", "jb"]
    return _summed(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, _ENTRY))


def rows_times(a: DataFrame, b: np.ndarray, trans_b: bool = False, columns: int | None = None) -> DataFrame:
    """(vec_id, product): each row of A times op(B), over A's first `columns`. B is held by every task; A does not shuffle."""
    require(b.nbytes <= BROADCAST_BYTES, "the second matrix is too large to broadcast; use product")
    m = b.T if trans_b else b
    require(columns is None or columns == len(m), "inner dimensions differ")
    shared = a.sparkSession.sparkContext.broadcast(np.ascontiguousarray(m))

    def kernel(batches):
        m = shared.value
        for batch in batches:
            width = len(m) if columns is None or not batch.num_rows else len(batch.column(1)[0])
            x = matrix(batch.column(1), width)[:, : len(m)]
            arrays = pa.FixedSizeListArray.from_arrays(pa.array((x @ m).ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["vec_id", "product"])

    return a.select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, product array<double>")


def gram_of_dims(df: DataFrame, d: int) -> DataFrame:
    """(i, j, value): X^T X of all rows by dimension. Each task sums its rows' products; d * d rows a task shuffle."""

    def kernel(batches):
        out = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(1), d)
            out += x.T @ x
        at = np.arange(d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, d)), pa.array(np.tile(at, d)), pa.array(out.ravel())], names=["i", "j", "value"])

    parts = df.select("vec_id", "embedding").mapInArrow(kernel, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))
