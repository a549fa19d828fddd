"""Best-fit packing with certified bin counts.

Each task encodes its documents, cuts only those longer than a sequence, and
packs its pieces by best-fit decreasing. Dual feasible functions give a lower
bound on the bins that its pieces need; a task whose bins equal the bound is
certified; it gives up only its least filled bin, as bounds of tasks round up.
Tasks with a gap give up `GIVEN_BINS` bins. The documents given up by `GROUP`
tasks are packed again, kept only if that saves bins, and so on until one group
is left. A group, too, gives up `GIVEN_BINS` bins at most, whether it saved any
or not, so no group ever holds more than some `GROUP * GIVEN_BINS` bins.
Pieces move without their ids, about 80 bytes each, and only those given up.

Where rows have an order (a mix's), sequences have it too: a sequence stands
where the document of its first and longest piece stands, so what reads
sequences by ascending number meets documents in that order.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, written
from .tokenize import encoder

CAPACITY = 2048
#: Bins that a task with a gap gives up, and tasks that exchange with each other.
GIVEN_BINS, GROUP = 32, 32
#: Pieces that a task packs at once.
TASK_PIECES = 500_000
#: Pieces of one document have so many numbers; the order of documents lies above them.
DOC_PIECES = 1 << 20
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "spot"]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, spot long, part long, bin long, offset long, lead long, given boolean"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that these lengths need at least, by two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass, many = np.cumsum(count * x), np.cumsum(count)
    best = -(-int(mass[-1]) // capacity)
    eps = np.arange(1, capacity // 2 + 1)  # long pieces count as a whole bin, short ones not at all
    whole = (many[-1] - many[capacity - eps]) * capacity + mass[capacity - eps] - mass[eps - 1]
    best = max(best, -(-int(whole.max()) // capacity))
    for k in range(1, 101):  # pieces rounded down to k-ths of a bin
        value = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and place in it, and the bins' fill. Linear in the pieces."""
    order = np.argsort(-lengths, kind="stable")
    bins, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fill = 0, []  # bit r is set while a bin has r tokens of room
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], at[i] = b, fill[b]
        fill[b] += n
        left = r - n
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, at, np.array(fill, dtype=np.int64)


def _packed(pieces: pd.DataFrame, part: int, last: bool = False) -> pd.DataFrame:
    """Pack these pieces as part `part` and mark what it gives up."""
    lengths = pieces["length"].to_numpy()
    bins, at, fill = best_fit(lengths)
    gap = len(fill) - lower_bound(lengths)
    given = np.zeros(len(fill), dtype=bool)
    if not last:
        given[np.argsort(fill, kind="stable")[: GIVEN_BINS if gap > 0 else 1]] = True
        given &= fill < CAPACITY
    lead = np.zeros(len(fill), dtype=np.int64)
    lead[bins[at == 0]] = pieces["spot"].to_numpy()[at == 0]
    return pieces.assign(part=part, bin=bins, offset=at, lead=lead[bins], given=given[bins])[[x.split()[0] for x in _SCHEMA.split(", ")]]


def _first(docs: DataFrame, tokenizer: str, doc_id: str, text: str, order: Column | None) -> DataFrame:
    def pack(batches) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        rows = [array("q") for _ in range(7)]  # _PIECE, and 1 where the id is null
        flushed = 0

        def flush():
            pieces = pd.DataFrame(dict(zip(_PIECE, (np.array(x, dtype=np.int64) for x in rows), strict=False)))
            pieces["doc_id"] = pd.arrays.IntegerArray(pieces["doc_id"].to_numpy(), np.array(rows[6], dtype=bool))
            for x in rows:
                del x[:]
            return pa.RecordBatch.from_pandas(_packed(pieces, flushed << 24 | task), schema=arrow, preserve_index=False)

        for batch in batches:
            texts, spots = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k in range(0, len(texts), 500):
                for i, spot, ids in zip(batch.column(0)[k : k + 500].to_pylist(), spots[k : k + 500], enc.encode(texts[k : k + 500]), strict=True):
                    ids += b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                        cut = ids[at : at + 4 * CAPACITY]
                        for column, x in zip(rows, (i or 0, p, at // 4, len(cut) // 4, zlib.crc32(cut), spot * DOC_PIECES + p, i is None), strict=True):
                            column.append(x)
                if len(rows[0]) >= TASK_PIECES:
                    yield flush()
                    flushed += 1
        if rows[0]:
            yield flush()

    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "spot", "part", "bin", "offset", "lead")), ("given", pa.bool_())])
    spot = F.lit(0) if order is None else order
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), spot.cast("long").alias("spot")).mapInArrow(lean(pack), _SCHEMA)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", order: Column | None = None) -> DataFrame:
    """Pieces and their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece of the end id alone. Null ids and repeated
    rows are packed like others; an empty table gives no rows. Pieces of one
    task's documents share sequences. With `order`, a number from 0 to 2^43 - 1
    of each row that no other row has, sequences are numbered in the order of
    the documents of their first pieces; without it, in any.
    """

    def again(level: int, last: bool):
        def repack(key, pdf: pd.DataFrame) -> pd.DataFrame:
            new = _packed(pdf.astype({"doc_id": "Int64"}), level << 40 | int(key[0]), last)
            if new["bin"].nunique() < len(pdf[["part", "bin"]].drop_duplicates()):
                return new
            old = pdf.sort_values(["part", "bin", "offset"], kind="stable")
            number = old.groupby(["part", "bin"], sort=False).ngroup()
            # No bin saved: as they were; the least filled are given once more, as a wider group may do better.
            fill = np.bincount(number, weights=old["length"])
            given = np.zeros(len(fill), dtype=bool)
            if not last:
                given[np.argsort(fill, kind="stable")[:GIVEN_BINS]] = True
            return old.assign(part=level << 40 | int(key[0]), bin=number, given=given[number])[list(new.columns)]

        return repack

    small_batches(docs.sparkSession)
    rows = written(_first(docs, tokenizer, doc_id, text, order), "packed")
    done, level = rows.where("not given"), 1
    left = rows.where("given")
    parts = left.select("part").distinct().count()
    while parts > 1:
        groups = -(-parts // GROUP)
        dealt = left.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)) if groups > 1 else F.lit(0))
        rows = written(dealt.groupBy("g").applyInPandas(again(level, groups == 1), _SCHEMA), "repacked")
        done, left = done.unionByName(rows.where("not given")), rows.where("given")
        parts, level = (left.select("part").distinct().count() if groups > 1 else 0), level + 1
    if parts == 1:
        done = done.unionByName(left)
    number = F.col("part") * F.lit(1 << 20) + F.col("bin") if order is None else F.col("lead")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
