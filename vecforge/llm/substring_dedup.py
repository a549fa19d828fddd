"""Removal of word windows that already start in an earlier document, with a count-min prefilter.

First pass: every task adds its documents' windows to sketch rows of saturating
counters (0, 1, 2 or more), one count per window and document. A window is
counted under its representative, the least hash among its inner runs of
`inner` words: equal windows have equal representatives, so merged counts
never fall short of a window's, and a text needs about a fifth of the updates.
Blocks of counters are merged by shuffle; the bitmap "2 or more" has a fixed
size. Second pass: only windows estimated as repeated are grouped, exactly, by
128-bit hash. Collisions in the sketch cost work, never a result. Documents
whose whole word sequence an earlier one has are settled before both passes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import dropped, few, lean, rounds, small_batches, table, without, written

WIDTH = 13
INNER = 6
#: Sketch rows of 2 ** LOG2_CELLS counters; the broadcast bitmap has ROWS * 2 ** LOG2_CELLS bits, 64 MB, at any input size.
ROWS, LOG2_CELLS = 2, 28
_BLOCK = 18  # log2 of the counters of one merged block
_SEED = 13
#: Windows that a task holds before it settles them, 32 bytes each.
TASK_WINDOWS = 2_000_000


def _representatives(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window start the least hash of its inner runs."""
    inner = min(INNER, width)
    runs = W.windows(hashes, inner, _SEED)
    span, out, have = width - inner + 1, runs, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _inside(found: W.Words, width: int) -> np.ndarray:
    """Window starts that lie within one text."""
    count = np.maximum(0, np.diff(found.offset) - width + 1)
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(found.offset[:-1] - first, count)


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << LOG2_CELLS) - 1)
    return [(keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)][:ROWS]


def _sketch(docs: DataFrame, doc_id: str, text: str, width: int) -> np.ndarray | None:
    """Bitmaps of the counters that reached 2, by sketch row; None without windows."""

    def packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
        return zlib.compress(np.concatenate([[len(cells)], np.diff(cells, prepend=0), np.diff(twice, prepend=0)]).astype("<u4").tobytes(), 1)

    def emit(held: list[list[np.ndarray]]):
        for row, parts in enumerate(held):
            if not parts:
                continue
            cells, count = np.unique(np.concatenate(parts), return_counts=True)
            block = cells >> _BLOCK
            bounds = np.searchsorted(block, np.arange((1 << (LOG2_CELLS - _BLOCK)) + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                mine = slice(bounds[k], bounds[k + 1])
                low = cells[mine] & ((1 << _BLOCK) - 1)
                yield row << 16 | k, packed(low, low[count[mine] > 1])

    def add(batches):
        held, n = [[] for _ in range(ROWS)], 0
        for batch in batches:
            for a, b in rounds(batch.column(0), W.ROUND_BYTES):
                found = W.find(batch.column(0).slice(a, b - a))
                at = _inside(found, width)
                if not len(at):
                    continue
                keys, doc = _representatives(found.hashes(), width)[at], found.of_word()[at]
                new = np.ones(len(keys), dtype=bool)  # equal representatives side by side are one
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                keys, doc = keys[new], doc[new]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                new = np.ones(len(keys), dtype=bool)  # one count a document
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                for parts, cells in zip(held, _cells(keys[new]), strict=True):
                    parts.append(cells)
                n += int(new.sum())
            if n > 4_000_000:
                yield from batched(emit(held))
                held, n = [[] for _ in range(ROWS)], 0
        yield from batched(emit(held))

    def batched(pairs):
        pairs = list(pairs)
        for k in range(0, len(pairs), 256):
            yield table(["block", "cells"], [list(x) for x in zip(*pairs[k : k + 256], strict=True)], [pa.int32(), pa.binary()])

    def merge(key, pdf):
        one, two = np.zeros(1 << _BLOCK, dtype=bool), np.zeros(1 << _BLOCK, dtype=bool)
        for raw in pdf["cells"]:
            x = np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.int64)
            cells, twice = np.cumsum(x[1 : 1 + x[0]]), np.cumsum(x[1 + x[0] :])
            two[cells[one[cells]]] = True
            two[twice] = True
            one[cells] = True
        return pdf.iloc[:1].assign(cells=[np.packbits(two, bitorder="little").tobytes()])[["block", "cells"]]

    parts = docs.select(F.col(text).alias("text")).mapInArrow(lean(add), "block int, cells binary")
    merged = written(parts.groupBy("block").applyInPandas(merge, "block int, cells binary"), "sketch")
    maps = None
    for r in merged.toLocalIterator():  # ROWS * 2 ** (LOG2_CELLS - 18) blocks of 32 KB at most
        if maps is None:
            maps = np.zeros((ROWS, 1 << (LOG2_CELLS - 3)), dtype=np.uint8)
        k = (r.block & 0xFFFF) << (_BLOCK - 3)
        maps[r.block >> 16, k : k + (1 << (_BLOCK - 3))] = np.frombuffer(r.cells, dtype=np.uint8)
    dropped(merged)
    return maps


def _copies(docs: DataFrame, width: int) -> DataFrame:
    """Documents of `width` words or more whose whole word sequence an earlier document has: all their windows go, and no other document needs theirs."""

    def sequence(batches):
        names, types = ["doc_id", "variant", "n", "s1", "s2"], [pa.int64()] * 5
        for batch in batches:
            for a, b in rounds(batch.column(1), W.ROUND_BYTES):
                found = W.find(batch.column(1).slice(a, b - a))
                count = np.diff(found.offset)
                place = (np.arange(len(found)) - np.repeat(found.offset[:-1], count)).astype(np.uint64)
                some = np.flatnonzero(count >= width)
                if not len(some):
                    continue
                salted = [W.mix(found.hashes(k) + place * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1)]
                sums = [_sums(x, found.offset, some) for x in salted]
                yield table(names, [np.asarray(batch.column(0))[a:b][some], np.asarray(batch.column(2))[a:b][some], count[some], *(x.view(np.int64) for x in sums)], types)

    rows = written(docs.mapInArrow(lean(sequence), "doc_id long, variant long, n long, s1 long, s2 long"), "sequences")
    first = rows.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = written(first.drop("last"), "first")  # one row a group of copies
    found = written(rows.join(few(first), ["n", "s1", "s2"]).where("doc_id > first").select("doc_id", "variant").distinct(), "copies")
    dropped(rows, first)
    return found


def _sums(values: np.ndarray, offset: np.ndarray, some: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offset[some + 1]] - total[offset[some]]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    variant = F.xxhash64(docs[text]).bitwiseAND(F.lit((1 << 32) - 1))
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), variant.alias("variant"))


def removed_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, variant, starts): where, counted in words, a row's removed windows start; only rows with some. All of a row goes: [-1].

    A window is removed when its word sequence also starts in a row with a
    smaller id. Rows with a null id and null texts have no windows. Rows
    repeated under one id are judged one by one and never against each other;
    `variant`, 32 bits of a hash of the text, tells an id's texts apart (two
    texts of one id are confused with probability 2 ** -32). Of equal windows a
    task meets, it settles all but the earliest document's itself and shuffles
    only that one, so the most frequent window has no more rows than there are
    tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = _rows(docs, doc_id, text).where("doc_id is not null and text is not null")
    copies = _copies(source, width)
    all_gone = copies.select("doc_id", "variant", F.array(F.lit(-1)).alias("starts"))
    source = without(source, copies, ["doc_id", "variant"]).select("doc_id", "text", "variant")
    maps = _sketch(source, "doc_id", "text", width)
    if maps is None or not maps.any():
        return all_gone
    shared = spark.sparkContext.broadcast(maps)
    names, types = ["h1", "h2", "doc_id", "at", "starts"], [pa.int64(), pa.int64(), pa.int64(), pa.int64()]  # at: variant, then the start in 32 bits

    def settle(held):
        """A row for each window of its earliest document here; the others' starts, already settled, one row a document without hashes."""
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        later = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        d, w = doc[later], at[later]
        order = np.lexsort((w, d))
        d, w = d[order], w[order]
        v, w = w >> 32, w.astype(np.int32)
        cut = np.concatenate([[0], np.flatnonzero((np.diff(d) != 0) | (np.diff(v) != 0)) + 1, [len(d)]]) if len(d) else np.zeros(1, dtype=np.int64)
        for k in range(0, len(cut) - 1, 2000):
            bounds = cut[k : k + 2001]
            starts = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(w[bounds[0] : bounds[-1]]))
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in types[:2]] + [pa.array(d[bounds[:-1]]), pa.array(v[bounds[:-1]] << 32), starts], names=names)
        h1, h2, doc, at = (x[~later] for x in (h1, h2, doc, at))
        for k in range(0, len(h1), 100_000):
            s = slice(k, k + 100_000)
            n = len(h1[s])
            yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(doc[s]), pa.array(at[s]), pa.nulls(n, pa.list_(pa.int32()))], names=names)

    def estimated(batches):
        bits, held, n = shared.value, [], 0
        for batch in batches:
            ids, variants = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for a, b in rounds(batch.column(1), W.ROUND_BYTES):
                found = W.find(batch.column(1).slice(a, b - a))
                at = _inside(found, width)
                if not len(at):
                    continue
                one = found.hashes()
                keys = _representatives(one, width)[at]
                hit = np.ones(len(at), dtype=bool)
                for row, cells in enumerate(_cells(keys)):
                    hit &= (bits[row, cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                at = at[hit]
                if len(at):
                    doc = found.of_word()[at]
                    held.append((W.windows(one, width, 1)[at], W.windows(found.hashes(1), width, 2)[at], ids[a:b][doc], variants[a:b][doc] << 32 | at - found.offset[doc]))
                    n += len(at)
            if n > TASK_WINDOWS:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    found = source.mapInArrow(lean(estimated), "h1 long, h2 long, doc_id long, at long, starts array<int>")
    earliest = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    # Settled rows get a key of their own, which keeps them spread and out of every window's group.
    keyed = found.withColumn("h2", F.coalesce("h2", F.xxhash64("doc_id", "at"))).withColumn("first", earliest)
    hits = keyed.where(F.col("h1").isNull() | (F.col("doc_id") > F.col("first")))
    own = F.when(F.col("starts").isNull(), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    starts = F.array_distinct(F.concat(F.collect_list(own), F.flatten(F.collect_list("starts"))))
    return hits.groupBy("doc_id", F.shiftrightunsigned("at", 32).alias("variant")).agg(starts.alias("starts")).unionByName(all_gone)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Each row's words and what is left of them: (doc_id, n_words, n_removed, kept), kept being the words joined by one space.

    Windows are judged on the input. Null texts have no words; rows with a null
    id keep all of theirs; empty tables give no rows.
    """
    starts = removed_words(docs, doc_id, text, width)
    rows = _rows(docs, doc_id, text).join(starts, ["doc_id", "variant"], "left").select("doc_id", "text", "starts")

    def cut(batches):
        names, types = ["doc_id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text_, starts_ in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text_ or "").translate(_TO_SPACE).split(" ")
                words = [w for w in words if w]
                gone = 0
                if starts_.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    s = np.asarray(starts_.values)
                    if s[0] < 0:
                        edge[0] = 1
                    else:
                        edge[s] += 1
                        edge[s + width] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(" ".join(words))
            yield table(names, [batch.column(0), n_words, n_removed, kept], types)

    return rows.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept string")


_TO_SPACE = {c: " " for c in (9, 10, 11, 12, 13)}
