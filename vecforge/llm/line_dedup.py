"""Lines that several documents share, found by a range-partitioned sort and told as keep bitmaps.

Every line becomes a row of its key's 128-bit hash, its document and its place.
The rows are range-partitioned and sorted by (hash, document, place), so a
task streams over the lines of one key in the order of their documents and
meets first occurrences first. As the ranges are cut on the whole sort key, a
very common line is spread over as many tasks as its rows need. A task looks
at CHUNK rows at a time; what a chunk cannot decide about its first and its
last key it gives back with counts of their documents, and those counts, two a
chunk, settle the rest. Documents get back a compressed bitmap of the lines to
keep; texts are read again where they lie and meet only their own bitmaps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import dropped, few, lean, rounds, small_batches, table, written

#: Bytes of bitmaps up to which they are broadcast instead of joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of lines that a task looks at together, some 40 bytes each.
CHUNK = 100_000
#: Documents a task remembers, so that repeats of one row under one id are hashed once.
SEEN = 100_000

_KEY = ["h1", "h2", "doc_id", "variant", "line"]
_LINES = "h1 long, h2 long, doc_id long, variant long, line int"
_FOUND = f"{_LINES}, docs long, last long"
_TYPES = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2


def split(texts: pa.Array) -> tuple[np.ndarray, W.Words]:
    """Number of lines of each text, and the keys of all lines: bounds without white space at either end, A-Z lowered; an empty key has equal bounds.

    A null or empty text is one empty line.
    """
    data, bounds = W.buffers(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, bounds)) + 1
    start, end = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
    solid = np.flatnonzero(~W.SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = a < b
    start, end = start.copy(), end.copy()
    start[some], end[some] = solid[a[some]], solid[b[some] - 1] + 1
    end[~some] = start[~some]
    return count, W.Words(data, start, end, np.concatenate([[0], np.cumsum(count)]))


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has min_chars code points: the key's hashes, then the document and the line's place in it."""

    def hashed(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, variants = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            new = []
            for i, at in enumerate(zip(ids.tolist(), variants.tolist(), strict=True)):
                if at not in seen:
                    seen.add(at)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            texts, ids, variants = batch.column(1).take(pa.array(new, pa.int64())), ids[new], variants[new]
            for a, b in rounds(texts, W.ROUND_BYTES):
                count, found = split(texts.slice(a, b - a))
                chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                some = np.flatnonzero((found.end > found.start) & (chars[found.end] - chars[found.start] >= min_chars))
                if not len(some):
                    continue
                doc = np.repeat(np.arange(b - a), count)[some]
                keys = W.Words(found.data, found.start[some], found.end[some], np.array([0, len(some)]))
                columns = [keys.hashes(0).view(np.int64), keys.hashes(1).view(np.int64), ids[a:b][doc], variants[a:b][doc], (some - found.offset[doc]).astype(np.int32)]
                for k in range(0, len(some), CHUNK):
                    yield table(_KEY, [x[k : k + CHUNK] for x in columns], _TYPES[:5])

    return docs.mapInArrow(lean(hashed), _LINES)


def decided(rows: list[np.ndarray], least: int, keep_first: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """What one chunk of sorted line rows (hashes, document, variant, line) tells: lines that go, open lines, and counts.

    A key inside the chunk is decided. Its first and its last key may go on in
    the chunks beside it: their lines go if this chunk alone has documents
    enough, else they are open; and each gives a count: its first row, how many
    documents and the last of them. Rows repeated under one id are one.
    """
    differs = lambda upto: np.any([np.diff(x) != 0 for x in rows[:upto]], axis=0)
    if not len(rows[0]):
        return rows, rows, [*rows, rows[2], rows[2]]
    new = np.append(True, differs(5))
    rows = [x[new] for x in rows]
    begins = np.append(True, differs(2))
    fresh = np.append(True, differs(3))
    at, run = np.flatnonzero(begins), np.cumsum(begins) - 1
    docs = np.add.reduceat(fresh.astype(np.int64), at)
    edge = np.zeros(len(at), dtype=bool)
    edge[[0, -1]] = True
    goes = (docs >= least)[run]
    if keep_first:
        goes &= ~begins
    ends = np.append(at[1:], len(run)) - 1
    return [x[goes] for x in rows[2:]], [x[edge[run] & ~goes] for x in rows], [*(x[at[edge]] for x in rows), docs[edge], rows[2][ends[edge]]]


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_documents: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """(doc_id, variant, line) of every line that goes, lines counted from 0; some may be told twice.

    A key goes if min_documents documents have it; with `keep_first` its first
    occurrence, by document and line, stays. Rows that share an id are one
    document, and `variant`, a 64-bit hash of the text, tells an id's texts
    apart. Rows with a null id have no place in the order: they neither count
    nor lose lines. Keys of less than min_chars code points stay.
    """
    if min_documents < 1 or min_chars < 1:
        raise ValueError("min_documents and min_chars must be at least 1")
    small_batches(docs.sparkSession)
    rows = written(_keys(_rows(docs, doc_id, text).where("doc_id is not null"), min_chars), "lines")

    def stream(batches):
        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            n += batch.num_rows
            if n >= CHUNK:
                yield from told(held)
                held, n = [], 0
        if held:
            yield from told(held)

    def told(held):
        gone, still, counts = decided([np.concatenate(x) for x in zip(*held, strict=True)], min_documents, keep_first)
        for columns, missing in ((gone, (2, 2)), (still, (0, 2)), (counts, (0, 0))):
            n = len(columns[0])
            none = [[pa.nulls(n, pa.int64())] * k for k in missing]
            batch = table([*_KEY, "docs", "last"], [*none[0], *columns, *none[1]], _TYPES)
            for k in range(0, n, 10_000):
                yield batch.slice(k, 10_000)

    found = rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(lean(stream), _FOUND)
    found = written(found, "found")
    dropped(rows)
    counts = found.where("docs is not null")
    place = Window.partitionBy("h1", "h2").orderBy("doc_id", "variant", "line", "last")
    shared = F.coalesce(F.lag("last").over(place) == F.col("doc_id"), F.lit(False)).cast("long")
    of_key = counts.withColumn("own", F.col("docs") - shared).groupBy("h1", "h2").agg(F.sum("own").alias("n"), F.min(F.struct("doc_id", "variant", "line")).alias("at"))
    verdicts = written(of_key.where(F.col("n") >= min_documents).select("h1", "h2", "at"), "verdicts")  # two rows a chunk at most
    still = found.where("h1 is not null and docs is null").join(few(verdicts), ["h1", "h2"])
    if keep_first:
        still = still.where(F.struct("doc_id", "variant", "line") != F.col("at"))
    where = ["doc_id", "variant", "line"]
    return found.where("h1 is null").select(where).unionByName(still.select(where))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_documents: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """(doc_id, variant, keep): for each document that loses lines a compressed bitmap, a set bit for each line that stays, lowest bit first; lines beyond its end stay."""

    def packed(batches):
        for batch in batches:
            keep = []
            for lines in batch.column(2):
                at = np.asarray(lines.values)
                bits = np.ones(int(at.max()) + 1, dtype=bool)
                bits[at] = False
                keep.append(zlib.compress(np.packbits(np.append(bits, np.ones(-len(bits) % 8, dtype=bool)), bitorder="little").tobytes()))
            yield table(["doc_id", "variant", "keep"], [batch.column(0), batch.column(1), keep], [pa.int64(), pa.int64(), pa.binary()])

    gone = repeated_lines(docs, doc_id, text, min_documents, keep_first, min_chars)
    return gone.groupBy("doc_id", "variant").agg(F.collect_list("line").alias("lines")).mapInArrow(lean(packed), "doc_id long, variant long, keep binary")


def unpacked(keep: bytes, n: int) -> np.ndarray:
    """Which of a document's n lines stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little").astype(bool)[:n]
    return np.append(bits, np.ones(n - len(bits), dtype=bool))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    told = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), told.alias("text"), F.xxhash64(told).alias("variant"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_documents: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """Each row's lines and what is left of them: (doc_id, n_lines, n_dropped, kept), kept being the lines joined by \\n.

    Lines are judged on the input. A null or empty text is one empty line. Rows
    with a null id keep all lines; rows repeated under one id each lose the
    same lines; empty tables give no rows. Other columns are not read.
    """
    bitmaps = written(keep_bitmaps(docs, doc_id, text, min_documents, keep_first, min_chars), "bitmaps")
    size = bitmaps.agg(F.sum(F.length("keep") + 32)).first()[0] or 0
    known = F.broadcast(bitmaps) if size <= BROADCAST_BYTES else bitmaps
    rows = _rows(docs, doc_id, text).join(known, ["doc_id", "variant"], "left").select("doc_id", "text", "keep")

    def cut(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for told, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if keep is None:
                    n, gone = told.count("\n") + 1, 0
                else:
                    lines = told.split("\n")
                    stay = unpacked(keep, n := len(lines))
                    gone = n - int(stay.sum())
                    told = "\n".join([lines[i] for i in np.flatnonzero(stay)])
                n_lines.append(n)
                n_dropped.append(gone)
                kept.append(told)
            yield table(["doc_id", "n_lines", "n_dropped", "kept"], [batch.column(0), n_lines, n_dropped, kept], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return rows.mapInArrow(lean(cut), "doc_id long, n_lines long, n_dropped long, kept string")
