"""Mixing sources to target weights by Pfair scheduling.

Weights are taken as exact fractions w of their sum. Block i of a source of
weight w is released at floor(i / w) and due at ceil((i + 1) / w); at each time
slot the released block with the earliest deadline runs. As the weights sum to
one, no deadline is missed, so after every slot each source is less than one
block from its target, until a source has no blocks left (`targets_hold` tells
the slot); the others then go on at their own slots, the ended source's stay
empty, and the order among the others keeps their weights to each other.

The driver computes every block's slot, one step a block (of 64 rows, say), and
writes them out in parts; it holds the sources' weights and counts, and no
rows. Every row gets exactly one place: none is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, lcm

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, few, new_path, written

PERIOD = 4096
#: Rows of a source are numbered by this many hash ranges at once.
RANGES = 1024
#: Blocks that the driver holds at once.
PART_BLOCKS = 200_000
#: Slots from here on belong to blocks without a weight.
LATE = 1 << 62


def ticks(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole ticks that sum to `period`, by largest remainders, one at least."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0 or len(weights) > period:
        raise ValueError("weights must be non-negative, not all 0, and no more than the period's ticks")
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], _named(s)))
    k = 0
    while (left := period - sum(out.values())) != 0:
        s = order[k % len(order)] if left > 0 else max(out, key=lambda s: (out[s], _named(s)))
        out[s] += 1 if left > 0 else -1
        k += 1
    return out


def _named(source: str | None) -> str:
    """A source's name here: a null source is one of its own, apart from any that has a name."""
    return "" if source is None else f"={source}"


def slots(weights: dict[str | None, float], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, release, slot, deadline) of every block, by slot: earliest deadline first among the released.

    Exact at any number of sources and any skew. Sources of weight 0 have no slots.
    """
    if not weights or min(weights.values()) < 0 or max(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and not all 0")
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    unit = lcm(*(x.denominator for x in exact.values()))
    whole = {s: x.numerator * (unit // x.denominator) for s, x in exact.items()}
    total = sum(whole.values())
    names = sorted((s for s in whole if blocks.get(s, 0) > 0), key=_named)
    share, left = [whole[s] for s in names], [blocks[s] for s in names]
    if any(-(-n * total // q) >= LATE for n, q in zip(left, share, strict=True)):
        raise ValueError("a weight is too small: its source's slots go beyond 2^62")
    waiting = [(0, s, 0) for s in range(len(names))]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // share[s]), s, i, release))
        due, s, i, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        yield names[s], i, release, slot, due
        if i + 1 < left[s]:
            heapq.heappush(waiting, ((i + 1) * total // share[s], s, i + 1))
        slot += 1


def targets_hold(weights: dict[str | None, float], blocks: dict[str | None, int]) -> int:
    """The first slot before which every weighted source's share is within one block of its target: there the first of them has no blocks left."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    total = sum(exact.values())
    return min(ceil(blocks.get(s, 0) * total / w) for s, w in exact.items())


def one_period(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the period, slot) of one period of whole ticks."""
    return [(s, i, slot) for s, i, _, slot, _ in slots(shares, shares)]


def schedule(docs: DataFrame, weights: dict[str, float], block_rows: int = 64, source: str = "source", doc_id: str = "doc_id", period: int | None = None) -> DataFrame:
    """Every row's place in the mix: (doc_id, source, block, release, slot, deadline, place).

    `place` orders a block's rows; (slot, place) is the mix's order. Rows of a
    source follow a hash of their ids, rows without an id one of where they were
    read, so that many of them are no hot range. A null source is a source of its own, the
    weight of None, and not the one named ''; sources without a weight or of weight 0 come after all weighted
    ones, block by block in turn, so that nothing is lost. Null ids and repeated
    rows have places like others; empty tables give no rows. Weights are exact;
    only if a `period` is given are they rounded to its ticks.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), _source_name(docs[source]).alias("source"))
    rows = written(_ordered(rows), "mix")
    out = _scheduled(rows, weights, block_rows, period)
    source_ = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source")
    return out.select("doc_id", source_, F.col("block").cast("long").alias("block"), "release", "slot", "deadline", F.col("place").cast("long").alias("place"))


def _source_name(source: Column) -> Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with the order within their source and its range. Those without an id follow where they were read: such rows have to be written before they are numbered."""
    order = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(4), F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit(3), F.col("doc_id")))
    return rows.withColumn("order", order).withColumn("range", F.pmod(F.col("order"), F.lit(RANGES)).cast("int"))


def _scheduled(rows: DataFrame, weights: dict[str | None, float], block_rows: int, period: int | None) -> DataFrame:
    """Rows (doc_id, source, order, range and any others) with block, release, slot, deadline and place."""
    weights = weights or {None: 1.0}  # of an empty table
    counts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.withColumn("start", before).select("source", "range", "start", "n"), "starts")
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy("order", "doc_id")) - 1
    # Sources times RANGES rows: broadcast while sources are as few as weights, joined otherwise.
    placed = rows.withColumn("k", place).join(few(starts).drop("n"), ["source", "range"])
    placed = placed.withColumn("at", F.col("start") + F.col("k"))
    rows_of = {r.source[1:] if r.source else None: r.n for r in starts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    told = slots(weights if period is None else ticks(weights, period), {s: -(-n // block_rows) for s, n in rows_of.items()})
    table, small = _slot_table(rows.sparkSession, told)
    blocks = placed.withColumn("block", F.floor(F.col("at") / block_rows)).withColumn("place", F.col("at") % block_rows)
    out = blocks.join(F.broadcast(table) if small else table, ["source", "block"], "left")
    late = F.lit(LATE) + F.col("block")
    return out.withColumns({c: F.coalesce(c, late).cast("long") for c in ("release", "slot", "deadline")})


def _slot_table(spark: SparkSession, told: Iterator[tuple[str | None, int, int, int, int]]) -> tuple[DataFrame, bool]:
    """What slots() tells as a table in the shared folder, written part by part, and whether it may be broadcast."""
    kinds = pa.schema([("source", pa.string()), *((c, pa.int64()) for c in ("block", "release", "slot", "deadline"))])
    path, n = new_path(spark, "slots"), 0
    while (part := list(islice(told, PART_BLOCKS))) or n == 0:
        columns = list(zip(*((_named(x[0]), *x[1:]) for x in part), strict=True)) or [()] * len(kinds)
        df = spark.createDataFrame(pa.table([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds))
        df.write.mode("append").parquet(path)
        n += len(part)
        if len(part) < PART_BLOCKS:
            break
    return spark.read.schema("source string, block long, release long, slot long, deadline long").parquet(path), n <= BROADCAST_ROWS // 2


def tempered(docs: DataFrame, power: float = 0.7, source: str = "source") -> dict[str | None, float]:
    """Target weights of all sources from their shares raised to `power`, which lifts small sources."""
    counts = docs.groupBy(docs[source].cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return {r.s: float(r.n) ** power for r in counts.collect()}  # one row a source


def mix(docs: DataFrame, weights: dict[str | None, float], block_rows: int = 64, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of `docs`, laid out in the mix's order: range-partitioned by (slot, place) and sorted.

    Each file that is written from it is a contiguous part of the schedule, so
    what reads file by file meets the sources at their target weights. Every
    row has a place of its own, also rows without an id and rows that share
    one: the rows themselves are numbered, nothing is joined back by id. Only a
    table with rows without an id is written first, so that their order stays.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), _source_name(docs[source]).alias("source"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = _ordered(rows)
    if not docs.where(docs[doc_id].isNull()).isEmpty():
        rows = written(rows, "unnamed")
    laid = _scheduled(rows, weights, block_rows, None).select("row", "slot", "place")
    return laid.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def laid_order(docs: DataFrame) -> Column | None:
    """Each row's place in the Parquet files that a mix was written to, as a number below 2^43: by its file, in the order of names, then by its row there.

    However Spark deals the files to tasks, this is the mix's order. A table
    that is not read from such files has none.
    """
    files = sorted(docs.inputFiles())  # one name a file
    rows = 43 - len(files).bit_length()
    try:
        told = docs.metadataColumn("_metadata")
        file = F.array_position(F.array(*[F.lit(f.rsplit("/", 1)[-1]) for f in files]), told["file_name"]) - 1
        if not files or not docs.select(told["row_index"]).columns:
            return None
    except AnalysisException:
        return None
    fits = (file >= 0) & (told["row_index"] < F.lit(1 << rows))
    return F.when(fits, file * F.lit(1 << rows) + told["row_index"]).otherwise(F.raise_error(F.lit("a row's place in the mix is unknown")).cast("long"))
