"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after each run of `[\\x20\\x09-\\x0D]` became one
space. Every task keeps a Misra-Gries summary of its digests; the summed
summaries name every digest with more than a `1 / counters` share of all rows,
and at most `2 * counters` digests in all. Only for those are group size and
winner counted exactly, pre-aggregated; that bounded table is broadcast, so the
rows of frequent digests never move. The remaining digests are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, table, unused, within, without, written

#: Misra-Gries counters per summary; also fixes the broadcast winners' bound (2 * counters rows of 56 bytes).
COUNTERS = 2048


def digest(docs: DataFrame, text: str = "text"):
    """SHA-256 of the normalised text (null: empty)."""
    spaced = F.regexp_replace(F.coalesce(docs[text], F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(spaced, 256))


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may have more than 1 / counters of all rows: (digest); at most 2 * counters of them."""

    def summary(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                if x["values"] is not None:
                    held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > counters:  # take the (counters + 1)th largest count from all: what goes negative leaves
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: v - least for k, v in held.items() if v > least}
        if held:
            yield table(["digest", "held"], [list(held), list(held.values())], [pa.binary(), pa.int64()])

    total = rows.count()
    found = rows.select("digest").mapInArrow(lean(summary), "digest binary, held long").groupBy("digest").agg(F.sum("held").alias("held"))
    # Summaries fall short by at most total / (counters + 1): half of the share asked for stays in sight.
    return found.where(F.col("held") > total / (2.0 * counters)).select("digest")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, digest).

    The row with the smallest id of a group stays. Repeated ids: each row counts
    in group_size, and all its rows with the winning id are marked kept; `deduplicate`
    returns one of them. A null id never wins over an id; a group of null ids
    alone keeps keep_id null and kept true. Null text equals empty text. An
    empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), digest(docs, text).alias("digest")), "digests")
    hot = frequent(rows, counters)
    stats = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = written(rows.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest").agg(*stats), "winners")
    known = F.broadcast(winners)
    head = rows.join(known, "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Aggregated, then joined: a digest just short of frequent is never a group held by one task, and its rows may be split again.
    tail = rest.join(rest.groupBy("digest").agg(*stats), "digest").select("doc_id", "digest", "keep_id", "group_size")
    return head.select(tail.columns).unionByName(tail).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns; decisions are for rows, so an id that carries two texts loses only the one that repeats.

    Rows repeated with one id and equal texts leave one row; rows with a null id stay.
    """
    out = classes(docs, doc_id, text)
    name = unused(docs, "digest")
    key = [doc_id, name]
    told = out.where("doc_id is not null").select(F.col("doc_id").alias(doc_id), F.col("digest").alias(name), "kept")
    lost = written(told.where("not kept").select(key).distinct(), "lost")
    twice = written(told.where("kept").groupBy(key).count().where("count > 1").select(key), "twice")
    stay = without(docs.withColumn(name, digest(docs, text)), lost, key)
    if not twice.isEmpty():
        stay = without(stay, twice, key).unionByName(within(stay, twice, key).dropDuplicates(key))
    return stay.select(*[f"`{c}`" for c in docs.columns])
