"""Near-duplicate documents by min-max hashing, with exact confirmation.

A document's set holds its distinct shingles of `words` consecutive words. Each
of `permutations` random bijections of the shingle hashes gives two signature
values, the minimum and the maximum, so half as many hashes are evaluated as a
min-hash signature of that length needs, and agreement estimates the Jaccard
similarity without bias and with less variance. Bands of `rows` values make
buckets; the defaults, 32 bands of 4, miss a pair of similarity 0.8 with
probability 5e-8, and settings that miss more than one in 100,000 are refused.

Equal sets are one class, a node, from the start; two different sets get equal
128-bit sums with probability 2 ** -128 a pair. In a bucket each node meets
only one pivot, which differs by bucket, and confirmed pairs are joined into
components. Nodes whose bucket then still holds another component go through an
exact prefix filter, so no link is lost to the choice of pivots or to the
signature bits that spare pivots hopeless pairs; pairs within a component need
no comparison. Every link is confirmed on the full sets, in integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, dropped, few, lean, rounds, small_batches, table, unused, within, without, written

#: Words of 64 parity bits for the exact prefix filter's pairs.
ODD_WORDS = 8


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    permutations: int = 64
    rows: int = 4
    lower: bool = True
    seed: int = 7

    def __post_init__(self) -> None:
        share = self.percent / 100
        if self.permutations < 64 or (1 - share**self.rows) ** (2 * self.permutations // self.rows) > 1e-5:
            raise ValueError("these bands miss too many pairs of that similarity; take more permutations or fewer rows a band")

    @property
    def bits(self) -> int:
        """Differing bits, of 128, beyond which a pair does not meet its pivot: 6 standard deviations over what the similarity asked for gives."""
        share = (1 - self.percent / 100) / 2
        return math.ceil(128 * share + 6 * math.sqrt(128 * share * (1 - share)))


def sets_of(texts: pa.Array, p: Params):
    """Each text's sorted distinct shingle hashes; with fewer words than a shingle the whole sequence is one; none without words."""
    for a, b in rounds(texts, W.ROUND_BYTES):
        found = W.find(texts.slice(a, b - a), lower=p.lower)
        hashes = found.hashes()
        shingles, bounds = W.windows_of(found, hashes, p.words, p.seed)
        for t in range(b - a):
            if bounds[t + 1] > bounds[t]:
                yield np.unique(shingles[bounds[t] : bounds[t + 1]])
            elif found.offset[t + 1] > found.offset[t]:
                few = hashes[found.offset[t] : found.offset[t + 1]]
                yield W.windows(few, len(few), p.seed + len(few))
            else:
                yield few_none


few_none = np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray, p: Params) -> np.ndarray:
    """2 * permutations values: minimum and maximum under each permutation, side by side."""
    factor, shift = W.odd_numbers(p.permutations, p.seed + 1), W.odd_numbers(p.permutations, p.seed + 2)
    low = np.full(p.permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(p.permutations, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        x = shingles[k : k + 4096, None] * factor + shift
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def _sums(shingles: np.ndarray) -> list[int]:
    """Two hashes of a whole set."""
    return np.array([W.mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)], dtype=np.uint64).view(np.int64).tolist()


def _signed(docs: DataFrame, doc_id: str, text: str, p: Params) -> DataFrame:
    """Per document: n_shingles, two hashes of the whole set, band keys, two words of signature bits."""
    band_mix = W.odd_numbers(p.rows, p.seed + 3)
    bands = 2 * p.permutations // p.rows
    number = W.mix(np.arange(bands, dtype=np.uint64) + np.uint64(p.seed))
    names = ["doc_id", "variant", "n_shingles", "set1", "set2", "bands", "bits1", "bits2"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def sign(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names[2:]]
            for s in sets_of(batch.column(1), p):
                if not len(s):
                    row = (0, None, None, None, None, None)
                else:
                    v = signature(s, p)
                    keys = W.mix((v.reshape(bands, p.rows) * band_mix).sum(axis=1, dtype=np.uint64) ^ number)
                    bits = np.packbits((W.mix(v[:128]) & np.uint64(1)).astype(np.uint8))
                    bits = np.resize(bits, 16).view(np.int64)
                    row = (len(s), *_sums(s), keys.view(np.int64), *bits.tolist())
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield table(names, [batch.column(0), batch.column(2), *out], types)

    schema = "doc_id long, variant long, n_shingles long, set1 long, set2 long, bands array<long>, bits1 long, bits2 long"
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text])).mapInArrow(lean(sign), schema)


_SETS = "id long, set1 long, set2 long, odd array<long>, shingles array<long>"


def _sets(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, p: Params, parity: bool) -> DataFrame:
    """(node, odd, shingles) of the nodes (node, id, set1, set2), written; odd, ODD_WORDS of parity bits, only if asked for.

    A node's set comes from the text of a document that has it; an id may carry several texts, so the set tells which.
    """

    def shingle(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(1), p))
            sums = [_sums(s) for s in sets]
            odd = None
            if parity:
                odd = []
                for s in sets:
                    bits = np.bincount((W.mix(s ^ np.uint64(5)) % np.uint64(64 * ODD_WORDS)).astype(np.int64), minlength=64 * ODD_WORDS) & 1
                    odd.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            columns = [batch.column(0), [x[0] for x in sums], [x[1] for x in sums], odd or [None] * len(sets), [s.view(np.int64) for s in sets]]
            yield table(["id", "set1", "set2", "odd", "shingles"], columns, [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2)

    ids = written(nodes.select(F.col("id").alias("doc_id")).distinct(), "ids")
    wanted = within(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), ids, "doc_id")
    same = ["id", "set1", "set2"]  # one row a node: the join keeps the partitioning that repeated rows were found by
    found = wanted.mapInArrow(lean(shingle), _SETS).dropDuplicates(same).join(few(nodes), same)
    out = written(found.select("node", "odd", "shingles"), "sets")
    dropped(ids)
    return out


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str, p: Params) -> DataFrame:
    """Of the pairs (a, b) of nodes, those with percent * union <= 100 * intersection on the full sets; written."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = written(reps.select("node", F.col("rep").alias("id"), "set1", "set2").join(named, "node", "left_semi"), "nodes")
    sets = _sets(nodes, docs, doc_id, text, p, False)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    second = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(second.select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long"), "links")
    dropped(nodes, sets)
    return out


def _prefix_pairs(open_: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str, p: Params) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can be linked: an exact prefix filter, which loses none.

    Shingles are ordered by how many of these nodes hold them, rarest
    first. Of two linked sets, the larger has a common shingle with the smaller
    among its first n - ceil(t n) + 1, and that one is among the smaller one's
    first m - ceil(2 t m / (1 + t)) + 1. A shingle of one node alone takes
    a place there but meets nobody: a text with many words of its own has no
    pairs at all, however large its bucket is. Of the rest, a parity bit per
    hash cell bounds the number of shingles that only one of the two has from
    below, exactly again.
    """
    nodes = written(reps.select("node", F.col("rep").alias("id"), "set1", "set2").join(open_.select("node"), "node", "left_semi"), "nodes")
    sets = _sets(nodes, docs, doc_id, text, p, True)
    held = sets.select("node", F.explode("shingles").alias("shingle"))
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = held.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    own = F.col("u.n") - F.size("shared")
    probe = F.col("u.n") - F.expr(f"(u.n * {p.percent} + 99) div 100") + 1 - own
    index = F.col("u.n") - F.expr(f"(u.n * {2 * p.percent} + {99 + p.percent}) div {100 + p.percent}") + 1 - own
    odd = sets.select("node", F.struct(*[F.col("odd")[i].alias(f"w{i}") for i in range(ODD_WORDS)]).alias("o"))
    sized = written(open_.join(shared, "node").join(odd, "node").select("o", "u", "c", "shared", probe.cast("int").alias("probe"), index.cast("int").alias("index")).where("probe > 0"), "prefixes")
    dropped(nodes, sets)

    def first(n: str):
        return F.explode(F.slice("shared", F.lit(1), F.greatest(F.col(n), F.lit(0)))).alias("s")

    larger = sized.select("o", "u", "c", first("probe")).select("o", "u", "c", "s.shingle")
    smaller = sized.select(F.col("o").alias("q"), F.col("u").alias("v"), F.col("c").alias("d"), first("index")).select("q", "v", "d", "s.shingle")
    differ = sum((F.bit_count(F.col(f"o.w{i}").bitwiseXOR(F.col(f"q.w{i}"))) for i in range(1, ODD_WORDS)), F.bit_count(F.col("o.w0").bitwiseXOR(F.col("q.w0"))))
    near = (100 + p.percent) * differ <= (100 - p.percent) * (F.col("u.n") + F.col("v.n"))
    order = (F.col("v.n") < F.col("u.n")) | ((F.col("v.n") == F.col("u.n")) & (F.col("v.node") < F.col("u.node")))
    found = larger.join(smaller, "shingle").where((F.col("c") != F.col("d")) & order & near & _sized("u", "v", p))
    return found.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct()


def _sized(a: str, b: str, p: Params):
    """The sizes allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(n, m) >= p.percent * F.greatest(n, m)


def _worth(a: str, b: str, p: Params):
    """Sizes and signature bits allow the similarity."""
    differ = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return _sized(a, b, p) & (differ <= p.bits)


def _rows(docs: DataFrame, doc_id: str, text: str, p: Params) -> DataFrame:
    """(doc_id, variant, n_shingles, c, component_id) of each row: variant is a hash of its text, c names its component, null without shingles."""
    small_batches(docs.sparkSession)
    signed = written(_signed(docs, doc_id, text, p), "signed")
    known = signed.where("doc_id is not null and n_shingles > 0")
    same = ["set1", "set2"]
    reps = known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.struct(F.first("n_shingles").alias("n"), F.first("bits1").alias("s1"), F.first("bits2").alias("s2")).alias("is"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    member = reps.select(F.explode("bands").alias("key"), F.struct("node", "is.n", "is.s1", "is.s2").alias("u"))
    pick = F.struct(F.xxhash64("key", "u.node").alias("order"), F.col("u").alias("v"))
    pivots = member.groupBy("key").agg(F.min(pick).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot.v")
    buckets = written(member.join(pivots, "key"), "buckets")
    ends = [F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")]
    pairs = written(buckets.where((F.col("u.node") != F.col("v.node")) & _worth("u", "v", p)).select(*ends).distinct(), "pairs")
    links = _confirmed(pairs, reps, docs, doc_id, text, p)
    linked = components(links)

    # Nodes that share a bucket with another component after the pivots.
    named = linked.select(F.col("id").alias("r"), "component")
    marked = written(buckets.select("key", "u").join(named, F.col("u.node") == F.col("r"), "left").select("key", "u", F.coalesce("component", "u.node").alias("c")), "marked")
    mixed = written(marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "mixed")
    open_ = written(marked.join(mixed, "key", "left_semi").groupBy(F.col("u.node").alias("node")).agg(F.first("u").alias("u"), F.first("c").alias("c")), "open")
    dropped(buckets, marked, mixed)
    rest = written(_prefix_pairs(open_, reps, docs, doc_id, text, p).join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _confirmed(rest, reps, docs, doc_id, text, p)
        before, linked = linked, components(links.unionByName(more))
        dropped(before, more)
    dropped(pairs, links, open_, rest)

    mine = reps.select("node", "rep", *same).join(linked.withColumnRenamed("id", "node"), "node", "left").select(*same, "rep", F.coalesce("component", "node").alias("c"))
    least = mine.groupBy("c").agg(F.min("rep").alias("component_id"))
    roots = mine.join(least, "c").select(*same, "c", "component_id")
    out = signed.select("doc_id", "variant", "n_shingles", *same).join(roots, same, "left")
    return out.select("doc_id", "variant", "n_shingles", "c", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    component_id is the smallest doc_id reachable over links, kept says that it
    is the document's own. Null and empty texts and texts without words have no
    shingles and are linked with nothing. Of rows repeated under one id each has
    the component of its own text. Rows with a null id are returned with a null
    component and kept true. Empty tables give no rows; other columns are not
    read.
    """
    out = _rows(docs, doc_id, text, params).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """The documents of which one of each component stays, all columns; documents without an id or without words stay.

    Decisions are for rows: of an id that carries several texts only those go
    whose component has a row before them, by id, then by text. Rows repeated
    with one id and text leave one row.
    """
    name = unused(docs, "variant")
    rows = written(_rows(docs, doc_id, text, params).where("doc_id is not null and c is not null").select("doc_id", "variant", "c"), "found")
    best = rows.groupBy("c").agg(F.min(F.struct("doc_id", "variant")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = written(best.select("c", "best"), "best")
    many = rows.join(few(best), "c")
    first, key = F.struct("doc_id", "variant") == F.col("best"), [F.col("doc_id").alias(doc_id), F.col("variant").alias(name)]
    lost = written(many.where(~first).select(key).distinct(), "lost")
    twice = written(many.where(first).groupBy(key).count().where("count > 1").select(doc_id, name), "twice")
    dropped(rows, best)
    stay = without(docs.withColumn(name, F.xxhash64(docs[text])), lost, [doc_id, name])
    if not twice.isEmpty():
        stay = without(stay, twice, [doc_id, name]).unionByName(within(stay, twice, [doc_id, name]).dropDuplicates([doc_id, name]))
    return stay.select(*[f"`{c}`" for c in docs.columns])
