"""The pipeline against a brute-force version, and the registered queries against their SQL."""

import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecforge.llm import mixing, packing, toxicity
from vecforge.llm.queries import ORACLES, QUERIES, documents, tokenizer

from . import brute
from .test_operators import check_packing, ids_bytes
from .test_spelling import brute as spelled
from .test_spelling import told


def kept_rows(rows, toxic):
    """What brute force keeps of (doc_id, text) rows before mixing: ids may repeat and be null."""
    rows = [r for r in rows if r not in toxic]
    once, seen = [], set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        spaced = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if spaced not in seen:
            seen.add(spaced)
            once.append((i, t))
    near = brute.near_components({k: t for k, (_, t) in enumerate(once)}, 5)  # rows are in order of their ids
    return [once[k] for k, c in near.items() if k == c] + [r for r in rows if r[0] is None]


def check_run(spark, docs, labels, sf, out):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    toxic = {(r.doc_id, r.text) for r in docs.join(toxicity.score(docs.select(docs.doc_id, docs.text), model).select("doc_id", "score"), "doc_id").where("score >= 0.5").collect()} if len({i for i, _ in rows}) == len(rows) else {r for r in rows if brute_toxic(spark, r, model)}
    enc, want = ids_bytes("word_bpe_49k.json"), []
    for i, t in kept_rows(rows, toxic):
        raw = enc(t)
        want += [(-1 if i is None else i, p, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for p, at in enumerate(range(0, len(raw), 8192))]
    check_packing(out.collect(), want)


def brute_toxic(spark, row, model):
    return toxicity.score(spark.createDataFrame([row], "doc_id long, text string"), model).first().score >= 0.5


def test_pipeline(spark, sf):
    check_run(spark, documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), sf, corpus_pipeline.run(spark, sf))


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """Ids that repeat with equal and other texts, null ids, null and empty texts, special tokens, a column of another name."""
    docs = documents(spark, sf).limit(30)
    some = docs.collect()
    odd = [(some[0].doc_id, some[5].text), (some[0].doc_id, "a text of its own under an id that is there already"), (None, some[1].text), (None, None), (some[7].doc_id, some[7].text), (90_001, "a <|endoftext|> b"), (90_002, None), (90_003, ""), (90_004, " ")]
    more = docs.select(*docs.columns).unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).withColumn("slot", F.lit(1))
    more.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    check_run(spark, documents(spark, str(tmp_path)), labels, str(tmp_path), corpus_pipeline.run(spark, str(tmp_path)))


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = documents(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_sequences_follow_the_mix(spark, sf, tmp_path):
    """Packed sequences, by ascending number, meet both sources at their target shares; the documents come source by source."""
    rng = random.Random(11)
    rows = [(i, "a" if i < 600 else "b", " ".join(rng.choice(("stone", "river", "cloud", "paper")) for _ in range(1030 + i % 50 + 400 * (i < 600)))) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    corpus_pipeline.mixed(spark, docs, sf).write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    spots = [r.spot for r in docs.select(mixing.laid_order(docs).alias("spot")).collect()]
    assert len(set(spots)) == 800 and 0 <= min(spots) and max(spots) < 1 << 43
    out = corpus_pipeline.packed(spark, docs, sf).collect()  # a sequence holds one document: each has more than half of 2048 tokens
    assert len({r.sequence_id for r in out}) == 800
    order = ["ab"[r.doc_id >= 600] for r in sorted(out, key=lambda r: r.sequence_id)]
    weights = {"a": 600**0.7, "b": 200**0.7}
    held = mixing.targets_hold(weights, {"a": 10, "b": 4}) * 64
    share = weights["a"] / sum(weights.values())
    assert held > 500 and all(abs(order[:n].count("a") - share * n) <= 128 for n in range(held))
    assert abs(600 - share * 600) > 128  # as the documents came


def test_sequences_of_one_document_and_of_short_ones_have_numbers_of_their_own(spark, sf):
    rows = [(i, "word " * n, 5 - i) for i, n in enumerate((9000, 20, 3000, 1, 1500, 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(3)
    out = packing.pack(docs, tokenizer("word_bpe_49k.json"), order=F.col("place")).collect()
    enc, want = ids_bytes("word_bpe_49k.json"), []
    for i, t, _ in rows:
        raw = enc(t)
        want += [(i, p, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for p, at in enumerate(range(0, len(raw), 8192))]
    check_packing(out, want)
    for r in out:
        if r.offset == 0:
            assert r.sequence_id == (5 - r.doc_id) * packing.DOC_PIECES + r.piece


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name.startswith("op11_"):  # a row a word
        rows = documents(spark, sf).collect()
        assert told(df) == spelled([r.text for r in rows], [r.doc_id for r in rows])
        return
    got = df.toPandas()
    n = documents(spark, sf).count()
    if not name.startswith("op12_"):  # ten rows an item
        assert got.doc_id.nunique() == n and (len(got) == n or name.startswith("op5_"))
    if name in ORACLES:
        duck = duckdb.connect()
        for t in ("documents", "benchmark"):
            duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
