"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecforge.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, block long, query int, score long, rank int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id long, text string, doc_id long, query long")


def brute(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in docs), max(1, sum(sum(c.values()) for _, c in docs))
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def searched(spark, docs, items, k=10, size=lexical_search.BLOCK_DOCS):
    path = lexical_search.index(docs, block_docs=size)
    return lexical_search.search(lexical_search.read(spark, path), asked(spark, items), k)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.expovariate(0.01))}" for _ in range(2000)] + ["Été", "中文", "A1", "x_y"]
    texts = [rng.choice([" ", ", ", "\n", "{}"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))) for _ in range(500)]
    texts += [None, "", " ;; ", "w" * 100_000, "w1 " * 50_000, *texts[:30], texts[3].upper()]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for k in range(25)] + [(100, texts[7]), (101, "été ÉTÉ w1 w1 w1"), (102, None), (103, ""), (104, "nothing_like it"), (None, "w1 w2"), (105, "w1 " * 500)]
    return texts, items


@pytest.mark.parametrize("size, k, terms_", [(64, 10, None), (3, 10, 200), (1, 1, None), (500, 700, None)])
def test_equals_brute_force(spark, corpus, size, k, terms_, monkeypatch):
    texts, items = corpus
    if terms_:
        monkeypatch.setattr(lexical_search, "QUERY_TERMS", terms_)
        monkeypatch.setattr(lexical_search, "HELD_BYTES", 5000)
    got = told(searched(spark, table(spark, texts).repartition(5), items, k, size))
    assert got == brute(list(enumerate(texts)), items, k)


def test_ties_repeated_and_null_ids(spark):
    texts = ["a b c", "a b c", "c b a", "a b c", "d d", None, "a b c"]
    ids = [5, 3, None, 9, 3, 4, 3]
    items = [(1, "a c"), (1, "d"), (2, "b")]
    got = told(searched(spark, table(spark, texts, ids).repartition(3), items, 4, 2))
    assert got == brute(list(zip(ids, texts, strict=True)), items, 4)


def test_empty_tables(spark):
    items = [(1, "a")]
    assert told(searched(spark, table(spark, []), items)) == told(searched(spark, table(spark, [None, ""]), items)) == []
    assert told(searched(spark, table(spark, ["a"]), [])) == told(searched(spark, table(spark, ["a"]), [(1, None)])) == []


def test_bounds_hold_and_blocks_are_left_out(corpus):
    rng = random.Random(1)
    texts = [" ".join(rng.choice([f"t{k // 8}_{j}" for j in range(40)] + ["the", "of"]) for _ in range(rng.randrange(5, 60))) for k in range(800)]
    names = lexical_search._INDEX_NAMES
    rows = [dict(zip(names, [k, *r], strict=True)) for k, r in enumerate(lexical_search._blocks(pa.array(texts), pa.array(range(800)), 8))]
    q, which = lexical_search.Queries.of(["t3_1 t3_2 the of", "the", "t9_1 t50_2 of", "t7_7"])
    counts = [Counter(terms(t)) for t in texts]
    q.n, q.total = 800, sum(sum(c.values()) for c in counts)
    df = Counter(h for r in rows for h, n in zip(np.frombuffer(r["terms"], "<u8").tolist(), np.frombuffer(r["dfs"], "<i4").tolist(), strict=True) for _ in range(n))
    q.weight = np.array([math.floor(1000 * math.log(1602 / (2 * df[h] + 1))) for h in q.vocabulary.tolist()])
    for r in rows:
        bound = q.bounds(r)
        for i, score in q.scores(r, np.arange(len(which))):
            assert score.max(initial=0) <= bound[i]
    best = lexical_search.Best(len(which), 5, np.zeros(len(which), dtype=np.int64))
    scored = lexical_search.take_blocks(rows, q, best)
    assert scored < 0.6 * len(rows) * len(which)
    every = lexical_search.Best(len(which), 5, np.zeros(len(which), dtype=np.int64))
    lexical_search.take_blocks(rows, q, every, [np.arange(len(which))] * len(rows))
    assert best.doc == every.doc and all((a == b).all() for a, b in zip(best.score, every.score, strict=True))


def test_row_groups_of_the_index_are_small(spark):
    """A reader holds up to 4096 blocks of a row group at once: a task's file is many row groups, each of some MB."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 1500))) for i in range(2400)], "doc_id long, text string").coalesce(1)
    path = lexical_search.index(docs, block_docs=16)
    (file,) = Path(path.removeprefix("file://")).glob("*.parquet")
    told = pq.ParquetFile(file).metadata
    sizes = [told.row_group(i).total_byte_size for i in range(told.num_row_groups)]
    assert told.num_rows >= 150 and sum(sizes) > 3 * (8 << 20)
    assert max(sizes) <= 8 << 20 and max(told.row_group(i).num_rows for i in range(told.num_row_groups)) <= 64
