"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vecforge.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string, root string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def apart_by_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


def brute(texts, ids):
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: sorted((-n[v], v) for v in n if v != w and abs(len(v) - len(w)) <= 1 and apart_by_one(v, w)) for w in n}
    form = {w: (x[0][1] if x and -x[0][0] >= 2 * n[w] else None) for w, x in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def told(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_trie_accepts_just_distance_one(size):
    rng = random.Random(size)
    for letters in (b"a", b"ab", bytes([97, 122, 0xC0, 0xFF]), bytes(range(97, 123))):
        make = lambda: {bytes(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(min(size, 300))}  # noqa: B023, E731
        words, asked = sorted(make()), sorted(make())
        trie = spelling.Trie.unpacked(spelling.Trie.of(words, np.arange(len(words))).packed())
        of, at = trie.near(asked)
        got = sorted(zip(of.tolist(), at.tolist(), strict=True))
        assert got == [(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if apart_by_one(x.decode("latin-1"), y.decode("latin-1"))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(4, 9))) for _ in range(40)]

    def spelled():
        w = rng.choice(stems)
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w.upper() if w.isascii() else w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k:], w[:k] + "q" + w[k + 1 :]])

    texts = [rng.choice([" ", "-", "1", "\n", "Ā", "中"]).join(spelled() for _ in range(rng.randrange(0, 150))) for _ in range(120)]
    return [*texts, None, "", None, "Ünïcode", *["c" * 9000] * 3, *texts[:6], *["b" * 4000] * 3, *["b" * 4001] * 4]


@pytest.mark.parametrize("shard_words", [25, spelling.SHARD_WORDS])
def test_variants_equal_brute_force(spark, corpus, shard_words, monkeypatch):
    if shard_words == 25:  # many shards, some at a time
        monkeypatch.setattr(spelling, "BROADCAST_BYTES", 10_000)
    ids = [*range(len(corpus) - 20), *[7] * 8, *[None] * 12]
    docs = table(spark, corpus, ids).repartition(5)
    got = told(spelling.variants(spelling.vocabulary(docs), shard_words=shard_words))
    want = brute(corpus, ids)
    assert got == want and any(f for f, *_ in want.values())


def test_checksum_rule_hits_and_counts(spark):
    texts = ["some words here again repeated " * 3] * 700
    got = told(spelling.variants(spelling.vocabulary(table(spark, texts))))
    assert got == brute(texts, range(700)) and any(n < 100 for _, _, n, _, _ in got.values())


def test_forms_are_followed_to_the_last(spark):
    words = [("abcde" + "x" * k, 3 * 2**k) for k in range(9)] + [("zzzzz", 5), ("zzzzy", 9), ("zzzzx", 9)]
    got = told(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert {w: r for w, (_, r, *_) in got.items()} == {w: "abcde" + "x" * 8 if w[0] == "a" else w for w, _ in words}
    assert got["zzzzz"] == (None, "zzzzz", 5, 2, None)  # 9 < 2 * 5


def test_empty_tables(spark):
    for texts in ([], [None, ""], ["1 2 3"]):
        assert spelling.variants(spelling.vocabulary(table(spark, texts))).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
