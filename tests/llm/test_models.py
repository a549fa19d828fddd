"""What the models learn and where records go, step by step against plain arithmetic."""

import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vecforge.llm import quality_classifier, sharding, toxicity
from vecforge.llm import words as W

TOKEN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def hash_of(kind: str, spelled: str) -> int:
    found = W.find(pa.array([spelled]), lower=True, letters=True)
    return int(found.hashes(0 if kind == "whole" else 1)[0])


def parts_of(token: str) -> set[tuple[str, str]]:
    return {("whole", token), *(("begin", token[:n]) for n in toxicity.BEGINNINGS if len(token) >= n)}


def test_log_odds_of_tokens_and_beginnings(spark):
    rng = random.Random(11)
    stems = ["foul", "grim", "plain", "été", "straße", "neutral"]
    make = lambda bad: " ".join(rng.choice(stems[:2] if bad and rng.random() < 0.5 else stems[1:]) + rng.choice(["", "s", "ness", "heitlich", "9"]) for _ in range(rng.randrange(3, 30)))
    rows = [(k, make(k % 3 == 0), int(k % 3 == 0)) for k in range(400)] + [(1000 + k, make(False), None) for k in range(100)] + [(2000, None, None), (2001, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 5 as f").collect()}
    held = lambda t: {p for x in TOKEN.findall((t or "").lower()) for p in parts_of(x)}
    learn = [(held(t), y) for i, t, y in rows if y is not None and fold[i] in (1, 2, 3)]
    c, c1 = Counter(p for x, _ in learn for p in x), Counter(p for x, y in learn if y for p in x)
    n1, n0 = sum(y for _, y in learn), sum(1 - y for _, y in learn)
    known = {p for p, n in c.items() if n >= toxicity.LEAST_DOCUMENTS}
    spread, n_docs = Counter(p for _, t, _ in rows for p in held(t)), sum(bool(TOKEN.findall(t or "")) or t is not None for _, t, _ in rows)
    got = dict(zip(model.tokens.tolist(), model.scores.tolist(), strict=True))
    assert set(got) == {hash_of(*p) for p in known} and len(known) > 20
    errors = []
    for total in (n_docs, len(rows)):  # whether texts without a token count is the model's own affair
        worst = 0.0
        for p in known:
            share = (spread[p] + 0.5) / (total + 1)
            p1, p0 = (c1[p] + 4 * share) / (n1 + 4), (c[p] - c1[p] + 4 * share) / (n0 + 4)
            odds = math.log(p1 / (1 - p1 + 1e-9)) - math.log(p0 / (1 - p0 + 1e-9))
            z = odds / math.sqrt(1 / (c1[p] + 4 * share) + 1 / (c[p] - c1[p] + 4 * share))
            worst = max(worst, abs(min(8.0, max(-4.0, odds * z * z / (z * z + 9))) - toxicity.DRIFT - got[hash_of(*p)]))
        errors.append(worst)
    assert min(errors) < 1e-9


def test_one_step_of_the_machine_follows_the_gradient():
    rng = np.random.default_rng(4)
    n, wide = 20, 6
    count = rng.integers(0, 5, n)
    bounds = np.concatenate([[0], np.cumsum(count)])
    index, value = rng.choice(40, bounds[-1]).astype(np.int64), rng.random(bounds[-1])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # different words of a document
        index[a:b] = rng.choice(40, b - a, replace=False)
    dense, y = rng.normal(size=(n, wide)), rng.integers(0, 2, n).astype(float)
    ridge, rate = 2e-4, 0.08
    size, factors = quality_classifier.HASHED + wide, quality_classifier.FACTORS
    v0 = np.random.default_rng(1).normal(0, 0.02, (size, factors))
    machine = lambda b, w, v: quality_classifier.Machine(b, w, v)
    bias = math.log(y.mean() / (1 - y.mean()))

    def loss(b, w, v):
        p = 1 / (1 + np.exp(-machine(b, w, v).logits(bounds, index, value, dense)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5 * ridge * ((w * w).sum() + (v * v).sum())

    got = quality_classifier.train(bounds, index, value, dense, y, epochs=1, ridge=ridge, rate=rate)
    touched = sorted({*index.tolist(), *range(quality_classifier.HASHED, size)})
    w0, h = np.zeros(size), 1e-5
    for j in touched[::3]:
        up, down = w0.copy(), w0.copy()
        up[j], down[j] = h, -h
        g = (loss(bias, up, v0) - loss(bias, down, v0)) / (2 * h)
        assert got.w[j] == pytest.approx(-rate * g / math.sqrt(1e-6 + g * g), abs=2e-3)
        for f in (0, factors - 1):
            up, down = v0.copy(), v0.copy()
            up[j, f] += h
            down[j, f] -= h
            g = (loss(bias, w0, up) - loss(bias, w0, down)) / (2 * h)
            assert got.v[j, f] == pytest.approx(v0[j, f] - 0.5 * rate * g / math.sqrt(1e-6 + g * g), abs=2e-3)
    rest = np.setdiff1d(np.arange(size), touched)
    assert not got.w[rest].any() and (got.v[rest] == v0[rest]).all()


def test_records_go_where_a_plain_plan_puts_them(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 200))) for _ in range(600)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:50], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in sharding.shard(docs, shards=5)[0].collect()}
    slot_of = {r.doc_id: (r.vslot, r.size) for r in sharding.slotted(docs, "doc_id", "text").collect()}
    load = defaultdict(int)
    for vslot, size in slot_of.values():
        load[vslot] += size
    heap, home = [(0, s) for s in range(5)], {}
    for vslot in sorted(load, key=lambda k: (-load[k], k)):
        w, s = heapq.heappop(heap)
        home[vslot] = s
        heapq.heappush(heap, (w + load[vslot], s))
    assert {i: r.shard for i, r in got.items()} == {i: home[v] for i, (v, _) in slot_of.items()}
    assert all(r.size == len((rows[i][1] or "").encode()) + 1 for i, r in got.items())
    for s in range(5):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5000):
        tokens = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)[:n]]))
        asked = np.concatenate([tokens, rng.integers(0, 2**64, 998, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)])
        place = {x: i for i, x in enumerate(tokens.tolist())}
        assert toxicity._places(tokens, asked[:, None], toxicity._directory(tokens)).ravel().tolist() == [place.get(x, -1) for x in asked.tolist()]
    crowded = np.arange(1, 200, dtype=np.uint64)  # all share their leading bits
    assert toxicity._places(crowded, np.arange(300, dtype=np.uint64), toxicity._directory(crowded)).tolist() == [-1, *range(199), *[-1] * 100]


def test_distinct_places():
    rng = np.random.default_rng(5)
    mark = np.empty(101, dtype=np.int32)
    for n in (0, 1, 50, 3000):
        places = rng.integers(-1, 100, n)
        assert sorted(toxicity._distinct(places, mark).tolist()) == sorted(set(places.tolist()))


def test_beginnings_are_hashed_like_words():
    texts = ["abcdefghijkl", "naïveté", "漢字かな混じり文を書く", "a", "😀😀😀😀z"]
    found = W.find(pa.array(texts), letters=True)
    whole = found.hashes()
    got = found.beginnings(np.arange(len(texts)), whole, range(3, 9))
    for t, text in enumerate(texts):
        cut = [W.find(pa.array([text[:n]])).hashes(1)[0] if n <= len(text) else whole[t] for n in range(3, 9)]
        assert got[t].tolist() == [whole[t], *cut]


def test_remembered_tokens_score_as_when_spelled_anew(monkeypatch):
    rng = np.random.default_rng(8)
    texts = pa.array([" ".join(f"w{x}ord{x % 7}" for x in rng.integers(0, 300, 200)) for _ in range(20)] + ["", None])
    known = np.unique(next(toxicity._tokens(texts))[0])[::3]
    model = toxicity.Model(known, rng.normal(size=len(known)), -1.0, 1.0, 0.0, np.zeros(3))
    want = [list(toxicity._token_scores(texts.slice(i, 1), toxicity._Remembered(model.token_scores)))[0].tolist() for i in range(len(texts))]
    for slots in (1, 8, 1 << 17):
        monkeypatch.setattr(toxicity, "REMEMBERED", slots)
        memory = toxicity._Remembered(model.token_scores)
        for _ in range(2):
            assert [s.tolist() for i in range(len(texts)) for s in toxicity._token_scores(texts.slice(i, 1), memory)] == want
