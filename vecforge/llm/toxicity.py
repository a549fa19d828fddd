"""Toxic passages by maximum-scoring segments of token log-odds.

Training: each token's log-odds between toxic and other documents, with an
informative Dirichlet prior from the token's frequency in the whole corpus,
shrunk by its evidence. A token's beginnings are learned like tokens, as most
inflected and compounded forms of a stem are too rare to be learned one by one;
of a token and its beginnings the one with the strongest log-odds counts.
Scoring: a token scores its log-odds less a drift, so ordinary text scores
below zero, and one linear scan finds all maximal scoring segments. By extreme-value theory a text of n tokens has K n exp(-lambda s)
segments of score s or more by chance; segments with a small expected number
are significant, and a document's evidence is calibrated to a probability on
labelled documents that the token scores were not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import lean, rounds, small_batches, table

#: Labelled rows that a model is fitted on, at most, by hash order of their ids.
SAMPLE_ROWS = 20_000
#: A token or a beginning has to be in so many sample documents; the model holds all that are, 16 bytes each, which SAMPLE_ROWS bounds.
LEAST_DOCUMENTS = 3
#: Tokens that a task remembers, each in the slot that its hash names, where a later one takes its place: 64 bytes a token at most.
REMEMBERED = 1 << 17
#: Characters of the beginnings that are learned beside the whole token.
BEGINNINGS = range(3, 9)
DRIFT = 1.0
SIGNIFICANT = 0.05
#: Evidence of a text without a single token that scores above zero.
LEAST_EVIDENCE = -10.0


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of tokens and beginnings
    scores: np.ndarray
    other: float  # score of a token that is not in the model, nor any of its beginnings
    lam: float
    log_k: float
    weights: np.ndarray  # of the calibration: intercept, best segment, sum of significant segments

    @cached_property
    def directory(self) -> tuple[np.uint64, np.ndarray]:
        return _directory(self.tokens)

    def places(self, spelled: np.ndarray) -> np.ndarray:
        """For each token, a row of hashes, the place in the model of the one with the strongest log-odds; -1: none is there. Of equal ones the first counts."""
        at = _places(self.tokens, spelled, self.directory)
        if not at.size or not len(self.tokens):
            return np.full(len(at), -1)
        strength = np.where(at >= 0, np.abs(self.scores[at] - self.other), -1.0)
        return at[np.arange(len(at)), np.argmax(strength, axis=1)]

    def token_scores(self, spelled: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(spelled), self.other)
        at = self.places(spelled)
        return np.where(at >= 0, self.scores[at], self.other)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float, int]:
        """Of a text's segments: best and summed excess over chance (-log of the expected number), number of significant ones."""
        excess = [self.lam * s - self.log_k - math.log(max(n, 1)) for _, _, s in found]
        least = -math.log(SIGNIFICANT)
        good = [x for x in excess if x >= least]
        return max(excess, default=LEAST_EVIDENCE), sum(good), len(good)

    def probability(self, best: float, total: float) -> float:
        z = self.weights @ np.array(features(best, total))
        return float(1 / (1 + math.exp(-min(500.0, max(-500.0, z)))))


def features(best: float, total: float) -> list[float]:
    return [1.0, min(max(best, LEAST_EVIDENCE), 30.0) / 10, math.log1p(max(total, 0.0))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time.

    Runs between positive scores are summed at once; only positive scores are
    walked. A candidate keeps the sum before and after it; one that a later
    candidate can extend without loss is merged with it.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier one with a smaller sum before
    for i in up.tolist():
        start, end, low, high = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def _labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, rows: int, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, y, then the metadata as doubles, fold) of at most `rows` labelled documents whose crc32(id) mod 5 is not 0; conflicting labels count as 1.

    An id gives one row, however many it has: the one whose text has the least
    hash, a null text before all. Rows of one id are reduced in their tasks.
    """
    known = labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull()).groupBy(labels[doc_id].alias("labelled")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("fold", F.crc32(F.col("labelled").cast("string").cast("binary")) % 5)
    some = known.where("fold != 0").orderBy(F.xxhash64(F.lit(5), F.col("labelled")), "labelled").limit(rows)
    told = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *[docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    joined = told.join(F.broadcast(some), told.doc_id == some.labelled)
    held = ["text", *[f"m{i}" for i in range(len(metadata))]]
    hashed = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash")
    one = joined.groupBy("doc_id", "y", "fold").agg(F.min(F.struct(hashed, *held)).alias("row"))
    return one.select("doc_id", "row.text", "y", *[f"row.{c}" for c in held[1:]], "fold")


def _directory(tokens: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """Of the sorted hashes `tokens`: a shift, and for each value of the bits it leaves the first place whose hash has that value or more; a place or two share one."""
    bits = len(tokens).bit_length() + 1
    shift = W.U(64 - bits)
    return shift, np.searchsorted(tokens >> shift, np.arange((1 << bits) + 1, dtype=W.U)).astype(np.int32)


def _places(tokens: np.ndarray, hashes: np.ndarray, directory: tuple[np.uint64, np.ndarray]) -> np.ndarray:
    """Where each hash is in the sorted `tokens`; -1: nowhere."""
    shift, starts = directory
    flat = hashes.ravel()
    bucket = (flat >> shift).astype(np.int64)
    at, end = starts[bucket], starts[bucket + 1]
    out = np.full(len(flat), -1, dtype=np.int64)
    left = np.flatnonzero(at < end)
    while len(left):
        same = tokens[at[left]] == flat[left]
        out[left[same]] = at[left[same]]
        at[left] += 1
        left = left[~same & (at[left] < end[left])]
    return out.reshape(hashes.shape)


def _distinct(places: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each of `places` once, without sorting them: of equal ones the last written to `mark`, which holds anything before."""
    turn = np.arange(len(places), dtype=np.int32)
    mark[places] = turn
    return places[mark[places] == turn]


class _Remembered:
    """What `told` says of tokens, a row of hashes each (itself, then its beginnings); tokens that were asked for lately are not spelled again."""

    def __init__(self, told: Callable[[np.ndarray], np.ndarray]):
        self.told = told
        self.keys = np.arange(REMEMBERED, dtype=W.U) ^ W.U(1)  # in each slot a hash that belongs into another one
        self.values = np.empty(0)

    def of(self, found: W.Words, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """For the distinct tokens `first` of a batch of texts, whose hashes are `whole`."""
        slot = (whole & W.U(REMEMBERED - 1)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != whole)
        fresh = self.told(found.beginnings(first[new], whole[new], BEGINNINGS))
        if not len(self.values):
            self.values = np.zeros((REMEMBERED, *fresh.shape[1:]), dtype=fresh.dtype)
        out = self.values[slot]
        out[new] = fresh
        self.keys[slot[new]], self.values[slot[new]] = whole[new], fresh
        return out


def _tokens(texts: pa.Array, remembered: _Remembered | None = None):
    """Of some texts at a time: what is told of their distinct tokens (their hashes, if nothing is), and each text's tokens as rows of that.

    Tokens are ASCII letters and digits and everything beyond ASCII, A-Z lowered.
    """
    remembered = remembered or _Remembered(lambda spelled: spelled)
    for a, b in rounds(texts, W.ROUND_BYTES):
        found = W.find(texts.slice(a, b - a), lower=True, letters=True)
        whole, first, row = np.unique(found.hashes(), return_index=True, return_inverse=True)
        yield remembered.of(found, first, whole), [row[found.offset[t] : found.offset[t + 1]] for t in range(b - a)]


def _token_scores(texts: pa.Array, remembered: _Remembered):
    """Scores of each text's tokens."""
    for scores, rows in _tokens(texts, remembered):
        for row in rows:
            yield scores[row]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled documents (crc32(id) mod 5 in 1 to 3; 4 calibrates; 0 is never read). Without labels of both kinds, nothing is toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = _labelled(docs, labels, label, doc_id, text, SAMPLE_ROWS).persist()

    def present(batches):
        spell = _Remembered(lambda spelled: spelled)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            hashes = [np.unique(spelled[np.unique(row)]).view(np.int64) for spelled, rows in _tokens(batch.column(0), spell) for row in rows]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64)
            yield table(["token", "y"], [flat, np.repeat(np.array(ys, dtype=np.int64), [len(h) for h in hashes])], [pa.int64(), pa.int64()])

    learn, check = sample.where("fold != 4"), sample.where("fold = 4")
    sizes = {r.y: r.n for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sum(sizes.values()) - sizes.get(1, 0))
    counts = learn.select("text", "y").mapInArrow(lean(present), "token long, y long").groupBy("token").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_DOCUMENTS)
    rows = counts.toArrow() if n1 and n0 else None
    if rows is None or not rows.num_rows:
        sample.unpersist()
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -DRIFT, 1.0, 0.0, np.array([-9.0, 0.0, 0.0]))
    tokens, c1, c = (rows.column(x).to_numpy() for x in ("token", "c1", "c"))
    order = np.argsort(tokens.view(np.uint64))
    tokens, c1, c = tokens.view(np.uint64)[order], c1[order].astype(float), c[order].astype(float)
    shared = spark.sparkContext.broadcast(tokens)

    def corpus(batches):
        """Documents of the whole corpus that hold each of the model's tokens and beginnings, then its documents, tokens and tokens outside the model."""
        known = shared.value
        directory = _directory(known)
        find = _Remembered(lambda spelled: _places(known, spelled, directory).astype(np.int32))
        total, ends = np.zeros(len(known), dtype=np.int64), np.zeros(3, dtype=np.int64)
        mark = np.empty(len(known) + 1, dtype=np.int32)  # the last one is for -1
        for batch in batches:
            for at, rows in _tokens(batch.column(0), find):
                outside = (at < 0).all(axis=1)
                seen = np.empty(len(at), dtype=np.int32)
                for row in rows:
                    held = _distinct(at[_distinct(row, seen)].ravel(), mark)
                    total[held[held >= 0]] += 1
                    ends += (1, len(row), outside[row].sum())
        total = np.concatenate([total, ends])
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 100_000):
            part = seen[k : k + 100_000]
            yield table(["at", "n"], [part, total[part]], [pa.int64(), pa.int64()])

    held = docs.select(F.col(text).alias("text")).mapInArrow(lean(corpus), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a token of the model
    shared.destroy()
    spread = np.zeros(len(tokens) + 3)
    spread[held.column("at").to_numpy()] = held.column("n").to_numpy()
    share = (spread[:-3] + 0.5) / (spread[-3] + 1)
    outside = float((spread[-1] + 0.5) / (spread[-2] + 1))
    prior = 4.0  # documents' worth of prior, at the corpus's own rate
    p1, p0 = (c1 + prior * share) / (n1 + prior), (c - c1 + prior * share) / (n0 + prior)
    odds = np.log(p1 / (1 - p1 + 1e-9)) - np.log(p0 / (1 - p0 + 1e-9))
    z = odds / np.sqrt(1 / (c1 + prior * share) + 1 / (c - c1 + prior * share))
    shrunk = odds * z**2 / (z**2 + 9.0)
    model = Model(tokens, np.clip(shrunk, -4.0, 8.0) - DRIFT, -DRIFT, 1.0, 0.0, np.array([-9.0, 0.0, 0.0]))
    shared_model = spark.sparkContext.broadcast(model)

    def chance(batches):
        """How often each of the model's tokens and beginnings is the one that counts."""
        m = shared_model.value
        find = _Remembered(m.places)
        total = np.zeros(len(m.tokens), dtype=np.int64)
        for batch in batches:
            for at, rows in _tokens(batch.column(0), find):
                for row in rows:
                    np.add.at(total, at[row][at[row] >= 0], 1)
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 100_000):
            part = seen[k : k + 100_000]
            yield table(["at", "n"], [part, total[part]], [pa.int64(), pa.int64()])

    counted = learn.where("y = 0").select("text").mapInArrow(lean(chance), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a token of the model
    model.lam = _decay(model.scores[counted.column("at").to_numpy()], counted.column("n").to_numpy(), outside)  # chance is what other documents hold

    def raw(batches):
        known = _Remembered(shared_model.value.token_scores)
        for batch in batches:
            out = []
            for scores in _token_scores(batch.column(0), known):
                out.append(([s for _, _, s in segments(scores)], len(scores)))
            yield table(["y", "s", "n"], [batch.column(1), [x[0] for x in out], [x[1] for x in out]], [pa.int32(), pa.list_(pa.float64()), pa.int64()])

    scored = check.select("text", F.col("y").cast("int").alias("y")).mapInArrow(lean(raw), "y int, s array<double>, n long").collect()  # SAMPLE_ROWS at most
    shared_model.destroy()
    sample.unpersist()
    excess = [model.lam * max(r.s) - math.log(r.n) for r in scored if r.y == 0 and r.s]
    model.log_k = (float(np.mean(excess)) - 0.5772) if excess else 0.0  # the mean of a Gumbel variable
    x = np.array([features(*model.evidence([(0, 0, s) for s in r.s], r.n)[:2]) for r in scored] or np.zeros((0, 3)))
    y = np.array([float(r.y) for r in scored])
    model.weights = _logistic(x, y)
    return model


def _decay(scores: np.ndarray, share: np.ndarray, outside: float) -> float:
    """lambda > 0 with E[exp(lambda score)] = 1 over chance tokens, which have these scores as often as `share` says; a part `outside` of them, counted in the corpus, is not in the model and scores the drift."""
    weight = share * (1 - outside) / max(share.sum(), 1e-9)
    low, high = 1e-3, 8.0
    for _ in range(60):
        lam = (low + high) / 2
        value = float((weight * np.exp(lam * scores)).sum() + outside * math.exp(-lam * DRIFT))
        low, high = (lam, high) if value < 1 else (low, lam)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; one kind of label alone gives a constant."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -9.0 if not len(y) or y.max() == 0 else 9.0
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(m: Model, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Of a text's token scores: its probability, its best segment's excess and all of its segments."""
    found = segments(scores)
    best, total, _ = m.evidence(found, len(scores))
    return m.probability(best, total), best, found


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_tokens, best, passages) of every whole text.

    passages: the significant segments, array of (start, end, score, expected)
    in tokens. Null and empty texts have no tokens and score by that. Null ids
    and repeated rows are scored like others; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "n_tokens", "best", "passages"]
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def scan(batches):
        m = shared.value
        known = _Remembered(m.token_scores)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for h in _token_scores(batch.column(1), known):
                probability, best, found = _evidence(m, h)
                told = []
                for a, b, s in found:
                    e = math.exp(min(700.0, m.log_k + math.log(max(len(h), 1)) - m.lam * s))
                    if e <= SIGNIFICANT:
                        told.append({"start": a, "end": b, "score": s, "expected": e})
                for column, x in zip(out, (probability, len(h), best, told), strict=True):
                    column.append(x)
            yield table(names, [batch.column(0), *out], [pa.int64(), pa.float64(), pa.int64(), pa.float64(), passage])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(scan), "doc_id long, score double, n_tokens long, best double, passages array<struct<start:int,end:int,score:double,expected:double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`. Rows are judged one by one, whatever their ids; narrow, no join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def sift(batches):
        m = shared.value
        known = _Remembered(m.token_scores)
        for batch in batches:
            yield batch.filter(pa.array([_evidence(m, h)[0] < threshold for h in _token_scores(batch.column(place), known)], type=pa.bool_()))

    return docs.mapInArrow(lean(sift), docs.schema)
