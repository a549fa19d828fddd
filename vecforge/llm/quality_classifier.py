"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],
the sum-of-squares identity, so all pairwise interactions cost time linear in
a text's features. Metadata are numeric columns that the caller names, each a
squashed value and a mark for nulls. Fitted on the driver on a bounded sample of labelled
documents; scoring reads every whole text, in batches, with a broadcast model
of fixed size (FEATURES * (FACTORS + 1) numbers, and two columns a name).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import lean, rounds, small_batches, table
from .toxicity import _labelled

#: Labelled rows that a model is fitted on, at most, by hash order of their ids.
SAMPLE_ROWS = 8_000
HASHED, FACTORS = 1 << 14, 6
#: Structure statistics, each 0 to about 1.
STATISTICS = ("words", "chars", "word_length", "symbols", "capitals", "digits", "bars", "exclaims", "repeats", "variety", "lines", "line_repeats", "stops", "beyond_ascii", "longest_run", "empty")
FEATURES = HASHED + len(STATISTICS)
_KINDS = {"symbols": b"#*$%&|<>~^@_=+\\{}[]", "digits": b"0123456789", "bars": b"|", "exclaims": b"!?", "stops": b".,;:"}


def _kind_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_TABLES = {k: _kind_table(v) for k, v in _KINDS.items()} | {"capitals": _kind_table(bytes(range(65, 91))), "beyond_ascii": _kind_table(bytes(range(128, 256)))}


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bounds, index, value) of hashed words and the dense statistics, one row a text.

    A word's value is its share of the text's words, square-rooted.
    """
    found = W.find(texts)
    data, n = found.data, len(texts)
    hashes = found.hashes()
    _, bounds = W.buffers(texts)
    size, words = np.diff(bounds), np.diff(found.offset)
    per = np.maximum(words, 1)
    sums = {k: np.diff(np.concatenate([[0], np.cumsum(t[data])])[bounds]) / np.maximum(size, 1) for k, t in _TABLES.items()}
    doc = found.of_word()
    distinct = np.bincount(np.unique(np.stack([doc.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64), minlength=n) if len(hashes) else np.zeros(n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[bounds]) + 1
    dense = np.zeros((n, len(STATISTICS)))
    chars = np.bincount(doc, weights=found.end - found.start, minlength=n)
    starts = np.flatnonzero(~same)
    run = np.diff(np.concatenate([starts, [len(hashes)]]))
    longest = np.zeros(n)
    if len(starts):
        np.maximum.at(longest, doc[starts], run)
    values = {
        "words": np.log1p(words) / 10, "chars": np.log1p(size) / 12, "word_length": np.minimum(chars / per / 20, 1), "repeats": np.bincount(doc, weights=same, minlength=n) / per,
        "variety": distinct / per, "lines": np.minimum(lines / per, 1), "longest_run": np.log1p(longest) / 5, "empty": (words == 0).astype(float),
    } | {k: np.minimum(1, 5 * v) for k, v in sums.items()}
    values["line_repeats"] = _line_repeats(texts)
    for j, name in enumerate(STATISTICS):
        dense[:, j] = values[name]
    key = doc.astype(np.int64) * HASHED + (hashes & np.uint64(HASHED - 1)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row = key // HASHED
    return np.searchsorted(row, np.arange(n + 1)), key % HASHED, np.sqrt(count / per[row]), dense


def with_metadata(dense: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    """The dense statistics and, for each metadata column, a value between -1 and 1 or so and a mark for a null."""
    out = [dense]
    for c in columns:
        x = np.nan_to_num(np.asarray(pc.fill_null(c.cast(pa.float64()), 0.0)))
        out += [(np.sign(x) * np.log1p(np.abs(x)) / 12)[:, None], np.asarray(c.is_null()).astype(float)[:, None]]
    return np.concatenate(out, axis=1)


def _line_repeats(texts: pa.Array) -> np.ndarray:
    """Share of lines that a text has had before."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts.to_pylist()):
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip()]
            out[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # FEATURES
    v: np.ndarray  # FEATURES x FACTORS
    metadata: tuple[str, ...] = ()

    def logits(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        one, two, linear = np.zeros((n, FACTORS)), np.zeros((n, FACTORS)), np.zeros(n)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            vx = self.v[index] * value[:, None]
            at = bounds[some]
            one[some], two[some] = np.add.reduceat(vx, at), np.add.reduceat(vx**2, at)
            linear[some] = np.add.reduceat(self.w[index] * value, at)
        vd = self.v[HASHED:]
        one += dense @ vd
        two += dense**2 @ vd**2
        return self.bias + linear + dense @ self.w[HASHED:] + 0.5 * (one**2 - two).sum(axis=1)


def train(bounds: np.ndarray, index: np.ndarray, value: np.ndarray, dense: np.ndarray, y: np.ndarray, epochs: int = 12, seed: int = 1, rate: float = 0.08, ridge: float = 2e-4) -> Machine:
    """Adagrad on the logistic loss in batches of 64; without labels of both kinds a constant."""
    rng = np.random.default_rng(seed)
    wide = np.arange(HASHED, HASHED + dense.shape[1])
    size = HASHED + len(wide)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        m.bias = 0.0 if not len(y) else 6.0 if y.max() else -6.0
        return m
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            count = np.diff(bounds)[some]
            at = np.repeat(bounds[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cut, idx, val, d = np.concatenate([[0], np.cumsum(count)]), index[at], value[at], dense[some]
            z = m.logits(cut, idx, val, d)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            row = np.repeat(np.arange(len(some)), count)
            vx = m.v[idx] * val[:, None]
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, row, vx)
            s += d @ m.v[wide]
            touched, inv = np.unique(idx, return_inverse=True)
            gw_s, gv_s = np.bincount(inv, weights=err[row] * val, minlength=len(touched)), np.zeros((len(touched), FACTORS))
            np.add.at(gv_s, inv, (err[row] * val)[:, None] * (s[row] - vx))
            gd_w = d.T @ err
            gd_v = d.T @ (err[:, None] * s) - (d**2).T @ err[:, None] * m.v[wide]
            for where, g1, g2 in ((touched, gw_s, gv_s), (wide, gd_w, gd_v)):
                g1, g2 = g1 + ridge * m.w[where], g2 + ridge * m.v[where]
                gw[where] += g1**2
                gv[where] += g2**2
                m.w[where] -= rate * g1 / np.sqrt(gw[where])
                m.v[where] -= 0.5 * rate * g2 / np.sqrt(gv[where])
            g = float(err.sum())
            gb += g**2
            m.bias -= rate * g / gb**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> Machine:
    """Learn from at most SAMPLE_ROWS labelled documents whose crc32(id) mod 5 is not 0; their features, not their texts, come to the driver."""

    def extract(batches):
        types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64())]
        for batch in batches:
            for a, b in rounds(batch.column(1), W.ROUND_BYTES):
                bounds, index, value, dense = features(batch.column(1).slice(a, b - a))
                dense = with_metadata(dense, [c.slice(a, b - a) for c in batch.columns[3:]])
                cut = [slice(bounds[i], bounds[i + 1]) for i in range(b - a)]
                yield table(["id", "y", "i", "x", "d"], [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), [index[c].astype(np.int32) for c in cut], [value[c].astype(np.float32) for c in cut], list(dense)], types)

    small_batches(docs.sparkSession)
    sample = _labelled(docs, labels, label, doc_id, text, SAMPLE_ROWS, metadata=metadata).drop("fold")
    rows = sample.mapInArrow(lean(extract), "id long, y int, i array<int>, x array<float>, d array<double>").toArrow().sort_by("id")
    index, value = (np.concatenate([np.zeros(0), *(np.asarray(v.values) for v in rows.column(c))]) for c in ("i", "x"))
    count = np.array([len(v) for v in rows.column("i")], dtype=np.int64)
    dense = np.array(rows.column("d").to_pylist()).reshape(len(count), len(STATISTICS) + 2 * len(metadata))
    model = train(np.concatenate([[0], np.cumsum(count)]), index.astype(np.int64), value.astype(float), dense, np.array(rows.column("y").to_pylist(), dtype=float))
    model.metadata = metadata
    return model


def score(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text. Null and empty texts score by their statistics; null ids and repeated rows like others; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            for a, b in rounds(batch.column(1), W.ROUND_BYTES):
                *words, dense = features(batch.column(1).slice(a, b - a))
                z = shared.value.logits(*words, with_metadata(dense, [c.slice(a, b - a) for c in batch.columns[2:]]))
                yield table(["doc_id", "score"], [batch.column(0).slice(a, b - a), 1 / (1 + np.exp(-np.clip(z, -30, 30)))], [pa.int64(), pa.float64()])

    told = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *[docs[c].cast("double") for c in model.metadata])
    return told.mapInArrow(lean(scan), "doc_id long, score double")
