"""Line deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vecforge.llm import line_dedup

SCHEMA = "doc_id long, text string, variant string, line int, keep int, h1 int, n_lines int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark, texts, ids):
    return spark.createDataFrame([(i, t, "v", 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(rows, least, first, chars):
    """Of rows (id, text): (id, n_lines, n_dropped, kept); the order of an id's texts is told by `first`."""
    where = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and len(key(line)) >= chars:
                where[key(line)].append((i, t or "", k))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for k, line in enumerate(lines):
            x = where.get(key(line), []) if i is not None and len(key(line)) >= chars else []
            gone = len({j for j, _, _ in x}) >= least if x else False
            if gone and first and (i, t or "", k) == min(x):
                gone = False
            if not gone:
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pool = [f"line {k} of the pool" for k in range(60)] + ["", "  ", "\t", "x", "É", "中文", "Ab Cd", " ab cd\r", " wide"]
    texts = ["\n".join(rng.choice(pool[: rng.choice([5, 30, 69])]) for _ in range(rng.randrange(0, 30))) for _ in range(70)]
    texts += [None, "", "\n", "\n\n", "unique", "ab CD", "hot\n" * 3000 + "end", "y" * 100_000 + "\n  " + "Y" * 100_000, "y" * 100_000]
    out = list(enumerate(texts))
    out += [(k, f"hot\nline {k % 7}\nhot") for k in range(200, 330)]
    return out + [(None, "hot\nline 1 of the pool"), (None, None), out[3], out[3], *[out[10]] * 5]


def judged(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("least, first, chars", [(10, False, 1), (2, True, 1), (1, True, 3), (3, False, 6)])
@pytest.mark.parametrize("chunk", [64, line_dedup.CHUNK])
def test_equals_brute_force(spark, rows, least, first, chars, chunk, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)  # keys go over many chunks
    if chunk == 64:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(7)
    got = judged(line_dedup.deduplicate(docs, min_documents=least, keep_first=first, min_chars=chars))
    assert got == sorted(brute(rows, least, first, chars), key=str)


def test_one_id_with_two_texts_is_one_document(spark):
    rows = [(1, "a\nb"), (1, "a\nc"), (2, "b"), (3, "c\na"), (3, "a")]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    got = judged(line_dedup.deduplicate(docs, min_documents=2, keep_first=False))
    assert got == sorted(brute(rows, 2, False, 1), key=str)
    assert judged(line_dedup.deduplicate(docs, min_documents=3, keep_first=False)) == sorted(((i, t.count("\n") + 1, 0, t) for i, t in rows), key=str)


def test_bitmaps(spark, rows):
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    found = line_dedup.keep_bitmaps(docs, min_documents=10, keep_first=False).collect()
    assert len(found) == len({(r.doc_id, r.variant) for r in found}) > 100
    want = {i: (n, gone) for i, n, gone, _ in brute(rows, 10, False, 1)}
    for r in found:
        n, gone = want[r.doc_id]
        assert (~line_dedup.unpacked(r.keep, n)).sum() == gone > 0
    long = next(r for r in found if want[r.doc_id][0] == 3001)
    assert len(long.keep) < 40


def test_a_chunk_of_one_row_repeated():
    rows = [np.full(50, x, dtype=np.int64) for x in (1, 2, 3, 4, 0)]
    gone, still, counts = line_dedup.decided(rows, 2, True)
    assert not len(gone[0]) and [x.tolist() for x in still] == [[1], [2], [3], [4], [0]] and counts[5].tolist() == [1]


def test_many_repeats_of_one_row(spark):
    docs = table(spark, ["a\nb\na"] * 3000 + ["a", "b"], [5] * 3000 + [6, 7]).repartition(6)
    got = line_dedup.deduplicate(docs, min_documents=2, keep_first=True).groupBy("doc_id", "n_dropped", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(5, 1, "a\nb", 3000), (6, 1, "", 1), (7, 1, "", 1)]


def test_empty_tables(spark):
    assert line_dedup.deduplicate(table(spark, [], [])).collect() == []
    assert judged(line_dedup.deduplicate(table(spark, [None, None], [1, None]))) == [(1, 1, 0, ""), (None, 1, 0, "")]
    with pytest.raises(ValueError):
        line_dedup.deduplicate(table(spark, [], []), min_documents=0)
