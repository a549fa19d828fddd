"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(docs: dict[int, str | None], n: int, percent: int = 80) -> dict[int, int]:
    sets = {i: shingles(t, n) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in docs}


def removed(docs: dict[int, str | None], width: int = 13) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed and kept words by document."""
    first: dict[tuple[bytes, ...], int] = {}
    split = {i: words(t) for i, t in docs.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k : k + width]), i)
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def removed_rows(rows: list[tuple[int, str | None]], width: int = 13) -> list[tuple[int, tuple[int, int, str]]]:
    """The same for rows whose ids may repeat: a window goes if it also starts in a row with a smaller id."""
    first: dict[tuple[bytes, ...], int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = [x.decode() for x in words(t)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
