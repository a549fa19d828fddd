"""Words and their hashes for whole batches of texts at once, on the bytes of an Arrow array.

A word is a run of bytes other than white space `[\\x20\\x09-\\x0D]`. Its hash is a
polynomial of its bytes modulo 2**64, then mixed; nothing depends on the
process, so hashes agree between tasks, runs and machines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes worked on at once; each needs about 30 bytes of memory.
ROUND_BYTES = 1 << 19
#: Characters hashed at once; each needs about 40 bytes of memory, also in texts longer than ROUND_BYTES.
HASH_CHARS = 1 << 17
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(2) + U(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) | U(1)


def _finished(polynomial: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(polynomial + length.astype(U) * U(0xA0761D6478BD642F))


@dataclass
class Words:
    """`data`: the bytes; word i is data[start[i]:end[i]]; text t has words offset[t] to offset[t + 1] - 1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=U)
        length = self.end - self.start
        powers = np.full(int(length.max()), U(_BASE[which]))
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        ends = np.cumsum(length)
        out = np.empty(len(length), dtype=U)
        a = 0
        while a < len(length):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + HASH_CHARS)))
            size, first = length[a:b], ends[a:b] - length[a:b] - before
            at = np.arange(int(ends[b - 1]) - before) - np.repeat(first, size)
            chars = self.data[at + np.repeat(self.start[a:b], size)].astype(U)
            chars += U(1)
            chars *= powers[at]
            out[a:b] = np.add.reduceat(chars, first)
            a = b
        return _finished(out, length)

    def beginnings(self, some: np.ndarray, whole: np.ndarray, lengths: range) -> np.ndarray:
        """A row for each of the words `some`, whose hashes are `whole`: that hash, then those of its first so many characters; where it has fewer, its own again."""
        out = np.repeat(whole[:, None], 1 + len(lengths), axis=1)
        new = (self.data & 0xC0) != 0x80
        begins, upto = np.append(np.flatnonzero(new), len(self.data)), np.cumsum(new)  # of characters
        powers = np.full(4 * max(lengths), U(_BASE[1]))
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        for a in range(0, len(some), HASH_CHARS // max(lengths)):
            part = some[a : a + HASH_CHARS // max(lengths)]
            start = self.start[part]
            first, last = upto[start] - 1, upto[self.end[part] - 1]
            size = begins[np.minimum(first + max(lengths), last)] - start
            upon = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(upon, size)
            sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum((self.data[at + np.repeat(start, size)].astype(U) + U(1)) * powers[at], dtype=U)])
            for j, n in enumerate(lengths, 1):  # a beginning's polynomial is a difference of two running sums
                long = np.flatnonzero(first + n <= last)
                size = begins[first[long] + n] - start[long]
                out[a + long, j] = _finished(sums[upon[long] + size] - sums[upon[long]], size)
        return out

    def of_word(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text bounds; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(bounds):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTERS = np.ones(256, dtype=bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def find(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """Words of each text. lower: A-Z become a-z. letters: only ASCII letters, digits and bytes from 128 on make words."""
    data, bounds = buffers(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~(_LETTERS if letters else SPACE)[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(data))]  # a text's end ends its last word
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(starts)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of `width` hashes, by where it starts; runs over a text's end have to be left out by the caller."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=U)
    for j, c in enumerate(odd_numbers(width, seed)):
        out += hashes[j : j + n] * c
    return mix(out)


def windows_of(words: Words, hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all texts one after another and each text's bounds in them."""
    count = np.maximum(0, np.diff(words.offset) - width + 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) + np.repeat(words.offset[:-1] - bounds[:-1], count)
    return windows(hashes, width, seed)[at], bounds
