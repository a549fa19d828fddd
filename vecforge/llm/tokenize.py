"""Exact, cached encoding of whole texts with the `tokenizers` library.

Running a BPE model over every word occurrence is the dominating cost of token
output, and most occurrences repeat. For two kinds of vocabulary files, told by
the rules that the file itself states, pre-tokens of plain Latin pieces are found here:
byte-level BPE that keeps white space, and BPE with word ends that drops it.
Neither merges across an ASCII space, so texts are cut at their spaces, the
equal pieces of some hundred texts are found and encoded once, from pre-tokens
that are remembered, and the ids of a text are put together from its pieces. A text in which a cut could change a whitespace run (two spaces in a
row, vocabulary that keeps white space only) or that holds an added token's
literal, such as <|endoftext|>, is encoded whole; of any other kind of file,
every text is. `tests/llm` compares every path with a fresh tokenizer.

Ids travel as little-endian unsigned 32-bit integers, ready for CRCs and files.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of other letters or with white space at an end that a worker remembers (about 150 bytes each, 15 MB); beyond it the memory starts anew.
CACHE_PIECES = 100_000
#: Pre-tokens of all others, so many at a time (80 MB with those before): when the memory is full it becomes the older one, from which those that are asked for again come over.
CACHE_WORDS = 250_000
#: Pieces longer than this are not worth remembering.
LONG_PIECE = 100
# The splitting rules of the two public kinds of vocabulary, as their files and the library state them.
KEPT_RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
DROPPED_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces of these characters alone are cut into pre-tokens here: no space but the line feed, no rare letters.
_PLAIN = re.compile("[\\n!-~À-ÿ]*")
#: Of these, those that white space neither begins nor ends. In a row of them each one's first pre-token begins with its space.
_TAME = re.compile("[!-~À-ÿ](?:[\\n!-~À-ÿ]*[!-~À-ÿ])?")
_ROW, _WILD = re.compile("[\\n -~À-ÿ]*"), ("  ", " \n", "\n ")
_KEPT = re.compile(f" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
#: With a token for a space, which has no ids.
_DROPPED = re.compile(f"[{_LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}0-9]+| ")
_ENCODERS: dict[str, "PieceEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable bytes as themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTES = _byte_letters()


_BIG = sys.byteorder == "big"


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian integers."""
    out = array("I", ids)
    if _BIG:
        out.byteswap()
    return out.tobytes()


def rule(path: str) -> str:
    """What is known of a file's splitting: `kept` or `dropped` white space, or nothing."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    told["model"] = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
    model, normal, pre = told["model"], told["normalizer"], told["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or told.get("post_processor") or told.get("truncation") or told.get("padding") or (normal is not None and any(x["normalized"] for x in told["added_tokens"])):
        return ""
    if normal is None and not model["end_of_word_suffix"] and KEPT_RULE.items() <= pre.items():
        return "kept"
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (normal or {}).get("normalizers", [])]
    cuts = [(x["type"], x.get("pattern"), x.get("invert"), x.get("behavior"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    if steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)] and cuts == [("Split", {"Regex": DROPPED_RULE}, True, "Removed", None, None), ("ByteLevel", None, None, None, False, False)]:
        return "dropped"
    return ""


class _Pieces(dict):
    """Ids by piece; a piece that is looked up for the first time is encoded."""

    def __init__(self, owner: "PieceEncoder"):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        got = self.owner.fresh(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


class _PreTokens(dict):
    """Ids by pre-token, of the model alone; `silent` has none."""

    def __init__(self, model, silent: str | None):
        super().__init__()
        self.model, self.silent, self.older = model, silent, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = b"" if word == self.silent else little_endian([t.id for t in self.model.tokenize(word.translate(_BYTES))])
        if len(word) <= LONG_PIECE:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class PieceEncoder:
    """Encodes texts; `path` is a tokenizers JSON file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole: the library takes it out before it looks for words.
        self.literals = tuple(x.content for x in self.tok.get_added_tokens_decoder().values() if x.content)
        told = rule(path)
        self.cuts = bool(told)
        # A vocabulary that keeps white space has a piece's leading space in its first token.
        self.keeps_space = told == "kept"
        self.model = self.tok.model
        self.lead = " " if self.keeps_space else ""
        self.pieces = _Pieces(self)
        self.words = _PreTokens(self.model, None if self.keeps_space else " ")

    def whole(self, text: str) -> bytes:
        """The plain way: the whole tokenizer on the whole text."""
        return little_endian(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def pre_tokens(self, text: str) -> list[str]:
        return _KEPT.findall(text) if self.keeps_space else _DROPPED.findall(text.lower())

    def fresh(self, piece: str) -> bytes:
        """Ids of a piece with its leading space, if it has one: the model alone on the pre-tokens of a plain Latin one."""
        body = piece[1:] if self.keeps_space and piece[:1] == " " else piece
        if not _PLAIN.fullmatch(body):
            return self.whole(piece)
        return b"".join(map(self.words.__getitem__, self.pre_tokens(piece)))

    def tame(self, row: str) -> pa.Array:
        """Ids of tame pieces in a row, each after a space."""
        words = self.pre_tokens(row)
        ids = list(map(self.words.__getitem__, words))
        ends = np.cumsum([0, *map(len, ids)])
        ends = ends[[*(k for k, w in enumerate(words) if w[0] == " "), len(words)]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(ids))])

    def distinct(self, pieces: list[str]) -> pa.Array:
        """Ids of pieces that follow a space; all tame ones are cut into pre-tokens in one go."""
        row = " " + " ".join(pieces)
        if _ROW.fullmatch(row) and not any(x in row + " " for x in _WILD):
            return self.tame(row)
        tame = np.array([x is not None for x in map(_TAME.fullmatch, pieces)])
        rest = pa.array([self.pieces[self.lead + p] for p in compress(pieces, ~tame)], pa.large_binary())
        if not tame.any():
            return rest
        first = self.tame(" " + " ".join(compress(pieces, tame)))
        return pa.concat_arrays([first, rest]).take(pa.array(np.where(tame, np.cumsum(tame) - 1, len(first) - 1 + np.cumsum(~tame))))

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each cut at its spaces; Arrow finds the distinct pieces and puts the ids of each text in a row."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        row = self.distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices)
        _, ends, data = row.buffers()
        flat, at = memoryview(data or b""), np.frombuffer(ends, np.int64)[np.asarray(cut.offsets)].tolist()
        return [flat[a:b].tobytes() for a, b in pairwise(at)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none."""
        collecting = gc.isenabled()
        gc.disable()  # many short-lived lists and no cycles
        try:
            out, at, rest = [b""] * len(texts), [], []
            for k, text in enumerate(texts):
                if not text:
                    continue
                if not self.cuts or any(x in text for x in self.literals) or self.keeps_space and "  " in text:
                    out[k] = self.whole(text)
                    continue
                if self.keeps_space:  # the first piece follows no space
                    first, space, text = text.partition(" ")
                    out[k] = self.fresh(first)
                    if not space:
                        continue
                at.append(k)
                rest.append(text)
            for k, ids in zip(at, self.together(rest) if rest else [], strict=True):
                out[k] += ids
            return out
        finally:
            if collecting:
                gc.enable()


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
