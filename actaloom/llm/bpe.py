"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: backtracking encoder. An Aho-Corasick automaton over the vocabulary finds the
longest token at every position of a piece; a token is taken if it is compatible with the
token before it, that is, if merging both texts by the tokenizer's rules would leave the
boundary between them; else the next shorter token is tried, and a dead end steps back.
Every position is given up at most once, so the work is linear, and the tokens are exactly
those of the merge rules. Compatibility is kept in a table that fills as pairs occur.
Decoding goes through one string of bytes and a table of offsets.

The pieces (words with their blank, numbers, signs, white space) repeat; each worker keeps
the ids of those it met lately, and of whole runs between single blanks, at most `PIECES` of
each. The vocabulary has a fixed size and is read from `path` by each
worker once.

Defined cases: null and empty texts give an empty list; special tokens' strings are
ordinary text; lone surrogates count as the replacement character.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.session import spread

#: Pieces whose ids a worker keeps; characters of the longest one, so that they take some 100 MB at most.
PIECES, LONGEST = 300_000, 64
#: White space by Unicode's property.
SPACE = "\t-\r \x85\xa0  -     　"

#: Several blanks together, with the white space around them and the run that follows.
WIDE = re.compile(f"([{SPACE}]*  [{SPACE}]*[^{SPACE}]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def category(kind: str) -> str:
    """A regular expression's class body for all characters whose category starts with `kind`."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    spans = []
    for _, g in groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [c for _, c in g]
        spans.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(spans)


@lru_cache(1)
def pieces() -> re.Pattern[str]:
    """The pre-tokenisation of byte-level BPE."""
    letter, number = category("L"), category("N")
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Piece -> its ids as little-endian 32-bit integers; unknown pieces are encoded and kept."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_letters()
        plain = lambda t: "".join(chr(to_byte[c]) for c in t)
        self.ids = {plain(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.ids[plain(a)], self.ids[plain(b)]): r for r, (a, b) in enumerate(merges)}
        size = max(self.ids.values()) + 1
        self.text = [""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        #: The two tokens that a token is merged from, and the rank of that merge.
        self.halves: list[tuple[int, int, int] | None] = [None] * size
        for (a, b), r in self.rank.items():
            i = self.ids[self.text[a] + self.text[b]]
            if self.halves[i] is None:
                self.halves[i] = (a, b, r)
        self.auto = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.auto.add_word(t, (len(t), i))
        self.auto.make_automaton()
        #: The longest token that is a proper prefix of a token, -1 if there is none.
        self.shorter = [-1] * size
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.pairs: dict[int, bool] = {}
        self.runs = Runs(self)
        data = [t.encode("latin-1") for t in self.text]
        self.offsets = np.cumsum([0, *map(len, data)])
        self.data = b"".join(data)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge of a token's merge tree, each with the rank of the merge that takes it up."""
        out, taken = [(token, float("inf"))], self.halves[token]
        while taken is not None:
            out.append((taken[side], taken[2]))
            taken = self.halves[taken[side]]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the boundary between tokens a and b outlives all merges within and across them."""
        if (known := self.pairs.get(a << 20 | b)) is not None:
            return known
        left, right = self.spine(a, 1), self.spine(b, 0)
        get, ok = self.rank.get, True
        for x, until in left:
            for y, before in right:
                r = get((x, y))
                if r is not None and r < until and r <= before:  # on equal rank the left place merges first
                    ok = False
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[a << 20 | b] = ok
        return ok

    def encode(self, piece: str) -> list[int]:
        """The ids of one piece given as Latin-1 letters for its bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (size, token) in self.auto.iter(piece):
            longest[end - size + 1] = token
        out, at, dead, end = [], 0, set(), len(piece)
        token, text, fits, shorter = longest[0], self.text, self.compatible, self.shorter
        while at < end:
            after = at + len(text[token])
            if after not in dead and (not out or fits(out[-1], token)):
                out.append(token)
                at = after
                token = longest[at] if at < end else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= len(text[token])
        return out

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        raw = np.array(self.encode(piece.encode("utf-8", "replace").decode("latin-1")), "<i4").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = raw
        return raw

    def ids_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = []
        for k, part in enumerate(WIDE.split(text) if "  " in text else (text,)):
            if k % 2:
                out += map(self.__getitem__, pieces().findall(part))
            else:  # a single blank always begins a piece
                first, *rest = part.split(" ")
                out += map(self.__getitem__, pieces().findall(first))
                out += map(self.runs.__getitem__, rest)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, by the offsets of the tokens' bytes."""
        at = self.offsets
        return b"".join(self.data[at[i] : at[i + 1]] for i in ids).decode("utf-8", "replace")


class Runs(dict):
    """Text between two single blanks -> the ids of it and the blank before it."""

    def __init__(self, owner: Encoder) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, run: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        raw = b"".join(map(self.owner.__getitem__, pieces().findall(" " + run)))
        if len(run) <= LONGEST:
            self[run] = raw
        return raw


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row, in array<int>; narrow, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_path())  # found by the worker itself
        for b in batches:
            raw = [enc.ids_of(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, raw)]) // 4
            ids = pa.array(np.frombuffer(b"".join(raw), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["key", "ids"])

    out = spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    enc = encoder(path)
    return [len(enc.ids_of(t)) // 4 for t in texts]


def decode_corpus(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the inverse of encode_corpus; null and empty lists give an empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_path())  # found by the worker itself
        for b in batches:
            texts = [enc.decode(np.array(v or [], np.int64)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
