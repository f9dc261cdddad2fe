"""Byte-pair encoding of whole texts with a public vocabulary, by backtracking over longest matches (problem 8)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TAGLOOM_TOKENIZERS", "/opt/tokenizers")
# fixed value: how the vocabulary's texts are cut before merging
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_LIMIT = 200_000


class Encoder:
    """Exact merges of a ranked vocabulary without running the merge loop.

    The longest token at every place comes from one Aho-Corasick pass over the reversed piece. The encoder walks
    forward with the longest token that is compatible with the token before it and steps back where none is. Two
    tokens are compatible when merging would never join across their border, which the table of each token's last
    merge decides; answers are kept in a pair table. Decoding slices one string of all tokens by an offset table.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f)
            self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.all_bytes = b"".join(self.tokens)
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.left = list(range(len(self.tokens)))
        self.right = list(range(len(self.tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.ids.values()):
            self._split(i)
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.machine = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.machine.add_word(t[::-1].decode("latin-1"), (len(t), i))
        self.machine.make_automaton()
        self.cut = regex.compile(CUT)
        self.pieces = Pieces(self)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), -1)

    def _split(self, i: int) -> None:
        """Find the last merge that makes token i; single bytes stay as they are."""
        token, a = self.tokens[i], self.shorter[i]
        while a >= 0:
            b = self.ids.get(token[len(self.tokens[a]) :], -1)
            if 0 <= b < i and a < i and self._stable(a, b):
                self.left[i], self.right[i] = a, b
                self.merged[a, b] = i
                return
            a = self.shorter[a]

    def _stable(self, a: int, b: int) -> bool:
        """True if the merge loop leaves the border between tokens a and b alone: undo their merges latest first and look for an earlier merge across the border."""
        left, right, limit = self.left, self.right, 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            a_base, b_base = left[a] == a, left[b] == b
            if a_base and b_base:
                return True
            if b_base or (a > b and not a_base):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pair_ok.get((a, b))
        if ok is None:
            if len(self.pair_ok) > 4 * CACHE_LIMIT:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self._stable(a, b)
        return ok

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [(0, -1)] * n
        for end, found in self.machine.iter(data[::-1].decode("latin-1")):
            if found > longest[n - 1 - end]:
                longest[n - 1 - end] = found
        open_ = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                open_[at] = False
                token = out.pop()
                at -= len(self.tokens[token])
        return out

    def raw(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(text or ""), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        o = self.offsets
        return b"".join(self.all_bytes[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


class Pieces(dict):
    """Ids of pieces met before; emptied when it has grown to CACHE_LIMIT."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE_LIMIT:
            self.clear()
        ids = self[piece] = np.asarray(self.encoder.piece(piece.encode()), "<i4").tobytes()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each whole text without special tokens, one row a row; null and empty texts give an empty list.

    One pass in Arrow batches, no shuffle; the vocabulary is read on the executors from path.
    """
    where = path or os.path.join(VOCABULARY, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where)
        for b in batches:
            coded = [e.raw(t) if t else b"" for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
