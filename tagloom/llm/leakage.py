"""Passages of held-out items inside a large corpus (problem 9)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scripts without spaces between words (kana, Chinese characters, Thai, Lao, Khmer): every character counts as a word.
UNSPACED = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = 5  # a passage of n >= 12 words with n // 8 errors at most has a run of so many words that are kept: (n - e) / (e + 1) > 4 for every n


def _grams(stream: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of a stream of code points, put together from those of halves, quarters and so on."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    power, factor, size = stream.astype("uint64"), BASE, 1
    out, done = None, 0
    while True:
        if q & size:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * (factor | np.uint64(2)) + piece
            done += size
        if done == q:
            break
        power = power[: len(power) - size] * factor + power[size:]
        size *= 2
        with np.errstate(over="ignore"):
            factor = factor * BASE
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@functools.cache
def _in_words() -> np.ndarray:
    """For each code point whether it stands in words."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, bool)
    for m in re.finditer(r"[^\W_]+", every):
        out[m.start() : m.end()] = True
    return out


def _stream(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edit_distance(a: list[str], b: list[str], band: int) -> int:
    """Words to replace, add or leave out between a and b, worked out in a band round the diagonal; band + 1 if more."""
    if abs(len(a) - len(b)) > band:
        return band + 1
    common = set(a).intersection(b)
    if max(sum(w not in common for w in a), sum(w not in common for w in b)) > band:
        return band + 1
    row = {j: j for j in range(min(len(b), band) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            best = row.get(j, band) + 1
            if j:
                best = min(best, new.get(j - 1, band) + 1, row.get(j - 1, band) + (a[i - 1] != b[j - 1]))
            new[j] = best
        row = new
    return min(row.get(len(b), band + 1), band + 1)


def reaches(a: list[str], b: list[str], most: int) -> list[int]:
    """For 0 to most errors, how many words of a at its beginning, the last one kept, go with the beginning of b; by the furthest place on each diagonal."""

    def slide(i: int, d: int) -> int:
        while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
            i += 1
        return i

    row = {0: slide(0, 0)}
    out = [row[0]]
    for e in range(1, most + 1):
        new, best = {}, out[-1]
        for d in range(-e, e + 1):
            begin = min(max(row.get(d, -9) + 1, row.get(d - 1, -9), row.get(d + 1, -9) + 1), len(a), len(b) - d)
            if begin >= max(0, -d):
                new[d] = slide(begin, d)
                best = max(best, new[d]) if new[d] > begin else best
        out.append(best)
        row = new
    return out


class Index:
    """Every stride-th q-gram of some items, by hash, with a table that most other hashes fail."""

    def __init__(self, q: int, parts: list[tuple[int, np.ndarray]]):
        self.q = q
        h = np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.entry = order.astype("int32")
        self.shift = np.uint64(64 - min(26, max(18, len(h).bit_length() + 4)))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.hash >> self.shift] = True

    def hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the stream, entry) of every shared q-gram."""
        h = _grams(stream, self.q)
        at = np.flatnonzero(self.table[h >> self.shift])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.entry[rows]


class Items:
    """The held-out items with indexes of their q-grams.

    A passage of n words with e errors keeps n - e words in at most e + 1 exact runs, so one run has RUN words or more
    and shares with the item the letters of that run - (q - 1) q-grams. Of an item whose shortest such run has L
    letters every stride-th q-gram is indexed, stride being L - q + 1 at most, so that no run is without one; bound,
    the least number of indexed q-grams of such a run, is what a band of diagonals must hold. Bands overlap by half.
    Items with a run of fewer letters than q, as in scripts without spaces, have an index of shorter q-grams.
    """

    def __init__(self, rows: list[tuple[int, str]], q: int = 10, min_words: int = 12, per: int = 8, stride: int = 4):
        self.min_words, self.per = min_words, per
        self.ids, self.words, starts, letters = [], [], [], []
        strides, bounds, parts = [], [], {}
        for item, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) < min_words:
                continue
            start = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            shortest = int((start[RUN:] - start[:-RUN]).min())
            own = q if shortest >= q else RUN
            step = min(stride, shortest - own + 1)
            stream = _stream("".join(words))
            parts.setdefault(own, []).append((len(self.ids), _grams(stream, own)[::step]))
            strides.append(step)
            bounds.append(max(1, (shortest - own + 1) // step))
            self.ids.append(item)
            self.words.append(words)
            starts.append(start)
            letters.append(stream)
        self.stride, self.bound = np.array(strides, int), np.array(bounds, int)
        self.starts = starts
        gap = np.array([len(x) + 2 for x in letters], int)  # items apart in one coordinate, so that none reaches into another
        self.base = np.cumsum(gap) - gap + 1
        self.flat_starts = np.concatenate([s + b for s, b in zip(starts, self.base, strict=True)]) if starts else np.zeros(0, int)
        self.letters = np.zeros(int(gap.sum()) + max(strides, default=1), "uint32")  # runs are extended by up to stride - 1 letters, beyond the end of the last item too
        for b, x in zip(self.base, letters, strict=True):
            self.letters[b : b + len(x)] = x
        self.indexes = []
        for own, group in sorted(parts.items()):
            owner = np.concatenate([np.full(len(h), i, "int32") for i, h in group])
            place = np.concatenate([np.arange(len(h), dtype="int32") * self.stride[i] for i, h in group])
            self.indexes.append((Index(own, group), owner, place))

    def runs(self, stream: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, first word, last word + 1, place of the first word in the stream) of every exact run of RUN words or more, from bands that reach the bound."""
        found = []
        for index, owners, places in self.indexes:
            at, entry = index.hits(stream)
            owner, place = owners[entry].astype("int64"), places[entry].astype("int64")
            diagonal = at - place
            key = owner * (np.int64(1) << 40) + diagonal // 64 + (1 << 20)
            bands, back, n = np.unique(key, return_inverse=True, return_counts=True)
            before = np.where(np.diff(bands, prepend=-9) == 1, np.concatenate([[0], n[:-1]])[: len(n)], 0)
            after = np.where(np.diff(bands, append=-9) == 1, np.concatenate([n[1:], [0]])[: len(n)], 0)
            full = (n + np.maximum(before, after) >= self.bound[bands >> 40])[back] if len(n) else np.zeros(0, bool)
            owner, place, at, diagonal = owner[full], place[full], at[full], diagonal[full]
            order = np.lexsort((at, diagonal, owner))
            owner, place, at, diagonal = owner[order], place[order], at[order], diagonal[order]
            if not len(at):
                continue
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) != self.stride[owner[1:]])) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
            owner, first, last, begin = owner[lo], self.base[owner[lo]] + place[lo], self.base[owner[lo]] + place[hi] + index.q, at[lo]
            reach = int(self.stride.max()) - 1
            i0, i1 = self._whole(first - reach, last + reach)
            keep = i1 - i0 >= RUN
            owner, first, last, begin = owner[keep], first[keep], last[keep], begin[keep]
            for k in range(1, reach + 1):  # what the indexed q-grams leave open at both ends
                if k == 1:
                    left, right = np.ones(len(begin), bool), np.ones(len(begin), bool)
                    first0, last0, begin0, end0 = first.copy(), last.copy(), begin.copy(), begin + last - first
                left &= (begin0 >= k) & (self.letters[first0 - k] == stream[np.maximum(begin0 - k, 0)]) & (self.letters[first0 - k] > 0)
                right &= (end0 + k <= len(stream)) & (self.letters[last0 + k - 1] == stream[np.minimum(end0 + k, len(stream)) - 1]) & (self.letters[last0 + k - 1] > 0)
                first, begin, last = first - left, begin - left, last + right
            i0, i1 = self._whole(first, last)
            keep = i1 - i0 >= RUN
            found.append((owner[keep], i0[keep], i1[keep], begin[keep] + self.flat_starts[i0[keep]] - first[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros((4, 0), int))

    def _whole(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words, as places among all starts, that lie wholly between two letters."""
        return np.searchsorted(self.flat_starts, first, "left"), np.searchsorted(self.flat_starts, last, "right") - 1

    def holds(self, words: list[str], starts: np.ndarray, item: int, i0: int, i1: int, place: int) -> bool:
        """True if the run of the item's words i0 to i1, which stands at place in the document, is part of a passage.

        It is extended to both sides by banded alignment, by as many words as each number of errors allows; a passage
        begins and ends with kept words.
        """
        s, own = self.starts[item], self.words[item]
        if i1 - i0 >= self.min_words:
            return True
        w0, w1 = int(np.searchsorted(starts, place, "left")), int(np.searchsorted(starts, place + int(s[i1] - s[i0]), "left"))
        most = len(own) // self.per
        left = reaches(own[:i0][::-1], words[max(0, w0 - i0 - most) : w0][::-1], most)
        right = reaches(own[i1:], words[w1 : w1 + len(own) - i1 + most], most)
        lengths = ((x + y, left[x] + i1 - i0 + right[y]) for x in range(most + 1) for y in range(most + 1 - x))
        return any(n >= self.min_words and e <= n // self.per for e, n in lengths)


def _block(documents: DataFrame, items: Items, key: str, text: str, chars: int = 4_000_000) -> DataFrame:
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(items)  # size bounded by the block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        first_word = np.concatenate([[0], np.cumsum([len(w) + 1 for w in items.words])]).astype(int)
        for b in batches:
            keys, texts = b["key"].tolist(), b["text"].tolist()
            rows: dict[tuple, None] = {}
            lo = 0
            while lo < len(texts):
                hi, size, streams = lo, 0, []
                while hi < len(texts) and (size < chars or hi == lo):
                    streams.append((texts[hi] or "").lower())
                    size += len(streams[-1])
                    hi += 1
                whole = _stream("\0".join([*streams, ""]))
                apart = np.cumsum([len(s) + 1 for s in streams]) - 1
                kept = _in_words()[whole]
                kept[apart] = True  # the sign between two texts stays and equals no letter
                ends = np.cumsum(kept)[apart]
                owner, i0, i1, place = items.runs(whole[kept])
                doc = np.searchsorted(ends, place, "right")
                at, words, starts = -1, [], np.zeros(0)
                for k in np.argsort(doc, kind="stable").tolist():
                    d, item = int(doc[k]), int(owner[k])
                    found = (keys[lo + d], items.ids[item])
                    if found in rows:
                        continue
                    if d != at:
                        at, words = d, WORD.findall(texts[lo + d].lower())
                        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                    if items.holds(words, starts, item, int(i0[k] - first_word[item]), int(i1[k] - first_word[item]), int(place[k] - (ends[d - 1] if d else 0))):
                        rows[found] = None
                lo = hi
            yield pd.DataFrame(list(rows), columns=["key", "item_id"])

    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("length(text) > 0").mapInPandas(run, f"key {kind}, item_id long")
    return out.withColumnRenamed("key", key)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = 60_000_000) -> DataFrame:
    """(key, item_id): documents that hold a passage of at least twelve words in a row of an item, one word in eight wrong at most.

    Case, punctuation and white space don't count; in scripts without spaces every character is a word. The corpus is
    read in one pass without a shuffle for every block characters of items, the stated query set; an index takes some
    five bytes a character of its block in every worker. Repeated documents come out each; null, empty and blank texts on either side give
    nothing, as do items shorter than a passage.
    """
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    n = max(1, -(-size // block))
    out = None
    for i in range(n):
        rows = items.select(item_key, item_text).filter(f"{item_text} is not null and pmod(xxhash64({item_key}), {n}) = {i}").collect()
        part = _block(documents, Items([(r[0], r[1]) for r in rows]), key, text)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
