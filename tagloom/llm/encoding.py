"""Text decoded with the wrong character encoding: found line by line and restored where possible (problem 10)."""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïôöùûüÿœæßабвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"
SHOWN_AS = ["cp1252", "latin-1", "cp1251", "cp866", "koi8-r", "mac-roman", "cp437"]
WRITTEN_AS = ["utf-8", "cp1251", "cp866", "koi8-r", "cp1252"]
# Characters that correct texts of the five languages hardly have inside words.
ODD = r"\x80-\x9f¡-¦¨-ª¬-¯´¶¸-º¼¾¿À-ßð÷øý-þĂ-ſƒˆ˜Ђ-ЏѐђѓѕјљњћќўџѠ-҈‚†‡‰‹›€™�─-╿▀-▟■√⌠⌡∙"
# --------------------------------------------------------------------------------------------------
LOST_BYTE = "�"
K = len(LETTERS) + 6
SPACE, DIGIT, ASCII, SIGN, ODD_CHAR, LOST = range(len(LETTERS), K)


def _classes() -> np.ndarray:
    """The class of each code point up to U+FFFF: letters (without case), space, digit, ASCII sign, other sign, odd character, lost character."""
    table = np.full(65536, SIGN, "int16")
    table[32:127] = ASCII
    for c in map(chr, range(65536)):
        low = c.lower()
        if len(low) == 1 and low in LETTERS:
            table[ord(c)] = LETTERS.index(low)
    table[[9, 10, 13, 32, 0xA0]] = SPACE
    table[48:58] = DIGIT
    odd = re.compile(f"[{ODD}]")
    for i in range(128, 65536):
        if table[i] == SIGN and odd.match(chr(i)):
            table[i] = ODD_CHAR
    table[0x80:0xA0] = LOST
    table[0xFFFD] = LOST
    return table


CLASS = _classes()
CLEAN_LINE = re.compile(r"[A-Za-zäöüÄÖÜßàâçèéêëîïôùûœА-Яа-яЁёІіЇїЄєҐґ0-9 \t.,:;()/%°«»—–'’\"+\-=]*\r?")


def codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return CLASS[np.minimum(a, 65535)]


def pair_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """How often each class follows each class in the lines of all documents that hold ordinary characters only.

    Every partition sends one row a pair that occurs, at most K * K, whatever the size of the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K * K, "int64")
        for b in batches:
            kept = "\n".join(line for t in b["text"] if t for line in t.split("\n") if CLEAN_LINE.fullmatch(line) and not UPPER_INSIDE.search(line))
            c = codes(kept).astype("int32")
            if len(c) > 1:
                total += np.bincount(c[:-1] * K + c[1:], minlength=K * K)
        i = np.flatnonzero(total)
        yield pd.DataFrame({"pair": i.astype("int32"), "n": total[i]})

    rows = documents.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(K * K)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(K, K)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log of the smoothed chance of each class after each class; lost characters cost a flat 12, odd ones at least 6."""
    n = counts + 0.3 + 1e-5 * counts.sum(1, keepdims=True)
    c = -np.log(n / n.sum(1, keepdims=True))
    c[:, LOST] = 12.0
    c[:, ODD_CHAR] = np.maximum(c[:, ODD_CHAR], 6.0)
    return c.astype("float32")


UPPER_INSIDE = re.compile(r"[a-zà-öø-ÿа-яёіїєґ][A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ]{2}|[а-яёіїєґ][А-ЯЁІЇЄҐ][а-яёіїєґ]")
STRANGE = re.compile(f"[^\\W\\d_\x00-\x7f]|[{ODD}]")
SURE = re.compile(r"[\x80-\x84\x86-\x9f�]")  # no correct text has these characters
MARKS, INSIDE = re.compile(r"(?<![^\s(])\?{2,}"), re.compile(r"[^\W\d_]\?{2,}[^\W\d_]")
PLAIN = re.compile(f"(?i)[\x21-\x7e{LETTERS}°±²³µ·×«»—–‘’“”„…€№•§½¼″Øø≈≤≥→Δ�]+")
SAME = ("", 0.0, ())


def lost(line: str) -> bool:
    """True where letters of the line were lost: control or replacement characters, several question marks between letters, or words that begin with them.

    One such word of two or three may be meant, so it takes four question marks in a row, or several such words with half as many question marks as the line has letters.
    """
    if SURE.search(line):
        return True
    if "??" not in line:
        return False
    runs = MARKS.findall(line)
    many = len(runs) > 1 and 2 * sum(map(len, runs)) >= sum(c.isalpha() for c in line)
    return many or any(len(r) > 3 for r in runs) or INSIDE.search(line) is not None


class Repairer:
    """Best-first search over re-encodings of a word; the cost of its character pairs guides it to the cheapest text.

    It goes on only from readings that make the text cheaper, and ends with a plausible text or when none is left.
    depth bounds how often a text may have been read wrongly; the number of states isn't bounded.

    Words are what stands between plain spaces, so that sequences of bytes shown as no-break spaces stay whole. What
    was found for a word is kept, as the same words come again in many lines.
    """

    def __init__(self, cost: np.ndarray, depth: int = 3):
        self.cost, self.depth = cost, depth
        self.known: dict[str, tuple[str, float, tuple]] = {}

    def word_cost(self, w: str) -> float:
        k = codes(f" {w} ")
        return float(self.cost[k[:-1], k[1:]].sum()) + 4.0 * len(UPPER_INSIDE.findall(w))

    def steps(self, w: str, wide: bool) -> Iterator[tuple[str, tuple]]:
        """What the word becomes when one reading is undone; wide: one byte for one character too."""
        if "&" in w:
            yield html.unescape(w), ("html",)
        if "\\u" in w:
            yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), w), ("unicode",)
        for shown in SHOWN_AS:
            for written in WRITTEN_AS if wide else WRITTEN_AS[:1]:
                if shown != written and (new := reread(w, shown, written)) is not None and new != w:
                    yield new, (shown, written)

    def search(self, w: str) -> tuple[str, float, tuple]:
        """(the cheapest text, by how much it is cheaper, the steps to it); no steps where the word is sound."""
        start = self.word_cost(w)
        wide = len(STRANGE.findall(w)) > 1 and start > 3.9 * (len(w) + 1)
        best = (start, w, ())
        heap, seen = [(start, w, ())], {w}
        while heap:
            c, at, way = heapq.heappop(heap)
            if way and c < 3.3 * (len(at) + 1) and PLAIN.fullmatch(at):
                break
            if len(way) == self.depth:
                continue
            for new, step in self.steps(at, wide):
                if new not in seen:
                    seen.add(new)
                    state = (self.word_cost(new), new, (*way, step))
                    if PLAIN.fullmatch(new):
                        best = min(best, state)
                    if state[0] < c:
                        heapq.heappush(heap, state)
        c, new, way = best
        gain = start - c
        joined = any(step[-1] in ("utf-8", "html", "unicode") for step in way)
        if way and (gain > 0.0 if joined else gain > max(7.0, 1.1 * len(w)) and c < 4.2 * (len(new) + 1)):
            return new, gain, way
        return SAME

    def word(self, w: str) -> tuple[str, float, tuple]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[w] = self.search(w)
        return found

    def repair(self, line: str) -> tuple[bool, str | None]:
        """(True if the line has wrongly decoded characters, the restored line or null).

        The way that gains most over the whole line is tried in every word, so that short words follow the long ones.
        """
        words = line.split(" ")
        ways: dict[tuple, float] = {}
        for w in words:
            if not w.isascii() or "&" in w or "\\u" in w:
                _, gain, way = self.word(w)
                if way:
                    ways[way] = ways.get(way, 0.0) + gain
        if not ways:
            return lost(line), None
        main = max(ways, key=ways.get)
        return True, " ".join(self._along(w, main) if not w.isascii() or "&" in w or "\\u" in w else w for w in words)

    def _along(self, w: str, way: tuple) -> str:
        new: str | None = w
        for step in way:
            if new is None:
                break
            new = html.unescape(new) if step == ("html",) else re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), new) if step == ("unicode",) else reread(new, *step)
        own = self.word(w)
        if new is not None and new != w and PLAIN.fullmatch(new) and self.word_cost(new) < self.word_cost(w):
            return new
        return own[0] if own[2] else w


def _bytes(text: str, shown: str) -> bytes:
    """The bytes that were shown as text; code points that the table leaves open stand for themselves."""
    try:
        return text.encode(shown)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(shown)
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    raise
                out.append(ord(ch))
        return bytes(out)


def reread(text: str, shown: str, written: str) -> str | None:
    """The text whose bytes in written were shown by shown, or null; for UTF-8 lost characters stay lost."""
    try:
        if written == "utf-8" and LOST_BYTE in text:
            parts = [_bytes(p, shown) for p in text.split(LOST_BYTE)]
            new = b"\xff".join(parts).decode("utf-8", "replace")
            return new if new.count(LOST_BYTE) <= text.count(LOST_BYTE) else None
        return _bytes(text, shown).decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def wrong_lines(documents: DataFrame, counts: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, garbled, restored): the lines, cut at newlines and counted from 0, that hold wrongly decoded characters.

    A line is taken when a re-reading of the bytes of one of its words is clearly cheaper by the pair model counts, or
    when letters of it were lost (see lost()). restored is null for lines of which
    nothing could be restored. Null and empty texts give no row; each row is judged for itself, so repeated texts
    come out each.
    """
    cost = costs(counts)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Repairer(cost)
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"], strict=True):
                if not t:
                    continue
                for i, line in enumerate(t.split("\n")):
                    if line.isascii() and not any(x in line for x in ("&", "\\u", "??")):
                        continue
                    wrong, new = fix.repair(line)
                    if wrong:
                        rows.append((k, i, line, new))
            yield pd.DataFrame(rows, columns=["key", "line_no", "garbled", "restored"])

    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInPandas(run, f"key {kind}, line_no int, garbled string, restored string")
    return out.withColumnRenamed("key", key)


def find(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """wrong_lines with the pair model counted over the same documents."""
    return wrong_lines(documents, pair_counts(documents, text), key, text)
