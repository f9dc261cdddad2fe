"""One consistent form for text that looks the same but differs in its characters (problem 6)."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import CYRILLIC_AS_LATIN, CYRILLIC_LOOKS, GREEK_AS_LATIN, GREEK_LOOKS, HYPHENS
from tagloom.llm.pages import Page, split_pages
from tagloom.operators.unpack import values_of

# --- fixed values: Latin letters as the Cyrillic and Greek letters that look like them --------------
LATIN_LOOKS = "ABEKMHOPCTYXIJSaeopcyxijsёї"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТУХІЈЅаеорсухіјѕёї"
# ----------------------------------------------------------------------------------------------------
TO_LATIN = str.maketrans(CYRILLIC_LOOKS + GREEK_LOOKS, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
TO_CYRILLIC = str.maketrans(LATIN_LOOKS + GREEK_LOOKS, LATIN_AS_CYRILLIC + GREEK_AS_LATIN.translate(str.maketrans(LATIN_LOOKS, LATIN_AS_CYRILLIC)))
LATIN, CYRILLIC, GREEK = "A-Za-zÀ-ÖØ-öø-ɏ", "Ѐ-ӿ", "Ͱ-Ͽ"
HYPHEN = re.compile(f"[{HYPHENS}]")


def _class(codes: Iterable[int]) -> str:
    """The characters of some code points as ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _properties() -> tuple[set[int], dict[int, str], set[int], set[int]]:
    """From the properties of each code point: those that may change under normalization (NFC quick check no or maybe), those of other than ordinary width or font with their ordinary form, invisible ones, spaces but the plain one.

    Blocks without any of them (Chinese characters, Hangul syllables, private use) are passed over.
    """
    change, width, hidden, spaces = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), {}, set(range(0xFE00, 0xFE10)), set()
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0100)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        parts = unicodedata.decomposition(ch).split()
        if unicodedata.combining(ch) or (parts and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) != ch):
            change.add(c)
        if len(parts) == 2 and not parts[0].startswith("<"):
            change.add(int(parts[1], 16))
        if parts and (parts[0] in ("<wide>", "<narrow>", "<font>") or (0xFB00 <= c <= 0xFB06)):
            width[c] = unicodedata.normalize("NFKC", ch)
        if kind == "Cf" and unicodedata.bidirectional(ch) != "AN" and c not in PREPENDED:
            hidden.add(c)
        if kind == "Zs":
            spaces.add(c)
    return change, {c: x for c, x in width.items() if c not in spaces}, hidden, spaces


ROUNDS = 6
PREPENDED = {0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}  # format characters that are seen
CHANGE, WIDE, HIDDEN_SET, SPACE_SET = _properties()
HIDDEN, BLANK = re.compile(f"[{_class(HIDDEN_SET)}]"), re.compile(f"[{_class(SPACE_SET)}]")
# quick check: nothing without one of these can leave the consistent form of characters
UNSTABLE = frozenset(map(chr, {*CHANGE, *WIDE, *HIDDEN_SET, *SPACE_SET}))
MIXED = re.compile(f"[{LATIN}]+[{CYRILLIC}{GREEK}]+[{LATIN}{CYRILLIC}{GREEK}]*|[{CYRILLIC}]+[{LATIN}{GREEK}]+[{LATIN}{CYRILLIC}{GREEK}]*|[{GREEK}]+[{LATIN}{CYRILLIC}]+[{LATIN}{CYRILLIC}{GREEK}]*|[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]+(?=[{LATIN}])|(?<![\\w])[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοv]{{2,}}(?![\\w])")
TAG = re.compile(r"\d{4}-(?:[A-Z0-9]+-)*[A-Z]+-(?:[A-Z0-9]+-)*\d{2,5}[A-Z]?")
TAG_LIKE = re.compile(rf"[0-9]{{4}}(?:[-{HYPHENS}]\w+){{2,}}")
CODE_LIKE = re.compile(r"(?<![\w-])[АВЕКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]{2}(?=\d{3,})")
LONE_LETTERS, BESIDE = "aceopxyiасоіе", "-/.'’"  # letters that may stand alone, signs beside which they don't
NEXT_WORD = re.compile(r"[^\w\n]{0,3}[^\S\n]?([^\W\d_]{2,})")
PREVIOUS_WORD = re.compile(r"([^\W\d_]{2,})[^\w\n]{0,3}[^\S\n]?\Z")


@functools.lru_cache(1_000)
def _segments(loose: str) -> re.Pattern:
    """The unstable segments of a text whose unstable characters are loose: from white space to white space, odd spaces by themselves."""
    spaces = "".join(c for c in loose if ord(c) in SPACE_SET)
    rest = "".join(c for c in loose if ord(c) not in SPACE_SET)
    return re.compile("|".join([f"\\S*[{re.escape(rest)}]\\S*"] * bool(rest) + [f"[{re.escape(spaces)}]"] * bool(spaces)))


def _segment(s: str) -> str:
    """An unstable segment with its boundary context in normal form: composed, of ordinary width, nothing invisible, plain spaces."""
    s = BLANK.sub(" ", HIDDEN.sub("", s.translate(WIDE)))
    return s if unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)


def _word(m: re.Match) -> str:
    """A word of several scripts in the one that most of its unmistakable, else all its letters belong to."""
    w = m[0]
    cyrillic = re.findall(f"[{CYRILLIC}]", w)
    only = sum(c not in CYRILLIC_LOOKS for c in cyrillic)
    latin_only = sum(c not in LATIN_LOOKS for c in re.findall(f"[{LATIN}]", w))
    if only and not latin_only or (only == latin_only == 0 and len(cyrillic) > len(w) / 2):
        return w.translate(TO_CYRILLIC)
    return w.translate(TO_LATIN) if not only else w


def _tag(m: re.Match) -> str:
    if m[0].isascii():
        return m[0]
    new = HYPHEN.sub("-", m[0].translate(TO_LATIN))
    return new if TAG.fullmatch(new) else m[0]


def _script(w: str) -> str:
    return "c" if re.match(f"[{CYRILLIC}]", w) else "l" if re.match(f"[{LATIN}]", w) else ""


def _lone(text: str, at: int) -> str:
    """A letter that stands alone, in the script of the words beside it on its line."""
    before, after = PREVIOUS_WORD.search(text[max(0, at - 30) : at]), NEXT_WORD.match(text, at + 1)
    around = {_script(x[1]) for x in (before, after) if x}
    if around == {"c"} and text[at].isascii():
        return text[at].translate(TO_CYRILLIC)
    if around == {"l"} and not text[at].isascii():
        return text[at].translate(TO_LATIN)
    return text[at]


LATIN_BIT, CYRILLIC_BIT, GREEK_BIT, DIGIT_BIT, INNER_BIT, LONE_BIT, LOOSE_BIT, HYPHEN_BIT, BLANK_BIT, MINUS_BIT = (1 << i for i in range(10))


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point up to U+FFFF, which stands for all beyond it: its script, a digit, what stands in words or beside which no letter is alone, letters that may be alone, unstable characters, odd and plain hyphens, the space."""
    every = "".join(map(chr, range(65536)))
    out = np.zeros(65536, "uint16")
    classes = ((BLANK_BIT, " "), (MINUS_BIT, r"\-"), (LATIN_BIT, LATIN), (CYRILLIC_BIT, CYRILLIC), (GREEK_BIT, GREEK), (DIGIT_BIT, "0-9"), (INNER_BIT, rf"\w{re.escape(BESIDE)}"), (LONE_BIT, LONE_LETTERS), (HYPHEN_BIT, HYPHENS))
    for bit, letters in classes:
        for m in re.finditer(f"[{letters}]", every):
            out[m.start()] |= bit
    out[[ord(c) for c in UNSTABLE if ord(c) < 65536]] |= LOOSE_BIT
    out[65535] |= LOOSE_BIT
    return out


def _lone_changes(text: str, k: np.ndarray) -> dict[int, str]:
    """The lone letters of a text, whose characters are of kinds k, that belong to another script.

    A letter before a space and a word that begins in its own script stays, whatever stands before it.
    """
    inside = np.concatenate([[False], (k & INNER_BIT) != 0, [False]])
    alone = ((k & LONE_BIT) != 0) & ~inside[:-2] & ~inside[2:]
    letters = k & (LATIN_BIT | CYRILLIC_BIT | GREEK_BIT)
    alone[:-3] &= ~((letters[:-3] == letters[2:-1]) & (letters[3:] != 0) & ((k[1:-2] & BLANK_BIT) != 0))
    return {i: new for i in np.flatnonzero(alone).tolist() if (new := _lone(text, i)) != text[i]}


def _codes(text: str) -> np.ndarray:
    return _kinds()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 65535)]


def _put(text: str, changes: dict[int, str]) -> str:
    signs = list(text)
    for i, new in changes.items():
        signs[i] = new
    return "".join(signs)


def _scripts(text: str) -> str:
    """Words in one script, tags in Latin letters with plain hyphens, lone letters in the script of their neighbours."""
    text = MIXED.sub(_word, text)
    text = TAG_LIKE.sub(_tag, text)
    text = CODE_LIKE.sub(lambda m: m[0].translate(TO_LATIN), text)
    changes = _lone_changes(text, _codes(text))
    return _put(text, changes) if changes else text


def canonical_lines(lines: list[str]) -> list[str]:
    """canonical of each line. The kinds of neighbouring characters, looked at for all lines at once, tell which lines any rule but that of lone letters can change; only these are gone over by it."""
    text = "\n".join(lines)
    if text.isascii():
        return lines
    k = _codes(text)
    letters, hyphen = k & (LATIN_BIT | CYRILLIC_BIT | GREEK_BIT), (k & MINUS_BIT) != 0
    a, b = letters[:-1], letters[1:]
    odd = (k & (LOOSE_BIT | GREEK_BIT)) != 0
    odd[1:] |= ((a != b) & (a != 0) & (b != 0)) | ((a > LATIN_BIT) & ((k[1:] & DIGIT_BIT) != 0))
    plain = (k & (LATIN_BIT | DIGIT_BIT)) != 0
    odd[1:] |= plain[:-1] & ((k[1:] & HYPHEN_BIT) != 0)
    odd[2:] |= plain[:-2] & hyphen[1:-1] & (letters[2:] > LATIN_BIT)
    changes = _lone_changes(text, k)
    out = (_put(text, changes) if changes else text).split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    for i in set(np.searchsorted(ends, np.flatnonzero(odd), "right").tolist()):
        out[i] = canonical(lines[i])
    if "vv" in text:
        out = [canonical(x) if "vv" in x else y for x, y in zip(lines, out, strict=True)]
    return out


def canonical(text: str) -> str:
    """The text in the consistent form: composed letters of ordinary width, plain spaces, nothing invisible, one script a word, plain hyphens in tags.

    Plain ASCII and texts that pass the quick check come back as they are; else only the unstable segments, up to
    the white space round them, are normalised and put back among the unchanged rest. A letter that got another
    script may compose with its accent or change what a neighbour means, so what was changed is gone over again.
    """
    if text.isascii():
        return text
    for _ in range(ROUNDS):
        if loose := UNSTABLE.intersection(text):
            text = _segments("".join(sorted(loose))).sub(lambda m: _segment(m[0]), text)
        new = _scripts(text)
        if new == text:
            break
        text = new
    return text


def cleaned(pages: list[Page]) -> list[Page]:
    """The pages with their lines in the consistent form of characters, whose rules look at one line only."""
    lines = iter(canonical_lines([x for p in pages for x in p.lines]))
    for p in pages:
        p.lines = [next(lines) for _ in p.lines]
    return pages


def canonical_tag(value: str) -> str:
    """A tag in Latin letters with plain hyphens; values that are no tag as canonical()."""
    if value.isascii():
        return value
    s = HYPHEN.sub("-", BLANK.sub(" ", _segment(value)))
    t = s.translate(TO_LATIN)
    return t if t.isascii() else canonical(s)


def fixed_places(files: DataFrame) -> DataFrame:
    """(file_id, field, place, was, fixed): every value of mentioned_tags and page of pure_text that wasn't in the consistent form.

    place is the value's position or the page's number. Null and blank fields, and texts in consistent form, give no
    row; files repeated under another id come out each.
    """

    @F.pandas_udf("string")
    def tag(s: pd.Series) -> pd.Series:
        return s.map(canonical_tag)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["file_id"], b["pure_text"], strict=True):
                if text and not text.isascii():
                    for p in split_pages(text):
                        if (new := "\n".join(canonical_lines(p.body.split("\n")))) != p.body:
                            rows.append((k, "pure_text", p.number, p.body, new))
            yield pd.DataFrame(rows, columns=["file_id", "field", "place", "was", "fixed"])

    schema = "file_id long, field string, place int, was string, fixed string"
    tags = values_of(files, "file_id", "mentioned_tags", True).withColumn("fixed", tag("item")).filter("fixed != item")
    tags = tags.select(F.col("file_id").cast("long").alias("file_id"), F.lit("mentioned_tags").alias("field"), F.col("pos").cast("int").alias("place"), F.col("item").alias("was"), "fixed")
    return tags.unionByName(files.select(F.col("file_id").cast("long").alias("file_id"), "pure_text").filter("pure_text is not null").mapInPandas(pages, schema))
