"""Search in long texts: literal hits, tokens, proximity, most specific token subsets and table cells."""

from __future__ import annotations

import bisect
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import CYRILLIC_LOOKS

# --- fixed values ---------------------------------------------------------------------------------
TAG_PATTERN = r"(?:E-)?((?:[A-Z0-9]+-)+(?:[A-Z0-9]+))"
NO_TAG = ["AGCC", "agcc"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "with", "и", "в", "во", "на", "не", "по", "при", "с", "со", "для", "из", "от", "до"]
HIT_LIMIT = 50
LEAST_WIDTH, WIDTH_FACTOR = 150, 4
MANY_HITS = 1_000
# --------------------------------------------------------------------------------------------------


def tags_in(text: Column) -> Column:
    """Every equipment tag of a text in order, without the E- before it."""
    return F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(1))


def is_tag(tag: Column) -> Column:
    """A candidate is a tag if it has a capital and a digit and none of the words that never stand in tags."""
    out = tag.rlike("[A-Z]") & tag.rlike("[0-9]")
    for word in NO_TAG:
        out = out & ~tag.contains(word)
    return out


def has_cyrillic(text: Column) -> Column:
    return F.lower(text).rlike("[а-яё]")


def has_letters(text: Column) -> Column:
    return F.lower(text).rlike("[a-zа-яё]")


def overlaps_itself(needle: str) -> bool:
    return any(needle[:k] == needle[-k:] for k in range(1, len(needle)))


def literal_hits(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, pos): every place, counted from 0, where the needle stands in the text, without regard to case.

    Hits may overlap. A needle that can't overlap itself is found by splitting, within the JVM, in texts with up to
    MANY_HITS hits, as adding up their places costs the square of their number; the rest goes through an Arrow
    function in linear time. Null and empty texts and empty needles give no row.
    """
    n = needle.lower()
    if not n:
        return df.select(key, F.lit(0).alias("pos")).limit(0)
    rows = df.select(key, F.lower(text).alias("__t")).filter(F.col("__t").contains(n))
    pattern = re.compile(f"(?={re.escape(n)})")

    @F.pandas_udf("array<int>")
    def places(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [m.start() for m in pattern.finditer(t)])

    by_function = lambda d: d.select(key, F.explode(places("__t")).alias("pos"))
    if overlaps_itself(n):
        return by_function(rows)
    hits = (F.length("__t") - F.length(F.replace(F.col("__t"), F.lit(n), F.lit("")))) / len(n)
    sizes = F.transform(F.split("__t", rf"\Q{n}\E", -1), lambda p: F.length(p))
    ends = F.aggregate(
        sizes,
        F.array().cast("array<int>"),
        lambda acc, s: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.element_at(acc, -1) + F.lit(len(n))).otherwise(F.lit(0)) + s)),
    )
    few = rows.filter(hits <= MANY_HITS).withColumn("__ends", ends).select(key, F.explode(F.slice("__ends", F.lit(1), F.size("__ends") - 1)).alias("pos"))
    return few.unionByName(by_function(rows.filter(hits > MANY_HITS)))


def hit_counts(df: DataFrame, key: str, text: str, needle: str, limit: int = HIT_LIMIT) -> DataFrame:
    """(key, hits, searched): how often the needle stands in the text, without overlaps, and whether that is few enough to go on."""
    n = needle.lower()
    t = F.lower(text)
    hits = (F.length(t) - F.length(F.replace(t, F.lit(n), F.lit("")))) / len(n)
    return df.filter(F.col(text).isNotNull()).select(key, hits.cast("long").alias("hits")).withColumn("searched", F.col("hits").between(1, limit - 1))


def words_of(text: Column) -> Column:
    """The lower-case words of letters only that are no stop words; stands for the lemmas of a language model."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))


def proximity(sets: list[list[int]], width: int) -> list[int]:
    """Middles of the groups in which every set has a place within less than width; a group ends where the next begins."""
    out: list[int] = []
    window: deque[tuple[int, int]] = deque()
    held: Counter[int] = Counter()
    for p, i in sorted((p, i) for i, s in enumerate(sets) for p in s):
        window.append((p, i))
        held[i] += 1
        while p - window[0][0] >= width:
            _, old = window.popleft()
            held[old] -= 1
            if not held[old]:
                del held[old]
        if len(held) == len(sets):
            out.append((window[0][0] + p) // 2)
            window.clear()
            held.clear()
    return out


Lemmas = Callable[[str], Iterable[tuple[str, int]]]


def plain_lemmas(text: str) -> Iterator[tuple[str, int]]:
    """(lemma, place) of the words that count: runs of letters in lower case which are no stop words. Any language model with this form can take its place."""
    for m in re.finditer(r"[^\W\d_]+", text):
        w = m[0].lower()
        if w not in STOP_WORDS:
            yield w, m.start()


def token_places(text: str, lemmas: Lemmas = plain_lemmas) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for w, at in lemmas(text):
        out.setdefault(w, []).append(at)
    return out


def _width(words: int) -> int:
    return max(LEAST_WIDTH, WIDTH_FACTOR * words)


def phrase_hits(text: str | None, phrase: str | None, lemmas: Lemmas = plain_lemmas, places: dict[str, list[int]] | None = None) -> list[int]:
    """Where all words of the phrase stand close together; words that don't count are left out, a missing one means no hit. places is token_places of the text where it is known."""
    words = list(token_places(phrase or "", lemmas))
    if places is None:
        places = token_places(text or "", lemmas) if words else {}
    if not words or any(w not in places for w in words):
        return []
    return proximity([places[w] for w in words], _width(len(phrase or "")))


def most_specific(text: str | None, phrase: str | None, fixed: Iterable[str] = (), lemmas: Lemmas = plain_lemmas, places: dict[str, list[int]] | None = None) -> tuple[list[str], list[int]] | None:
    """The subset of the phrase's words, always with the fixed ones, that has the fewest hits above none, and its hits; ties by size, then order.

    A word more never gives more hits, so subsets grow word by word from those that have hits, words that the text
    lacks are left out from the start, and a subset with a single hit ends the search. All words of a phrase count.
    """
    always = list(token_places(" ".join(fixed), lemmas))
    words = [w for w in token_places(phrase or "", lemmas) if w not in always]
    if places is None:
        places = token_places(text or "", lemmas) if words or always else {}
    if not words or any(w not in places for w in always):
        return None
    width = _width(len(phrase or ""))
    words = [w for w in words if w in places]
    best: tuple[list[str], list[int]] | None = None
    level: list[tuple[int, ...]] = [()]
    while level:
        grown = []
        alive = set(level)
        for subset in level:
            for k in range(subset[-1] + 1 if subset else 0, len(words)):
                new = (*subset, k)
                if len(new) > 2 and any(new[:i] + new[i + 1 :] not in alive for i in range(len(new) - 1)):
                    continue
                hits = proximity([places[words[i]] for i in new] + [places[w] for w in always], width)
                if hits:
                    grown.append(new)
                    if best is None or len(hits) < len(best[1]):
                        best = (always + [words[i] for i in new], hits)
                        if len(hits) == 1:
                            return best
        level = grown
    return best


def phrase_search(df: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, pos) of phrase_hits for each row's text and phrase column."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([phrase_hits(a, b) for a, b in zip(t, p, strict=True)])

    return df.select(key, F.explode(run(F.col(text), F.col(phrase))).alias("pos"))


def specific_search(df: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, tokens, hits): the most specific subset for each row's text and phrase column; rows without one are left out."""

    @F.pandas_udf("struct<tokens:array<string>,hits:array<int>>")
    def run(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [most_specific(a, b) or (None, None) for a, b in zip(t, p, strict=True)]
        return pd.DataFrame(found, columns=["tokens", "hits"])

    return df.withColumn("__r", run(F.col(text), F.col(phrase))).filter("__r.hits is not null").select(key, F.array_join("__r.tokens", " ").alias("tokens"), F.size("__r.hits").alias("hits"))


def linear(cells: Iterable[tuple[int, int, str | None, str | None]]) -> tuple[str, list[int], list[tuple[int, int] | None]]:
    """A table, as (row, column, label, value), as one text, with where its parts begin and which cell each is; labels stand for the first row's cells."""
    rows: dict[int, dict[int, str | None]] = {}
    labels: dict[int, str] = {}
    for r, c, label, value in cells:
        rows.setdefault(r, {})[c] = value
        labels.setdefault(c, "" if label is None else str(label))
    text, starts, owners, at = [], [], [], 0

    def put(part: str, owner: tuple[int, int] | None) -> None:
        nonlocal at
        text.append(part)
        starts.append(at)
        owners.append(owner)
        at += len(part)

    first = min(rows, default=0)
    for c in sorted(labels):
        put(f"{labels[c]} ", (first, c))
    put("\n", None)
    for r in sorted(rows):
        for c in sorted(rows[r]):
            v = rows[r][c]
            put(("" if v is None or v in ("nan", "None", "-") else v) + " ", (r, c))
        put("\n", None)
    return "".join(text), starts, owners


def cells_with(cells: Iterable[tuple[int, int, str | None, str | None]], *phrases: str | None) -> list[list[tuple[int, int]]]:
    """For each phrase the (row, column) of the cells where its most specific words stand, each once, in order of the hits."""
    text, starts, owners = linear(cells)
    places = token_places(text)
    out = []
    for phrase in phrases:
        found = most_specific(text, phrase, places=places)
        own: dict[tuple[int, int], None] = {}
        for p in found[1] if found else []:
            k = bisect.bisect_right(starts, p) - 1
            while k >= 0 and (owners[k] is None or len(text) == starts[k]):
                k -= 1
            if k >= 0 and owners[k] is not None:
                own[owners[k]] = None
        out.append(list(own))
    return out


CELLS = "array<struct<row_idx:int,col_idx:int,col_label:string,value:string>>"


def gathered_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): the cells of each table in one array, in order; a table is small."""
    cell = F.struct(F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), "col_label", "value")
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).cast(CELLS).alias("cells"))


def table_search(tables: DataFrame, cells: str, phrase: str) -> DataFrame:
    """tables with points, an array of (row_idx, col_idx): where each row's phrase is found in its table; empty where it isn't.

    The table is read as a text of labels and cells, the phrase's most specific subset is searched in it, and each hit
    stands for the cell in which its middle lies; a hit in a label stands for the first row.
    """

    @F.pandas_udf("array<struct<row_idx:int,col_idx:int>>")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        as_rows = lambda x: [(c["row_idx"], c["col_idx"], c["col_label"], c["value"]) for c in x] if x is not None else []
        return pd.Series([[{"row_idx": r, "col_idx": c} for r, c in cells_with(as_rows(a), b)[0]] for a, b in zip(t, p, strict=True)])

    return tables.withColumn("points", run(F.col(cells), F.col(phrase)))


def mend_looks(text: Column) -> Column:
    """Latin letters that look Cyrillic made Cyrillic, word by word, where a word is mixed and mostly Cyrillic or all look-alikes."""
    latin, cyrillic = "aceopxyABEKMHOPCTX", "асеорхуАВЕКМНОРСТХ"
    assert set(cyrillic) <= set(CYRILLIC_LOOKS)

    def word(w: Column) -> Column:
        low = F.lower(w)
        c, n = F.length(F.regexp_replace(low, "[^а-яё]", "")), F.length(F.regexp_replace(low, "[^a-z]", ""))
        return F.when(((c > 0) & (n > 0) & (c >= n)) | ((n > 3) & low.rlike("^[aceopxybkmht0-9-]+$")), F.translate(w, latin, cyrillic)).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != ""), word), " ")
