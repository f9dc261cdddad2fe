"""Text of scanned pages repaired into continuous paragraphs (problem 7)."""

from __future__ import annotations

import bisect
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.glyphs import canonical, cleaned
from tagloom.llm.pages import TORN_MARKS, Page, heads_of, read
from tagloom.session import cut

# --- fixed values: characters that scanning takes for one another; each group shares its first sign ---
LATIN_CONFUSED = ["o0", "l1i|!íî", "z2", "s5$", "hnb6", "g9q", "ec", "tf"]
LATIN_SPREAD = {"m": "rh", "d": "el", "u": "ll", "w": "vv"}  # as rn, cl, ii and vv, in the signs above
CYRILLIC_CONFUSED = ["о0", "ес", "тг", "инй", "лпд", "з3э", "в8", "б6", "ч4", "шщ", "ьъы"]
# ------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
SPLIT = re.compile(f"({WORD.pattern})")
LETTERS = re.compile(r"[^\W\d_]")
CODE = re.compile(r"[A-Z]{1,3}\d{2,}[A-Z]?|\d[\w\-]*-[\w\-]+|[\d.,]+|[A-Z]{1,2}\d+")
DIGITS = re.compile(r"\d+|.*\d{3,}.*")
PLAIN_WORD = re.compile(r"(?=..)[^\W\d_]+(?:['’\-][^\W\d_]+)*")


LATIN_FOLD = str.maketrans({c: g[0] for g in LATIN_CONFUSED for c in g} | LATIN_SPREAD)
CYRILLIC_FOLD = str.maketrans({c: g[0] for g in CYRILLIC_CONFUSED for c in g})


def shape(word: str) -> str:
    """What words that scanning may take for one another share."""
    w = word.lower()
    if any("Ѐ" <= c <= "ӿ" for c in w):
        return w.translate(CYRILLIC_FOLD)
    return w.translate(LATIN_FOLD)


class Lexicon:
    """Words that stand in many files, with indexes by shape and by one open character."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.least = min(self.cost.values(), default=0.0)
        self.shapes: dict[str, list[str]] = {}
        self.open: dict[str, list[str]] = {}
        for w in counts:
            self.shapes.setdefault(shape(w), []).append(w)
            if len(w) > 4:
                for i in range(len(w)):
                    self.open.setdefault(f"{w[:i]}?{w[i + 1 :]}", []).append(w)
        self.longest = max(map(len, counts), default=0) + 2
        self.known: dict[str, str | None] = {}
        self.read: dict[tuple, list[Reading]] = {}

    def decoded(self, tokens: list[Token]) -> list[Reading]:
        """decode, kept for stretches that come again."""
        key = tuple(tokens)
        if key not in self.read:
            if len(self.read) > 100_000:
                self.read.clear()
            self.read[key] = decode(tokens, self)
        return self.read[key]

    def right(self, word: str) -> str | None:
        """The word itself if it is known, else the commonest word it was misread from, else null."""
        w = word.lower()
        if w in self.n:
            return w
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = self._near(w)
        return self.known[w]

    def _near(self, w: str) -> str | None:
        found = self.shapes.get(shape(w), [])
        if not found and len(w) > 4:
            found = [x for i in range(len(w)) for x in self.open.get(f"{w[:i]}?{w[i + 1 :]}", [])]
            if not found and re.search(r"\d", w):
                found = [x for i in range(len(w)) for x in self.shapes.get(shape(w[:i] + w[i + 1 :]), [])]
        return max(found, key=lambda x: (-abs(len(x) - len(w)), sum(a == b for a, b in zip(x, w)), self.n[x], x)) if found else None  # noqa: B905


def in_case_of(word: str, like: str) -> str:
    """word with the capitals of like."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > len(letters) / 2 and letters[-1].isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (like[:1].isdigit() and len(letters) > 1 and letters[0].isupper()) else word


Token = tuple[str, str, str]  # the word, the mark of a tear behind it, what separates it from the next: space, line, or break


def _stream(pages: list[Page]) -> tuple[str, list[int]]:
    """The body of all pages without running lines as one text, and where each page begins in it."""
    parts, begins, at = [], [], 0
    for p in pages:
        begins.append(at)
        part = "\n".join([x for i, x in enumerate(p.lines) if i not in p.running and x.strip()] if p.running else [x for x in p.lines if x.strip()])
        if part:
            parts.append(part)
            at += len(part) + 1
    return "\n".join(parts), begins


def _behind(after: str) -> tuple[str, str]:
    """(mark, gap) of what stands between two words, up to the line's end."""
    line, newline, _ = after.partition("\n")
    torn = line.strip()
    mark = torn if len(torn) == 1 and torn in TORN_MARKS and line[:1] == torn and (newline or len(line) > 1) else ""
    return mark, "break" if torn and not mark else "line" if newline else "space"


def _tokens(text: str) -> tuple[list[Token], list[int]]:
    """The words of a text in order, and where each begins."""
    parts = SPLIT.split(text)  # what stands before, between and behind the words, and the words
    words, behind = parts[1::2], parts[2::2]
    if behind and "\n" not in behind[-1]:
        behind[-1] += "\n"
    plain = {" ": ("", "space"), "\n": ("", "line")}
    return [(w, *(plain.get(x) or _behind(x))) for w, x in zip(words, behind, strict=True)], list(accumulate(map(len, parts)))[0:-1:2]


def _sound_words(text: str) -> set[str]:
    """The different words of a text, in small letters, that aren't pieces of a torn one."""
    parts = SPLIT.split(text)
    words, behind = parts[1::2], parts[2::2]
    torn = set()
    for i, x in enumerate(behind):
        if x not in (" ", "\n"):
            mark, gap = _behind(x if i + 1 < len(words) or "\n" in x else x + "\n")
            if mark:
                torn.update((i, i + 1) if gap != "break" else (i,))
    return {w.lower() for w in {w for i, w in enumerate(words) if i not in torn} if (w.isalpha() and len(w) > 1) or PLAIN_WORD.fullmatch(w)}


def _judged(word: str) -> bool:
    """True for words that the lexicon can judge: letters, and more of them than digits."""
    letters = len(LETTERS.findall(word))
    return len(word) > 2 and letters > len(word) / 2 and not CODE.fullmatch(word)


UNKNOWN, UNKNOWN_SIGN, NO_WORD = 30.0, 4.0, 10.0  # cost of a word that isn't known: at least, and a sign; of a number or code
MISREAD, LEFT_MARK, NO_SPACE, JOIN, JOIN_MARK = 8.0, 25.0, 12.0, 12.0, 1.0
LEAST_PART = 3


def regions(tokens: list[Token], lex: Lexicon) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the stretches of tokens that can be read in more than one way.

    A known word without a mark that can't be joined to its neighbours has one reading only, so the stream may be cut there without changing the cheapest reading of the rest.
    """
    known = lex.n
    low = [t[0].lower() for t in tokens]
    last = len(tokens) - 1
    unknown = {i for i, w in enumerate(low) if w not in known and _judged(tokens[i][0])}
    marked = {i for i, t in enumerate(tokens) if t[1] and t[2] != "break" and i < last}
    goes_on = lambda i: i < last and tokens[i][2] != "break" and tokens[i + 1][0][:1].islower()
    joined = {i for i, (a, b) in enumerate(zip(low, low[1:], strict=False)) if a + b in known and goes_on(i)}
    joined |= marked | {i for i in unknown if i + 1 in unknown and goes_on(i)}
    stretches: list[list[int]] = []
    for i in sorted({*unknown, *joined, *(i for i, t in enumerate(tokens) if t[1])}):
        if not stretches or i >= stretches[-1][1]:
            stretches.append([i, i + 1])
        if i in joined:
            stretches[-1][1] = i + 2
    wide: list[tuple[int, int]] = []
    for first, end in stretches:
        # a known word beside a stretch belongs to it if some word holds it and a part of the stretch
        whole = "".join(low[first:end])
        if first and goes_on(first - 1) and any(low[first - 1] + whole[:k] in known for k in range(1, min(len(whole), lex.longest) + 1)):
            first -= 1
        if goes_on(end - 1) and any(whole[k:] + low[end] in known for k in range(max(0, len(whole) - lex.longest), len(whole))):
            end += 1
        if wide and first < wide[-1][1]:
            wide[-1] = (min(first, wide[-1][0]), end)
        else:
            wide.append((first, end))
    yield from wide


Reading = tuple[int, int, int, int, str, str]


def _at_once(tokens: list[Token], lex: Lexicon) -> list[Reading] | None:
    """The cheapest reading of the two commonest stretches, where bounds on the costs leave no other: a torn word that is known whole, and a misread word cheaper than any two words."""
    word = tokens[0][0]
    if len(tokens) == 1 and not tokens[0][1]:
        if word.lower() not in lex.n and (r := lex.right(word)) and lex.cost[r] + MISREAD < min(NO_SPACE + 2 * lex.least, UNKNOWN):
            return [(0, 0, 0, len(word), in_case_of(r, word), "misread")]
    elif len(tokens) == 2 and tokens[0][1] and not tokens[1][1]:
        whole = word + tokens[1][0]
        forms = [f"{word}-{tokens[1][0]}", whole] if tokens[0][1] in ("-", "‐") else [whole]
        costs = [(lex.cost[f.lower()], i) for i, f in enumerate(forms) if f.lower() in lex.n]
        if costs and not DIGITS.fullmatch(whole) and min(costs)[0] + JOIN_MARK < LEFT_MARK:
            joined = min(costs)[0] + JOIN_MARK
            if joined < NO_SPACE + 2 * lex.least:
                return [(0, 0, 1, len(tokens[1][0]), forms[min(costs)[1]], "broken")]
    return None


def decode(tokens: list[Token], lex: Lexicon) -> list[Reading]:
    """The cheapest way to read a stretch of tokens as words: (first token, place in it, last token, end in it, the word as read, what happened to it).

    Dynamic programming over the stream of characters with lines and spaces taken out. A word may begin and end at
    any character: over borders of tokens, which a mark of a tear makes cheap and a plain space dear, and within an
    unknown token, where a space is missing. It may be known, misread, or unknown; a tear's hyphen may be its own.
    """
    words = [t[0] for t in tokens]
    if short := _at_once(tokens, lex):
        return short
    stream = "".join(words)
    low = stream.lower()
    if len(low) != len(stream):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in stream)
    begin = list(accumulate(map(len, words), initial=0))
    n, size = len(words), len(stream)
    known = [low[begin[i] : begin[i + 1]] in lex.n for i in range(n)]
    judged = [k or _judged(w) for k, w in zip(known, words, strict=True)]
    token_at = {b: i for i, b in enumerate(begin)}
    inner = [i for i in range(n) if not known[i] and judged[i] and len(words[i]) >= 2 * LEAST_PART]
    ends = {*begin[1:], *(p for i in inner for p in range(begin[i] + LEAST_PART, begin[i + 1] - LEAST_PART + 1))}
    owner = [i for i, w in enumerate(words) for _ in w]
    stops = sorted(ends)
    best: dict[int, tuple[float, int, str, str]] = {0: (0.0, 0, "", "")}

    def offer(a: int, b: int, cost: float, read_: str, kind: str) -> None:
        cost += best[a][0]
        if b not in best or cost < best[b][0]:
            best[b] = (cost, a, read_, kind)

    for a in [0, *stops]:
        if a not in best or a == size:
            continue
        i, whole_start = owner[a], a in token_at
        extra = 0.0 if whole_start else NO_SPACE
        for b in stops:
            if b <= a or (b - a < LEAST_PART and not (whole_start and b in token_at)):
                continue
            j = owner[b - 1]
            crossed = range(i, j)
            if j > i and (tokens[j - 1][2] == "break" or not (tokens[j - 1][1] or words[j][:1].islower())):
                break
            marked = j > i and all(tokens[k][1] for k in crossed)
            if j > i and not marked and b - a > lex.longest:
                break
            whole_end = b in token_at
            cost = extra + sum(JOIN_MARK if tokens[k][1] else JOIN for k in crossed)
            if whole_end and tokens[j][1]:
                cost += LEFT_MARK
            raw = stream[a:b]
            if j > i and DIGITS.fullmatch(raw):
                continue
            kind = "broken" if j > i else "same" if whole_start and whole_end else "split"
            forms = [raw]
            hyphens = [begin[k + 1] - a for k in crossed if tokens[k][1] in ("-", "‐")]
            if hyphens:
                glued = raw
                for h in reversed(hyphens):
                    glued = f"{glued[:h]}-{glued[h:]}"
                forms.insert(0, glued)
            for form in forms:
                f = form.lower()
                if f in lex.n:
                    offer(a, b, cost + lex.cost[f], form, kind)
                elif not (whole_start and whole_end):
                    continue
                elif j == i:
                    if not judged[i]:
                        offer(a, b, cost + NO_WORD, form, kind)
                        continue
                    r = lex.right(form)
                    if r:
                        offer(a, b, cost + lex.cost[r] + MISREAD, in_case_of(r, form), "misread")
                    offer(a, b, cost + max(UNKNOWN, UNKNOWN_SIGN * len(form)), form, kind)
                elif marked:
                    r = lex.right(form) if _judged(form) else None
                    if r:
                        offer(a, b, cost + lex.cost[r] + MISREAD, in_case_of(r, form), "broken misread")
                    if form is raw:
                        offer(a, b, cost + max(UNKNOWN, UNKNOWN_SIGN * len(form)) + JOIN_MARK, form, "broken")
                elif len(form) > 6 and not any(known[i : j + 1]) and (r := lex.right(form)):
                    offer(a, b, cost + lex.cost[r] + MISREAD + 1.0, in_case_of(r, form), "broken misread")
    out, b = [], size
    while b > 0:
        _, a, read_, kind = best[b]
        i, j = owner[a], owner[b - 1]
        out.append((i, a - begin[i], j, b - begin[j], read_, kind))
        b = a
    return out[::-1]


def paragraphs(lines: list[str], heads: set[str]) -> list[str]:
    """Lines joined to paragraphs. Where paragraphs end is chosen by dynamic programming over all lines.

    A border costs little behind a short line that ends a sentence, round headings and round lines of name and value,
    much where the next line goes on in small letters.
    """
    lines = [x.strip() for x in lines if x.strip()]
    if not lines:
        return []
    width = max(map(len, lines))
    alone = [x in heads or bool(re.match(r"[^\W\d_][^:.]{2,60}: -?[\d.,]+ ?\S{0,6}$", x)) for x in lines]

    def border(i: int) -> float:
        a, b = lines[i], lines[i + 1]
        return (0.0 if alone[i] or alone[i + 1] else 2.0) + (0.0 if a[-1] in ".!?:" or alone[i] else 3.0) + (3.0 if b[:1].islower() else 0.0) - 2.5 * (1 - len(a) / width)

    def inside(i: int) -> float:
        return 4.0 * (alone[i] or alone[i + 1]) + 1.5 * (1 - len(lines[i]) / width) + 0.5

    cost, back, within = [0.0], [0], 0.0
    open_ = (math.inf, 0)  # the cheapest beginning of the paragraph that holds the line, less the cost within up to there
    for j in range(1, len(lines) + 1):
        if j > 1:
            within += inside(j - 2)
        open_ = min(open_, (cost[j - 1] - within + (border(j - 2) if j > 1 else 0.0), j - 1))
        cost.append(open_[0] + within)
        back.append(open_[1])
    out, j = [], len(lines)
    while j > 0:
        out.append(" ".join(lines[back[j] : j]))
        j = back[j]
    return out[::-1]


def lexicon(files: DataFrame, share: float = 0.004, least: int = 3, keep: int = 200_000) -> dict[str, int]:
    """Words and in how many files they stand untorn outside running lines, counted over all files; those in share of the files and least at least.

    A file of w different words adds w counts, so at most (mean w) / share words are kept, however large the corpus.
    Words that look like a misreading of one ten times as common are left out. A task hands its counts on whenever it
    holds keep words. The files are read once; the counts are cut from their lineage to be read for the number of
    files and for the words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        n = 0
        for b in batches:
            n += len(b)
            for t, heads in zip(b["pure_text"], b["headers"], strict=True):
                seen.update(_sound_words(_stream(cleaned(read(t, heads)))[0]))
            if len(seen) > keep:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": [*seen, None], "n": [*seen.values(), n]})

    texts = files.select("pure_text", "headers").filter("pure_text is not null")
    counts = cut(texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = next((r["n"] for r in counts.filter("word is null").collect()), 0)
    rows = counts.filter(F.col("word").isNotNull() & (F.col("n") >= max(least, share * total))).collect()
    n = {r["word"]: r["n"] for r in rows}
    lex = Lexicon(n)
    out = {}
    for w, c in n.items():
        alike = [*lex.shapes[shape(w)], *(x for i in range(len(w)) for x in lex.open.get(f"{w[:i]}?{w[i + 1 :]}", []))]
        if max((n[x] for x in alike), default=0) < 10 * c:
            out[w] = c
    return out


_LEXICONS: dict[str, Lexicon] = {}


def _of_worker(name: str, words: Broadcast) -> Lexicon:
    """The lexicon of a broadcast, named anew for each, built once in each worker, whatever the number of its tasks."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(words.value)
    return _LEXICONS[name]


def _repairs(key: int, text: str, headers: str | None, lex: Lexicon) -> Iterator[tuple]:
    pages = read(text, headers)
    for p in pages:
        for i in sorted(p.running):
            yield key, "pure_text", p.number, "running", p.lines[i].strip()
    body, begins = _stream(cleaned(pages))
    tokens, starts = _tokens(body)
    for a, b in regions(tokens, lex):
        for i, _, _, _, read_, kind in lex.decoded(tokens[a:b]):
            if kind in ("same", "split"):
                continue
            place = pages[bisect.bisect_right(begins, starts[a + i]) - 1].number
            if "broken" in kind:
                yield key, "pure_text", place, "broken", read_
            if "misread" in kind:
                yield key, "pure_text", place, "misread", read_
    for i, (_, t) in enumerate(heads_of(headers)):
        for m in WORD.finditer(canonical(t)):
            if m[0].lower() not in lex.n and _judged(m[0]) and (r := lex.right(m[0])):
                yield key, "headers", i, "misread", in_case_of(r, m[0])


def repairs(spark: SparkSession, files: DataFrame, share: float = 0.004) -> DataFrame:
    """(file_id, field, place, kind, fixed): what was wrong on each page and in each header, and what is right.

    kind is broken (a word torn apart, on the page of its first piece), misread (wrongly read characters) or running
    (a running header, footer or page number). Null and empty texts and unreadable headers give no row; one row for
    each different fix of a place.
    """
    words, name = spark.sparkContext.broadcast(lexicon(files, share)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _of_worker(name, words)
        for b in batches:
            rows = [r for k, t, h in zip(b["file_id"], b["pure_text"], b["headers"], strict=True) for r in dict.fromkeys(_repairs(k, t, h, lex))]
            yield pd.DataFrame(rows, columns=["file_id", "field", "place", "kind", "fixed"])

    schema = "file_id long, field string, place int, kind string, fixed string"
    return files.select(F.col("file_id").cast("long").alias("file_id"), "pure_text", "headers").filter("pure_text is not null").mapInPandas(run, schema)


def readable(spark: SparkSession, files: DataFrame, share: float = 0.004) -> DataFrame:
    """(file_id, par_no, text): the files as continuous paragraphs: running lines gone, torn words whole, misread ones right."""
    words, name = spark.sparkContext.broadcast(lexicon(files, share)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _of_worker(name, words)
        for b in batches:
            rows = []
            for k, t, h in zip(b["file_id"], b["pure_text"], b["headers"], strict=True):
                pages = cleaned(read(t, h))
                lines = [x for p in pages for i, x in enumerate(p.lines) if i not in p.running]
                rows += [(k, i, mended(x, lex)) for i, x in enumerate(paragraphs(lines, {x for _, x in heads_of(h)}))]
            yield pd.DataFrame(rows, columns=["file_id", "par_no", "text"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "pure_text", "headers").filter("pure_text is not null").mapInPandas(run, "file_id long, par_no int, text string")


def mended(paragraph: str, lex: Lexicon) -> str:
    """A paragraph of joined lines with its words decoded and its other characters kept."""
    tokens, starts = _tokens(paragraph)
    out, at = [], 0
    for a, b in regions(tokens, lex):
        before = 0
        for i, p, j, q, read_, kind in lex.decoded(tokens[a:b]):
            begin = starts[a + i] + p
            out += [paragraph[at:begin], " " if p and before == begin else "", read_ if kind != "same" else paragraph[begin : starts[a + j] + q]]
            at = before = starts[a + j] + q
    return "".join([*out, paragraph[at:]])
