"""Languages of files and of the segments of mixed files (problem 4)."""

from __future__ import annotations

import bisect
import functools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.glyphs import cleaned
from tagloom.llm.pages import TORN_MARKS, Page, read
from tagloom.session import shuffle_width

# --- fixed values ---------------------------------------------------------------------------------
FAMILIES = {"cyrillic": ["ru", "uk"], "latin": ["de", "en", "fr"]}
CODES = {
    "en": ["en", "eng", "english", "en-us", "en-gb", "en_us"],
    "ru": ["ru", "rus", "russian", "ru-ru", "ru_ru", "русский"],
    "de": ["de", "deu", "ger", "german", "de-de", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "fr-fr", "français"],
    "uk": ["uk", "ukr", "ukrainian", "uk-ua", "українська"],
}
# --------------------------------------------------------------------------------------------------
DIM = 1 << 15
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CYRILLIC_WORD, LATIN_LETTER, CYRILLIC_LETTER = re.compile("[Ѐ-ӿ]+"), re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[Ѐ-ӿ]")
NUMBERED = re.compile(r"\d+(\.\d+)*\.? [^\W\d_]")
FIELD = re.compile(r"[^\W\d_][^:.]{2,60}: -?[\d.,]+ ?\S{0,5}$")
DIGIT = re.compile(r"\d")
UNKNOWN = "und"
SENTENCE_END = re.compile(r"[.!?;:][\"»”)]*$")


def label(c: Column) -> Column:
    """The two-letter code a label stands for, else null."""
    t = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for code, forms in CODES.items():
        out = F.when(t.isin(forms), F.lit(code)).otherwise(out)
    return out


@functools.lru_cache(200_000)
def family(word: str) -> str:
    """cyrillic or latin by most of the letters; other where neither has most."""
    if word.isascii():
        return "latin"
    if CYRILLIC_WORD.fullmatch(word):
        return "cyrillic"
    c, n = len(CYRILLIC_LETTER.findall(word)), len(LATIN_LETTER.findall(word))
    return "cyrillic" if 2 * c > len(word) else "latin" if 2 * n >= len(word) or c else "other"


def features(word: str) -> list[int]:
    """Hashed pieces of one to four characters of the word with its borders, and the word itself."""
    w = f"^{word.lower()}$"
    grams = {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} | {w}
    return [zlib.crc32(g.encode()) % DIM for g in sorted(grams)]


class Svm:
    """A linear support vector machine of one pair of languages, trained by the Pegasos steps, with averaged weights."""

    def __init__(self, first: str, second: str):
        self.first, self.second, self.weights, self.slope = first, second, np.zeros(DIM, "float32"), 4.0

    def fit(self, rows: list[list[int]], signs: np.ndarray, rounds: int = 4, strength: float = 5e-3) -> Svm:
        rng = np.random.default_rng(5)
        w, mean, t = np.zeros(DIM), np.zeros(DIM), 1
        scale = 1.0
        share = {1.0: max((signs > 0).mean(), 1e-3), -1.0: max((signs < 0).mean(), 1e-3)}
        weight = {k: min(0.5 / v, 10.0) for k, v in share.items()}
        for _ in range(rounds):
            for i in rng.permutation(len(rows)):
                x, y = rows[i], float(signs[i])
                unit = 1.0 / np.sqrt(len(x))
                step = 1.0 / (strength * (t + 1e3))
                margin = y * scale * w[x].sum() * unit
                scale *= 1.0 - step * strength
                if margin < 1:
                    np.add.at(w, x, step * weight[y] * y * unit / scale)
                t += 1
            mean += scale * w
        self.weights = (mean / rounds).astype("float32")
        return self

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) / np.sqrt(len(x))


@dataclass
class Segment:
    """A run of words of one language: (word, page, whole) of each."""

    words: list[tuple[str, int]]
    family: str
    lang: str = ""
    confidence: float = 0.0


def segments(pages: list[Page], least_words: int = 3) -> list[Segment]:
    """The file's words outside running lines, tags and codes, cut at ends of sentences and where the script changes for several words.

    Words torn at line ends are one word, standing on both its pages; a sentence goes on over the page's end.
    """
    sentences: list[list[tuple[str, int]]] = [[]]
    torn = ""
    torn_page = 0
    for p in cleaned(pages):
        for i, line in enumerate(p.lines):
            if i in p.running:
                continue
            parts = line.split()
            if not parts:
                continue
            field = ":" in line and FIELD.match(line)
            if field or (line[0].isdigit() and NUMBERED.match(line)):
                sentences.append([])
            last = len(parts) - 1
            for k, raw in enumerate(parts):
                if torn:
                    raw = torn + raw
                    found = WORD.findall(raw)
                    if found:
                        sentences[-1] += [(found[0], torn_page), (found[0], p.number)]
                    torn = ""
                elif raw.isalpha():
                    if len(raw) > 5 or not raw.isupper():
                        sentences[-1].append((raw, p.number))
                    continue
                elif k == last and len(raw) > 1 and raw[-1] in TORN_MARKS and raw[-2].isalpha():
                    torn, torn_page = raw[:-1], p.number
                    continue
                elif not DIGIT.search(raw):
                    sentences[-1] += [(w, p.number) for w in WORD.findall(raw) if not (w.isupper() and len(w) < 6)]
                if SENTENCE_END.search(raw):
                    sentences.append([])
            if field:
                sentences.append([])
    out: list[Segment] = []
    for s in sentences:
        runs: list[Segment] = []
        for w, page in s:
            f = family(w)
            if runs and runs[-1].family == f:
                runs[-1].words.append((w, page))
            else:
                runs.append(Segment([(w, page)], f))
        strong = [r for r in runs if sum(len(w) > 2 for w, _ in r.words) >= least_words] or sorted(runs, key=lambda r: -sum(len(w) for w, _ in r.words))[:1]
        merged: list[Segment] = []
        for r in strong:
            if merged and merged[-1].family == r.family:
                merged[-1].words += r.words
            else:
                merged.append(r)
        out += merged
    return out


class Discriminator:
    """The family by its letters first, then one-versus-one linear machines between the languages of the family."""

    def __init__(self, machines: list[Svm]):
        self.machines = machines
        self.names = sorted((x for v in FAMILIES.values() for x in v), reverse=True)
        self.place: dict[str, int] = {}
        self.scores: list[np.ndarray] = []

    def _words(self, words: list[str]) -> np.ndarray:
        """For each word the sums of its pieces' weights in every machine, and how many pieces it has; what was worked out is kept."""
        if len(self.place) > 200_000:
            self.place.clear()
            self.scores.clear()
        place = self.place
        for w in words:
            if w not in place:
                x = features(w)
                place[w] = len(self.scores)
                self.scores.append(np.array([*(m.weights[x].sum() for m in self.machines), len(x)]))
        return np.stack(self.scores)[[place[w] for w in words]]

    def judge(self, segs: list[Segment]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its confidence, the confidence of every language of names) of each segment: most duels won, ties by margin; a confidence is the least sure of a language's duels."""
        if not segs:
            return [], np.zeros(0), np.zeros((0, len(self.names)))
        sizes = np.array([len(s.words) for s in segs])
        sums = np.add.reduceat(self._words([w for s in segs for w, _ in s.words]), np.cumsum(sizes) - sizes, axis=0)
        margins = sums[:, :-1] / np.sqrt(sums[:, -1:])
        own = np.array([[name in FAMILIES.get(s.family, ()) for name in self.names] for s in segs])
        won, sure = np.where(own, 0.0, -1.0), np.where(own, 1.0, 0.0)
        for m, v in zip(self.machines, margins.T, strict=True):
            a, b = self.names.index(m.first), self.names.index(m.second)
            chance = 1.0 / (1.0 + np.exp(-m.slope * v))
            gain = np.where(own[:, a], 1 + np.minimum(np.abs(v), 0.9) / 10, 0.0)
            won[:, a] += np.where(v >= 0, gain, 0.0)
            won[:, b] += np.where(v < 0, gain, 0.0)
            sure[:, a], sure[:, b] = np.minimum(sure[:, a], chance), np.minimum(sure[:, b], 1 - chance)
        best = won.argmax(1)
        none = ~own.any(1)
        return [UNKNOWN if n else self.names[k] for k, n in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, sure[np.arange(len(segs)), best]), sure

    def assign(self, files: list[list[Segment]]) -> None:
        """A language for every segment of every file; one that is short or unsure goes with its nearest sure neighbour of the same family.

        The confidence of a segment that goes with its neighbour is that of the neighbour, taken as what was known
        before, and of its own words for that language together, by the rule of Bayes.
        """
        langs, confidence, each = self.judge([s for segs in files for s in segs])
        at = 0
        for segs in files:
            for i, s in enumerate(segs):
                s.lang, s.confidence = langs[at + i], float(confidence[at + i])
            sure: dict[str, list[int]] = {}
            for i, s in enumerate(segs):
                if len(s.words) >= 4 and s.confidence >= (0.99 if len(s.words) < 10 else 0.75):
                    sure.setdefault(s.family, []).append(i)
            taken = [(s.lang, s.confidence) for s in segs]
            for i, s in enumerate(segs):
                near = sure.get(s.family)
                if near and s.lang != UNKNOWN:
                    k = bisect.bisect_left(near, i)
                    if k < len(near) and near[k] == i:
                        continue
                    j = min(near[max(k - 1, 0) : k + 1], key=lambda x: (abs(x - i), x > i))
                    s.lang, before = taken[j]
                    q = float(each[at + i, self.names.index(s.lang)])
                    s.confidence = before * q / max(before * q + (1 - before) * (1 - q), 1e-9)
            at += len(segs)


def train(files: DataFrame, labels: DataFrame, max_files: int = 2_000, max_segments: int = 24_000, per_file: int = 40) -> Discriminator:
    """Machines fitted on segments of at most max_files labelled files, those with the smallest hash of file_id (a bounded sample).

    Of each file the per_file segments with the smallest hash are taken, wherever they stand in it, and of all these
    the max_segments with the smallest. Labels may be wrong: segments of another family than the file's label say
    nothing and are left out, and after a first fit the segments that the machines clearly contradict are dropped and
    the machines fitted once more.
    """
    known = labels.select("file_id", label(F.col("lang")).alias("lang")).filter("lang is not null").groupBy("file_id").agg(F.min("lang").alias("lang"), F.countDistinct("lang").alias("n")).filter("n = 1")
    sample = files.select("file_id", "pure_text", "headers").join(known, "file_id").withColumn("h", F.xxhash64("file_id")).orderBy("h", "file_id").limit(max_files)
    sample = sample.repartition(shuffle_width(files.sparkSession), "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, heads, lang in zip(b["file_id"], b["pure_text"], b["headers"], b["lang"], strict=True):
                fam = next(x for x, v in FAMILIES.items() if lang in v)
                own = [" ".join(w for w, _ in s.words) for s in segments(read(t, heads)) if s.family == fam and len(s.words) > 3]
                rows += sorted((zlib.crc32(f"{k} {i}".encode()), lang, x) for i, x in enumerate(own))[:per_file]
            yield pd.DataFrame(rows, columns=["h", "lang", "words"])

    pdf = sample.mapInPandas(run, "h long, lang string, words string").orderBy("h", "lang", "words").limit(max_segments).toPandas()[["lang", "words"]].drop_duplicates()
    machines = []
    for langs in FAMILIES.values():
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                machines.append(_duel(a, b, pdf))
    return Discriminator(machines)


_JUDGES: dict[str, Discriminator] = {}


def _of_worker(name: str, machines: Broadcast) -> Discriminator:
    """The discriminator of a broadcast, named anew for each, with what it has worked out, once in each worker."""
    if name not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[name] = Discriminator(machines.value)
    return _JUDGES[name]


def _duel(a: str, b: str, pdf: pd.DataFrame) -> Svm:
    rows = pdf[pdf.lang.isin([a, b])]
    cache: dict[str, list[int]] = {}
    x = []
    for s in rows.words:
        x.append(np.array([f for w in s.split(" ") for f in (cache.get(w) or cache.setdefault(w, features(w)))]))
    y = np.where(rows.lang == a, 1.0, -1.0)
    svm = Svm(a, b)
    if len(x) and abs(y.sum()) < len(y):
        rounds = max(2, -(-30_000 // len(x)))
        svm.fit(x, y, min(rounds, 10))
        margin = np.array([svm.margin(i) for i in x])
        keep = np.flatnonzero(y * margin > 0)
        svm.fit([x[i] for i in keep], y[keep], min(2 * rounds, 20))
        svm.slope = _slope(np.array([svm.margin(x[i]) for i in keep]), y[keep])
    return svm


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve through the margins (Platt's calibration without offset)."""
    slope = 1.0
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin * y, -30, 30)))
        slope += 2.0 * float(np.mean((1 - p) * margin * y)) / (float(np.mean(margin**2 * p * (1 - p))) + 1e-3)
        slope = min(max(slope, 0.1), 200.0)
    return slope


def page_languages(spark: SparkSession, files: DataFrame, labels: DataFrame, max_files: int = 2_000) -> DataFrame:
    """(file_id, page_no, lang, confidence, n_words, main, label): every language of every page of every file.

    Text in a script of no known family has the language und with confidence 0. main is the language of most words of the file, label what its label stands for (null without a usable one;
    of several usable ones the first in order). Files without a word of a language give no row.
    """
    machines, name = spark.sparkContext.broadcast(train(files, labels, max_files).machines), uuid.uuid4().hex
    usable = labels.select("file_id", label(F.col("lang")).alias("label")).groupBy("file_id").agg(F.min("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _of_worker(name, machines)
        for b in batches:
            rows = []
            cut = [segments(read(t, heads)) for t, heads in zip(b["pure_text"], b["headers"], strict=True)]
            judge.assign(cut)
            for k, segs in zip(b["file_id"], cut, strict=True):
                total: dict[str, int] = {}
                pages: dict[tuple[int, str], list[float]] = {}
                for s in segs:
                    total[s.lang] = total.get(s.lang, 0) + len(s.words)
                    for _, page in s.words:
                        c = pages.setdefault((page, s.lang), [0.0, 0])
                        c[0] += s.confidence
                        c[1] += 1
                if total:
                    main = max(total, key=lambda x: (total[x], x))
                    rows += [(k, p, lang, c / n, n, main) for (p, lang), (c, n) in pages.items()]
            yield pd.DataFrame(rows, columns=["file_id", "page_no", "lang", "confidence", "n_words", "main"])

    schema = "file_id long, page_no int, lang string, confidence double, n_words int, main string"
    found = files.select(F.col("file_id").cast("long").alias("file_id"), "pure_text", "headers").filter("pure_text is not null").mapInPandas(run, schema)
    return found.join(usable, "file_id", "left")


def to_relabel(pages: DataFrame) -> DataFrame:
    """(file_id, page_no, lang) of files without a usable label, with another label than their main language, or in several languages."""
    w = Window.partitionBy("file_id")
    several = F.min("lang").over(w) != F.max("lang").over(w)
    return pages.filter(F.col("lang") != UNKNOWN).withColumn("several", several).filter("label is null or label != main or several").select("file_id", "page_no", "lang").distinct()
