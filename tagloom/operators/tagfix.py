"""Misread equipment tags corrected against the registry."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import shuffle_width

# --- fixed values ---------------------------------------------------------------------------------
MISREAD = {
    "$": "S", "]": "J", "[": "J", "|": "I", "{": "C", "}": "C", "(": "C", ")": "J", "@": "0",
    "А": "A", "а": "A", "В": "B", "в": "B", "С": "C", "с": "C", "Е": "E", "е": "E", "Н": "H", "н": "H", "К": "K", "к": "K", "М": "M", "м": "M",
    "О": "O", "о": "O", "Р": "P", "р": "P", "Т": "T", "т": "T", "Х": "X", "х": "X", "У": "Y", "у": "Y",
    "v": "V", "h": "H", "s": "S", "j": "J", "b": "B", "p": "P", "g": "G", "c": "C", "f": "F", "w": "W", "l": "L",
}
CANDIDATE = r"\b[A-Za-zА-Яа-я0-9$\]\[|@()]{2,8}(?:\s*-\s*[A-Za-zА-Яа-я0-9$\]\[|@()]{1,8}){2,7}\b"
CUTOFF = 0.7
# --------------------------------------------------------------------------------------------------


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, cleaned): everything in the text that may be a tag, and what it is after the usual misreadings are undone."""
    raw = F.regexp_extract_all(F.col(text), F.lit(f"({CANDIDATE})"), F.lit(1))
    cleaned = F.upper(F.translate(F.regexp_replace("raw", " ", ""), "".join(MISREAD), "".join(MISREAD.values())))
    return df.select(key, F.explode(raw).alias("raw")).withColumn("cleaned", cleaned)


class Registry:
    """Registry tags by length, with the counts of their characters.

    The ratio of two texts is twice their matching characters over their lengths, and no more characters match than
    the texts have in common without regard to order. So a tag is compared only while that bound can beat the best
    ratio found, from the largest bound down; nothing at CUTOFF or more is missed.
    """

    def __init__(self, tags: list[str]):
        self.signs = {c: i for i, c in enumerate(sorted(set("".join(tags))))}
        by: dict[int, list[str]] = {}
        for t in sorted(set(tags)):
            by.setdefault(len(t), []).append(t)
        self.by = {n: (ts, np.stack([self._counts(t) for t in ts])) for n, ts in by.items() if n}

    def _counts(self, tag: str) -> np.ndarray:
        return np.bincount([self.signs[c] for c in tag if c in self.signs], minlength=len(self.signs)).astype("int16")

    def nearest(self, word: str) -> tuple[float, str] | None:
        """(ratio, tag) of the closest tag by at least CUTOFF, of equal ones the last in order."""
        own, bounds, names = self._counts(word), [], []
        for n, (tags, counts) in self.by.items():
            if 2 * min(n, len(word)) >= CUTOFF * (n + len(word)):
                bound = 2.0 * np.minimum(counts, own).sum(1) / (n + len(word))
                at = np.flatnonzero(bound >= CUTOFF)
                bounds.append(bound[at])
                names += [tags[i] for i in at]
        best: tuple[float, str] | None = None
        if names:
            bound = np.concatenate(bounds)
            matcher = difflib.SequenceMatcher(None)
            matcher.set_seq2(word)
            for i in np.argsort(-bound, kind="stable").tolist():
                if best and bound[i] < best[0]:
                    break
                matcher.set_seq1(names[i])
                ratio = matcher.ratio()
                if ratio >= CUTOFF and (best is None or (ratio, names[i]) > best):
                    best = (ratio, names[i])
        return best


def corrected(spark: SparkSession, found: DataFrame, registry: DataFrame, block: int = 500_000) -> DataFrame:
    """found with fixed: the registry's tag if it is one, else the closest registry tag by at least CUTOFF, else the cleaned form.

    Exact ones go by an equi-join. The distinct others, a query set, are compared with the registry block tags at a
    time, each block broadcast; what has the largest (ratio, tag) over all blocks wins.
    """
    tags = registry.select(F.col("tag_number").alias("tag")).filter("tag is not null").distinct()
    exact = found.join(tags.withColumnRenamed("tag", "fixed"), F.col("cleaned") == F.col("fixed"), "left")
    open_ = exact.filter("fixed is null").select("cleaned").distinct()
    n = max(1, -(-tags.count() // block))
    close = None
    for i in range(n):
        known = spark.sparkContext.broadcast([r[0] for r in tags.filter(F.pmod(F.xxhash64("tag"), F.lit(n)) == i).collect()])

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            own = Registry(known.value)
            for b in batches:
                near = [own.nearest(w) for w in b["cleaned"]]
                yield pd.DataFrame([(w, *m) for w, m in zip(b["cleaned"], near, strict=True) if m], columns=["cleaned", "score", "near"])

        part = open_.repartition(shuffle_width(spark), "cleaned").mapInPandas(run, "cleaned string, score double, near string")
        close = part if close is None else close.unionByName(part)
    best = close.groupBy("cleaned").agg(F.max(F.struct("score", "near")).alias("m")).select("cleaned", F.col("m.near").alias("near"))
    return exact.join(best, "cleaned", "left").withColumn("fixed", F.coalesce("fixed", "near", "cleaned")).drop("near")


def repaired(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """(key, text): each text with its candidates, as candidates() found them, replaced by what corrected() made of them; the fixes of a text go to its row as one small map."""
    own = fixes.groupBy(key).agg(F.array_distinct(F.collect_list(F.struct("raw", "fixed"))).alias("__f"))
    pattern = re.compile(CANDIDATE)

    @F.pandas_udf("string")
    def put(t: pd.Series, f: pd.Series) -> pd.Series:
        maps = ({x["raw"]: x["fixed"] for x in fs} if fs is not None else {} for fs in f)
        return pd.Series([pattern.sub(lambda m, own=own: own.get(m[0], m[0]), a) if a and own else a for a, own in zip(t, maps, strict=True)], dtype=object)

    return df.select(key, F.col(text).alias("text")).join(own, key, "left").select(key, put("text", "__f").alias("text"))
