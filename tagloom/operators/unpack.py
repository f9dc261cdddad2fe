"""Several values packed in one field, one row per value (problem 5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ",;|，；/'\"\\[\\]\\\\\n\t\r"
PIECE = f"[{MARKS}]|[ \\u00a0]+|[^{MARKS} \\u00a0]+"
RULE = "array<array<int>>"


def skeleton(c: Column) -> Column:
    """The field with every run of ordinary characters as x; one character for each piece of pieces()."""
    return F.regexp_replace(F.regexp_replace(c, f"[^{MARKS} \\u00a0]+", "x"), "[ \\u00a0]+", " ")


def pieces(c: Column) -> Column:
    """The field cut into single marks, runs of spaces and runs of ordinary characters; joined they are the field again."""
    return F.regexp_extract_all(c, F.lit(f"({PIECE})"), F.lit(1))


def resolve(skel: str, spaces_split: bool) -> list[list[int]]:
    """For each value of a field with this skeleton the numbers of the pieces that make it up.

    Marks , ; | tab and newline part values, a slash only between spaces, spaces only where spaces_split is set. A
    value may stand in single or double quotes, in which marks don't part; a doubled or escaped quote inside them is
    one quote. A list in square brackets is unwrapped. Slots without a value give nothing.
    """
    s, values, n = skel, [], len(skel)
    i = 0
    lo, hi = len(s) - len(s.lstrip()), len(s.rstrip())
    if hi - lo >= 2 and s[lo] == "[" and s[hi - 1] == "]":
        i, n = lo + 1, hi - 1
    blank = " \n\t\r"

    def parts(k: int) -> int:
        """How many pieces the separator at k has; 0: none."""
        if s[k] in ",;|，；\n\t\r":
            return 1
        if s[k] == "/" and 0 < k < n - 1 and s[k - 1] == " " and s[k + 1] == " ":
            return 1
        if s[k] == "/" and s[k - 1 : k] == " " and k == n - 1:
            return 1
        return int(spaces_split and s[k] == " ")

    while i < n:
        while i < n and (s[i] in blank or parts(i)):
            i += 1
        if i >= n:
            break
        take: list[int] = []
        if s[i] in "'\"":
            q, k = s[i], i + 1
            while k < n:
                if s[k] == "\\" and k + 1 < n and s[k + 1] in "'\"\\":
                    take.append(k + 1)
                    k += 2
                elif s[k] == q and k + 1 < n and s[k + 1] == q:
                    take.append(k)
                    k += 2
                elif s[k] == q:
                    break
                else:
                    take.append(k)
                    k += 1
            rest = k + 1
            while rest < n and s[rest] == " " and not parts(rest):
                rest += 1
            if k < n and (rest >= n or parts(rest) or s[rest] in blank):
                while take and s[take[0]] in blank:
                    take.pop(0)
                while take and s[take[-1]] in blank:
                    take.pop()
                if take:
                    values.append(take)
                i = rest
                continue
            take = []
        k = i
        while k < n and not parts(k):
            take.append(k)
            k += 1
        while take and s[take[-1]] in blank:
            take.pop()
        if take:
            values.append(take)
        i = k
    return values


def values_of(df: DataFrame, key: str, field: str, spaces_split: bool) -> DataFrame:
    """(key, pos, item) for every value of a packed field; pos counts from 0 in the field's order.

    The rules are worked out once for each distinct skeleton and joined to the rows by it; whether they are broadcast
    is left to the planner, which knows their size at run time. Values are then cut out by position. White space
    around a value and its quotes go, its other characters stay as they are. Null and blank fields give no row,
    repeated values count again, other columns are ignored.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(field).alias("__field")).filter("__field is not null")
    rows = rows.select("__key", skeleton(F.col("__field")).alias("__skel"), pieces(F.col("__field")).alias("__pieces"))

    @F.pandas_udf(RULE)
    def rule(s: pd.Series) -> pd.Series:
        return s.map(lambda x: resolve(x, spaces_split))

    rules = rows.select("__skel").distinct().select("__skel", rule("__skel").alias("__rule"))
    cut = rows.join(rules, "__skel").select("__key", F.posexplode(F.transform("__rule", lambda r: F.array_join(F.transform(r, lambda i: F.get(F.col("__pieces"), i)), ""))).alias("pos", "item"))
    return cut.select(F.col("__key").alias(key), "pos", "item")


def unpack(files: DataFrame, properties: DataFrame) -> DataFrame:
    """(field, rec_id, pos, item) for files.mentioned_tags and properties.alt_keywords; the text none is no value."""
    keywords = properties.filter(~F.lower(F.trim("alt_keywords")).isin("none"))
    a = values_of(files, "file_id", "mentioned_tags", True).select(F.lit("mentioned_tags").alias("field"), F.col("file_id").cast("long").alias("rec_id"), "pos", "item")
    b = values_of(keywords, "prop_id", "alt_keywords", False).select(F.lit("alt_keywords").alias("field"), F.col("prop_id").cast("long").alias("rec_id"), "pos", "item")
    return a.unionByName(b)


def several(values: DataFrame) -> DataFrame:
    """The values of fields that hold two or more."""
    from pyspark.sql import Window

    n = F.max("pos").over(Window.partitionBy("field", "rec_id"))
    return values.withColumn("__n", n).filter("__n > 0").drop("__n")
