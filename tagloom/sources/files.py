"""Readers and writers: recognised words from XML, tag registries, registers, property dumps, page checkpoints, binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------------
JUNK = r"^[\s|L_;*]*$"
REGISTER_COLUMNS = ["tag_number", "property_name", "property_name_rus", "property_value", "property_description_rus", "uom"]
DUMP = "id string, names struct<EN:string,RU:string>, comments struct<EN:string,RU:string>"
# --------------------------------------------------------------------------------------------------
WORDS = T.StructType([T.StructField(n, T.StringType() if n in ("class", "id", "parent", "value") else T.IntegerType()) for n in ("page", "class", "id", "parent", "value", "confidence", "x1", "y1", "x2", "y2")])


def recognised_words(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, ord, value, confidence, x1, y1, x2, y2) of each word of recognised pages in XML; words of junk only are empty, missing boxes zero."""
    q = "//*[@class='ocrx_word']"
    parts = F.arrays_zip(F.xpath(F.col(xml), F.lit(f"{q}/text()")).alias("value"), F.xpath(F.col(xml), F.lit(f"{q}/@title")).alias("title"))
    w = pages.select(key, F.posexplode(parts).alias("ord", "w")).select(key, "ord", "w.value", "w.title")
    number = lambda i: F.coalesce(F.regexp_extract("title", r"bbox (\d+) (\d+) (\d+) (\d+)", i).try_cast("int"), F.lit(0))
    return w.select(
        key, "ord", F.when(F.col("value").rlike(JUNK), "").otherwise(F.col("value")).alias("value"), F.regexp_extract("title", r"x_wconf (\d+)", 1).try_cast("int").alias("confidence"),
        *(number(i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The tags of a registry file, one a line, each once; a byte order mark and blank lines don't count."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("tag")).filter("tag != ''").distinct()


def write_registry(tags: DataFrame, path: str) -> None:
    tags.select("tag").distinct().write.mode("overwrite").text(path)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A register from Parquet or CSV; raises if a column is missing. Spreadsheets are read where openpyxl can be imported."""
    if path.endswith((".xlsx", ".xlsm")):
        import openpyxl
        import pandas as pd

        sheet = openpyxl.load_workbook(path, read_only=False, data_only=True).worksheets[0]
        ref = next(iter(sheet.tables.values())).ref
        head, *rows = [[c.value for c in row] for row in sheet[ref]]
        pdf = pd.DataFrame(rows, columns=[str(h).strip().lower().replace(" ", "_") for h in head]).astype(object)
        df = spark.createDataFrame(pdf.where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns))
    else:
        df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
        for c in df.columns:
            df = df.withColumnRenamed(c, c.strip().lower().replace(" ", "_"))
    missing = [c for c in REGISTER_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the register lacks {', '.join(missing)}")
    return df


def write_register(register: DataFrame, path: str) -> None:
    """The filled register as Parquet, or as CSV with a header where path ends so; written anew."""
    out = register.write.mode("overwrite")
    out.option("header", True).csv(path) if path.endswith(".csv") else out.parquet(path)


def ingest_folder(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(file_name, length, content) of every document under a folder that known (file_name) lacks: one job over the folder, however many files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")
    return found if known is None else found.join(known.select("file_name").distinct(), "file_name", "left_anti")


def read_dumps(spark: SparkSession, *paths: str) -> DataFrame:
    """Property dumps of several JSON files, one behind the other."""
    out = None
    for p in paths:
        df = spark.read.json(p, schema=DUMP, multiLine=True)
        out = df if out is None else out.unionByName(df)
    return out


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): scanned documents of a folder as rows, one job for all, for a render and recognition stage in mapInPandas."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def page_range(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """files (with pages) with a row for each page from first to last, both included, counted from 0 and kept within the file; all pages without bounds. Files without pages give no row."""
    low = F.greatest(F.lit(first or 0), F.lit(0)).cast("long")
    high = F.col("pages").cast("long") - 1 if last is None else F.least(F.lit(last).cast("long"), F.col("pages").cast("long") - 1)
    return files.withColumn("page", F.explode(F.when(F.col("pages").isNotNull() & (high >= low), F.sequence(low, high))))


def not_done(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages without a checkpoint; checkpoints are kept by file and page."""
    return pages.join(done.select("file_id", "page").distinct(), ["file_id", "page"], "left_anti")


def write_checkpoint(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").parquet(path)
