"""Session settings and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "tagloom") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the session's checkpoint folder, so that later uses don't compute it again.

    The folder is the one the session names in spark.checkpoint.dir, which all executors share; only where none is
    named and everything runs on one machine, as in tests, a temporary one is made, which goes with the process. A
    cluster without one is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="tagloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its number of rows as name once df has been computed; Spark's own metrics have the time."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Let the Python workers of this session find the package where the driver has it, if it isn't installed.

    On a cluster whose machines don't share that folder the package is given with --py-files.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    reachable(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for RDD shuffles: what the session uses for DataFrames."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A broadcast hint only where at most max_rows rows were counted; beyond it the planner picks a shuffle join.

    Meant for tables of fixed size (dictionaries, lists); the count stops after max_rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
