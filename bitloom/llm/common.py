"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a model or lookup table that is ever broadcast; above it a shuffle join is used.
BROADCAST_ROWS = 100_000

#: Separators of words: space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own is set only where the session has none
    (tests, local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="bitloom-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside remove their shuffle files when an action on them ends; else these stay until the
    driver happens to collect its garbage. For results that need their shuffles no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is in no fold (false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def small_join(left: DataFrame, right: DataFrame, on, how: str, right_rows: int) -> DataFrame:
    """Join with a table whose row count is known: broadcast up to BROADCAST_ROWS rows, else shuffled."""
    return left.join(F.broadcast(right) if right_rows <= BROADCAST_ROWS else right, on, how)


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, which Arrow hands to Python without decoding."""
    return F.col(column).cast("binary")
