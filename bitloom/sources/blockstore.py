"""Blocks as a Parquet table: written once, read by rows or by row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.operators import blocks


def write(df: DataFrame, path: str, *order: str, rows_a_block: int = blocks.ROWS_A_BLOCK) -> None:
    """Encodes and saves; blocks are sorted by number in each file, so that numbers prune row groups."""
    packed = blocks.encode(df, *order, rows_a_block=rows_a_block)
    packed.sortWithinPartitions("block_id").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows, columns as in ``schema`` (a part of the columns reads only theirs)."""
    return blocks.decode(spark.read.parquet(path), schema)


def rows(spark: SparkSession, path: str, schema: T.StructType, ids: DataFrame, rows_a_block: int = blocks.ROWS_A_BLOCK) -> DataFrame:
    """(row_id, columns...) of the row numbers in ``ids`` (row_id), as ``blocks.rows`` finds them."""
    return blocks.rows(spark.read.parquet(path), schema, ids, rows_a_block)


def factor(spark: SparkSession, path: str, rendered: DataFrame) -> DataFrame:
    """(text_bytes, stored_bytes, factor): size as comma-separated text against the files' size."""
    text = rendered.select(sum((F.coalesce(F.octet_length(c), F.lit(0)) + 1 for c in rendered.columns), F.lit(0).cast("long")).alias("b")).agg(F.sum("b").alias("text_bytes"))
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("stored_bytes"))
    return text.join(F.broadcast(files)).select("text_bytes", "stored_bytes", (F.col("text_bytes") / F.col("stored_bytes")).alias("factor"))  # one row each
