"""Checkpoints and row numbers that hold on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``, or, on a local master where that is unset, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="bitloom-"))
    return df.checkpoint()


def with_row_id(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """Consecutive row numbers from 0 in the given order, which should be total.

    Rows are range-partitioned and sorted once; a row's place in its partition plus the rows of all
    partitions before is its number, so that only the partitions' counts meet in one place. The
    partitions are checkpointed, since a range partitioning need not repeat.
    """
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    parts = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    counts = parts.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # As many rows as partitions: small by construction.
    out = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")
