"""Blocks from a stream: each micro-batch is encoded alone and saved under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bitloom.operators import blocks


def encode(stream: DataFrame, path: str, checkpoint: str, *order: str, rows_a_block: int = blocks.ROWS_A_BLOCK, **trigger) -> StreamingQuery:
    """Starts the query. State begins anew in each block, so a batch needs nothing of those before.

    A batch that is run again after a failure overwrites its own folder, so rows are neither lost nor
    doubled. Row numbers count inside a batch. Both folders must be shared.
    """

    def save(batch: DataFrame, number: int) -> None:
        blocks.encode(batch, *order, rows_a_block=rows_a_block).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decode(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches saved so far."""
    return blocks.decode(spark.read.parquet(path), schema)
