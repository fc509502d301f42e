"""Enum dictionaries: dense codes by first appearance, encoding and decoding by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.lineage import with_row_id

#: Dictionaries up to so many entries are broadcast.
BROADCAST_ENTRIES = 100_000


def build(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes from 0 in the order in which values first appear by ``order``; null is no value."""
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("_first"))
    return with_row_id(first, "_first", "value", name="code").select("value", "code")


def _sized(dictionary: DataFrame) -> DataFrame:
    return F.broadcast(dictionary) if dictionary.count() <= BROADCAST_ENTRIES else dictionary


def encode(df: DataFrame, value: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with ``value`` replaced by its code; null stays null."""
    d = _sized(dictionary).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.join(d, F.col(value) == F.col("_value"), "left")
    return out.select(*(F.col("_code").alias(c) if c == value else F.col(c) for c in df.columns))


def decode(df: DataFrame, value: str, dictionary: DataFrame) -> DataFrame:
    d = _sized(dictionary).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.join(d, F.col(value) == F.col("_code"), "left")
    return out.select(*(F.col("_value").alias(c) if c == value else F.col(c) for c in df.columns))
