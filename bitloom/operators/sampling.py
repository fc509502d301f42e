"""Samples that come out the same on every run: draws with replacement, and shares by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.plans.lineage import with_row_id


def _number(*parts: Column) -> Column:
    """A number below 2**32 from the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def with_replacement(df: DataFrame, order: str, n: int = 5000, seed: int = 0) -> DataFrame:
    """(draw, columns...): ``n`` rows drawn uniformly, with repeats. An empty table gives none.

    The draws are a small table (n is a parameter) that meets the numbered rows in a join.
    """
    rows = with_row_id(df, order)
    size = rows.agg(F.count("*").alias("_size"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(size)).where("_size > 0")  # size is one row
    draws = draws.select("draw", (_number(F.lit(seed), F.col("draw")) % F.col("_size")).alias("row_id"))
    return rows.join(F.broadcast(draws), "row_id").drop("row_id")


def share(df: DataFrame, key: str, part: float, seed: int = 0) -> DataFrame:
    """Rows whose key's hash falls in the first ``part`` of all: independent of order and partitions."""
    return df.where(_number(F.lit(seed), F.col(key)) < int(part * 2**32))
