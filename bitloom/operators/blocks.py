"""Blocks of rows: the unit of storage, random access and independent decoding.

A block is one row: its number, its first row, how many it has, and a struct with an array per column.
Integers, dates, times and decimals of up to 18 digits become differences from the block's least value
(kept in a struct of its own; 0 where a block's range is over 63 bits), other values stay; Parquet's
dictionary, run-length and zstd encodings do the entropy coding of the arrays (see README: the bit-level
coders of the design are not rebuilt). All row-sequential state starts anew in each block. As the caller's
columns stand in a struct, their names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.plans.lineage import with_row_id

ROWS_A_BLOCK = 1024


def _as_long(column: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (column * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    return None


def _from_long(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(column.cast("int"))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(column).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(column)
    if isinstance(kind, T.DecimalType):
        return (column.cast("decimal(19,0)") / F.lit(10**kind.scale).cast("decimal(19,0)")).cast(kind)
    return column.cast(kind)


def encode(df: DataFrame, *order: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(block_id, first_row, n_rows, base, data): base has a number for each column that holds numbers, data an array for each.

    Rows are numbered in the order given (a total one); a null keeps its place in the array. Rows of a
    block meet by a shuffle on block_id; blocks have a fixed size, so no group grows with the data.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    packed = [(x if (x := _as_long(F.col(c), k)) is not None else F.col(c)).alias(c) for c, k in kinds.items()]
    # Numbers keep their columns' order, so that the packed row sorts like the caller's.
    rows = df.select(F.struct(*packed).alias("row"))
    numbered = with_row_id(rows, *(F.col("row").getField(c) for c in order))
    numbered = numbered.select(F.expr(f"row_id div {rows_a_block}").alias("block_id"), F.struct("row_id", "row").alias("e"))
    out = numbered.groupBy("block_id").agg(F.sort_array(F.collect_list("e")).alias("e"), F.min("e.row_id").alias("first_row"), F.count("*").alias("n_rows"))
    values = lambda c: F.col("e.row").getField(c)
    numbers = [c for c, k in kinds.items() if _as_long(F.lit(0), k) is not None]
    least = lambda c: F.array_min(values(c))
    wide = lambda c: F.try_subtract(F.array_max(values(c)), least(c)).isNull() & least(c).isNotNull()
    # The base is a column of its own first: inside the lambda it would be searched for again per value.
    base = F.struct(F.lit(0).alias("version"), *(F.when(wide(c), F.lit(0).cast("long")).otherwise(least(c)).alias(c) for c in numbers))
    staged = out.select("block_id", "first_row", "n_rows", "e", base.alias("base"))
    minus = lambda c: F.transform(values(c), lambda v: v - F.col("base").getField(c))
    data = F.struct(*((minus(c) if c in numbers else values(c)).alias(c) for c in kinds))
    return staged.select("block_id", "first_row", "n_rows", "base", data.alias("data"))


def decode(blocks: DataFrame, schema: T.StructType, row_id: bool = False) -> DataFrame:
    """The rows of ``blocks``; columns that are not asked for afterwards are not read. row_id comes first where it is asked for."""
    kinds = {f.name: f.dataType for f in schema.fields}
    places = F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)
    arrays = [F.col("data").getField(c).alias(f"v{i}") for i, c in enumerate(kinds)]
    staged = blocks.select("first_row", "base", *arrays, places.alias("place"))
    rows = staged.select("first_row", "base", F.explode(F.arrays_zip(*(f"v{i}" for i in range(len(kinds))), "place")).alias("e"))
    number = lambda c, k, v: _from_long(v + F.col("base").getField(c), k) if _as_long(F.lit(0), k) is not None else v
    columns = [number(c, k, F.col("e").getField(f"v{i}")).alias(c) for i, (c, k) in enumerate(kinds.items())]
    return rows.select(*([(F.col("first_row") + F.col("e.place")).alias("row_id")] if row_id else []), *columns)


def index(blocks: DataFrame) -> DataFrame:
    """(block_id, first_row, n_rows)."""
    return blocks.select("block_id", "first_row", "n_rows")


def locate(ids: DataFrame, row_id: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """``ids`` with the block and the place in it: an equation, since blocks have a fixed size."""
    return ids.withColumn("block_id", F.expr(f"{row_id} div {rows_a_block}")).withColumn("place", F.expr(f"{row_id} % {rows_a_block}"))


def lookup(blocks: DataFrame, schema: T.StructType, ids: list[int], rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """The rows with the given numbers: only their blocks are read (a pushed-down filter), then decoded."""
    wanted = sorted({i // rows_a_block for i in ids})
    return decode(blocks.where(F.col("block_id").isin(wanted)), schema, row_id=True).where(F.col("row_id").isin(list(ids)))


def rows(blocks: DataFrame, schema: T.StructType, ids: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(row_id, columns...) of the row numbers in ``ids`` (row_id): only their blocks are decoded.

    The ids may be many: they meet the blocks in a join on the block's number, and are never collected.
    """
    wanted = ids.select(F.col("row_id").cast("long")).distinct()
    number = F.expr(f"row_id div {rows_a_block}").alias("block_id")
    held = blocks.join(wanted.select(number).distinct(), "block_id", "left_semi")
    return decode(held, schema, row_id=True).join(wanted, "row_id", "left_semi")
