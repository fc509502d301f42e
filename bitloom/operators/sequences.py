"""Row-sequential and nested models: Markov transitions, prefix deltas, JSON paths, series, large domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.functions.tokens import prefix_delta
from bitloom.plans.lineage import with_row_id
from bitloom.sources.documents import kind


def _in_blocks(df: DataFrame, order: str, rows_a_block: int):
    numbered = with_row_id(df, order).withColumn("block_id", F.expr(f"row_id div {rows_a_block}"))
    return numbered, Window.partitionBy("block_id").orderBy("row_id")


def markov_transitions(df: DataFrame, state: str, order: str, rows_a_block: int = 1024) -> DataFrame:
    """(prev, cur, cnt): states after the row before; empty at the start of each block."""
    numbered, over = _in_blocks(df, order, rows_a_block)
    pairs = numbered.select(F.coalesce(F.lag(state).over(over), F.lit("")).alias("prev"), F.col(state).alias("cur"))
    return pairs.groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


def prefix_deltas(df: DataFrame, text: str, order: str, rows_a_block: int = 1024) -> DataFrame:
    """(order, delta): common prefix with the string of the row before in the block."""
    numbered, over = _in_blocks(df, order, rows_a_block)
    return numbered.withColumn("before", F.lag(text).over(over)).select(order, prefix_delta(F.col(text), F.col("before")).alias("delta"))


def prefix_encode(df: DataFrame, text: str, order: str, rows_a_block: int = 1024) -> DataFrame:
    """(block_id, rows): per row of a block its order, how much it shares with the text before, and the rest."""
    numbered, over = _in_blocks(df.select(order, text), order, rows_a_block)
    delta = prefix_delta(F.col(text), F.lag(text).over(over)).cast("int")
    rest = numbered.withColumn("delta", delta).withColumn("rest", F.expr(f"substr(`{text}`, delta + 1)"))
    return rest.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("row_id", F.col(order).alias("key"), "delta", "rest"))).alias("rows"))


def prefix_decode(blocks: DataFrame, text: str, order: str) -> DataFrame:
    """(order, text) of the blocks of ``prefix_encode``: each text is the start of the one before and the rest; null stays null."""
    one = lambda before, e: F.concat(F.left(F.coalesce(before, F.lit("")), e["delta"]), e["rest"])
    start = F.array(F.lit(None).cast("string"))
    whole = F.aggregate("rows", start, lambda done, e: F.concat(done, F.array(one(F.element_at(done, -1), e))))
    out = blocks.select("rows", F.slice(whole, 2, F.size("rows")).alias("texts"))
    rows = out.select(F.explode(F.arrays_zip(F.col("rows.key").alias("key"), F.col("texts").alias("text"))).alias("e"))
    return rows.select(F.col("e.key").alias(order), F.col("e.text").alias(text))


def tree_groups(df: DataFrame, code: str) -> DataFrame:
    """(grp, term, cnt): codes of a large domain in two levels of 8192."""
    return df.groupBy(F.shiftright(code, 13).cast("long").alias("grp"), F.col(code).bitwiseAND(8191).cast("long").alias("term")).agg(F.count("*").alias("cnt"))


def json_members(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, cnt) of the members of JSON objects: how often each is there, with which type.

    A member's name is its path as it stands, dots included; what is no JSON object has no members.
    """
    values = df.select(F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = values.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("path"), kind(F.col("value")).alias("kind"))
    return each.groupBy("path", "kind").agg(F.count("*").alias("cnt"))


def json_lengths(df: DataFrame, column: str) -> DataFrame:
    """(path, elements, cnt): how long the arrays among the members of JSON objects are, and how often."""
    values = df.select(F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = values.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).where(F.schema_of_variant("value").startswith("ARRAY"))
    return each.groupBy(F.col("key").alias("path"), F.size(F.col("value").cast("array<variant>")).alias("elements")).agg(F.count("*").alias("cnt"))


def json_existence(df: DataFrame, column: str) -> DataFrame:
    """(path, present, absent) over all objects."""
    total = df.where(F.json_object_keys(column).isNotNull()).agg(F.count("*").alias("all"))
    there = df.select(F.explode(F.json_object_keys(column)).alias("path")).groupBy("path").agg(F.count("*").alias("present"))
    return there.join(F.broadcast(total)).select("path", "present", (F.col("all") - F.col("present")).alias("absent"))


def series_residuals(df: DataFrame, series: str, bin_size: float) -> DataFrame:
    """(bin, cnt) of all elements of the series, as residuals from mean 0 (no autoregression is fitted)."""
    each = df.select(F.explode(series).alias("x")).select(F.col("x").cast("double").alias("x"))
    return each.groupBy(F.floor(F.col("x") / bin_size).cast("long").alias("bin")).agg(F.count("*").alias("cnt"))


def autoregression(df: DataFrame, key: str, series: str, mean: float, coefficients: list[float]) -> DataFrame:
    """(key, t, residual): elements less their estimate, mean plus the weighted elements before (nearest first).

    Elements with fewer before them than there are coefficients are estimated by the mean alone.
    """
    x = F.col(series).cast("array<double>")
    before = lambda i: sum((F.get(x, i - k - 1) * c for k, c in enumerate(coefficients)), F.lit(float(mean)))
    out = F.transform(x, lambda v, i: v - F.when(i >= len(coefficients), before(i)).otherwise(F.lit(float(mean))))
    return df.select(key, F.posexplode(out).alias("t", "residual"))


def group_transitions(df: DataFrame, state: str, key: str, order: str) -> DataFrame:
    """(prev, cur, cnt): states after the one before in their key's sequence; empty at its start.

    Ties in ``order`` fall in the states' order. Spark sorts a key's rows on disk where it must.
    """
    over = Window.partitionBy(key).orderBy(order, state)
    pairs = df.select(F.coalesce(F.lag(state).over(over), F.lit("")).alias("prev"), F.col(state).alias("cur"))
    return pairs.groupBy("prev", "cur").agg(F.count("*").alias("cnt"))
