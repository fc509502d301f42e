"""Numeric models: rank quantiles, 512-bucket histograms, weights, costs, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Values that prime the sketch, buckets, and the share that the range exceeds the quantiles by.
PRIME, BUCKETS, SPREAD = 5000, 512, 1.5


#: Relative rank error of the bounds below which a group's first rows are looked for.
RANK_ERROR = 1e-6


def _first_of_groups(df: DataFrame, order: list[str], groups: tuple[str, ...]) -> DataFrame:
    """``df`` cut to rows that may be among the first PRIME of their group: no whole group is shuffled or sorted.

    One pre-aggregated pass finds, per group, values of the first order column at halved ranks; rows above
    the least of them that surely has PRIME rows below it are left out. Rows without that value come first.
    """
    first, halves = F.col(order[0]), [2.0**-k for k in range(40)]
    found = df.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(F.count(first).alias("_n"), F.percentile_approx(first, halves, int(1 / RANK_ERROR)).alias("_q"))
    enough = F.floor(F.log2(F.col("_n") / (PRIME + 1 + 2 * RANK_ERROR * F.col("_n"))))
    found = found.withColumn("_upto", F.get("_q", F.greatest(enough, F.lit(0)).cast("int"))).drop("_n", "_q")
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return df.join(found, on).where(first.isNull() | F.col("_upto").isNull() | (first <= F.col("_upto"))).select(*df.columns)


def quantile_sketch(df: DataFrame, value: str, order: list[str], bin_size: float, *groups: str) -> DataFrame:
    """(groups..., n, p05, p95, mid, bb): ranks floor(.05 n) and floor(.95 n) of the first PRIME values.

    mid is the float32 middle; bb, the bins in a bucket, is the next power of two of 1.5 * range / bin
    div 510. The priming values are found by a bounded top-n (per group: a window over the rows below a bound,
    if the first order column has numbers or times; else over whole groups).
    """
    if groups:
        if isinstance(df.schema[order[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            df = _first_of_groups(df, order, groups)
        first = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        primed = df.withColumn("_r", first).where(F.col("_r") <= PRIME)
    else:
        primed = df.orderBy(*order).limit(PRIME)
    keys = [*groups] or [F.lit(0).alias("_g")]
    lists = primed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("v"))
    n = F.size("v")
    at = lambda q: F.get("v", F.floor(n * q).cast("int"))
    out = lists.select(*groups, n.cast("long").alias("n"), at(0.05).alias("p05"), at(0.95).alias("p95"))
    mid = (F.col("p05") + F.col("p95")) / 2
    mid = F.floor(mid) if bin_size == 1 else mid
    span = F.floor(SPREAD * (F.col("p95") - F.col("p05")) / bin_size).cast("long")
    per = F.expr("_span div 510")
    bb = F.when(F.col("_per") <= 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2("_per")))).cast("long")
    out = out.withColumn("mid", mid.cast("float").cast("double")).withColumn("_span", span).withColumn("_per", per)
    return out.withColumn("bb", bb).drop("_span", "_per")


def bin_index(value: Column, mid: Column, bin_size: float) -> Column:
    return F.floor((value - mid) / bin_size).cast("long")


def bucket(index: Column, bb: Column) -> Column:
    """Bucket 0..511 of a bin index; the ends take everything beyond."""
    return F.when(index <= -255 * bb, 0).when(index >= 255 * bb, 511).otherwise(F.floor(index / bb) + 256).cast("long")


def _joined(df: DataFrame, sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return df.join(sketch, list(groups)) if groups else df.join(F.broadcast(sketch))  # one row without groups


def bucket_histogram(df: DataFrame, value: str, sketch: DataFrame, bin_size: float, *groups: str) -> DataFrame:
    """(groups..., bucket, freq) of all 512 buckets; each starts from 1."""
    x = F.col(value).cast("double")
    rows = _joined(df.where(x.isNotNull()), sketch.select(*groups, "mid", "bb"), groups)
    rows = rows.withColumn("_i", bin_index(x, F.col("mid"), bin_size))
    counts = rows.groupBy(*groups, bucket(F.col("_i"), F.col("bb")).alias("bucket")).agg(F.count("*").alias("cnt"))
    cells = sketch.select(*groups, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))).alias("bucket"))
    return cells.join(counts, [*groups, "bucket"], "left").select(*groups, "bucket", (F.coalesce("cnt", F.lit(0)) + 1).alias("freq"))


def bucket_weights(hist: DataFrame, *groups: str) -> DataFrame:
    """``hist`` with w: freq * 65536 div total, 1 at least, the residue on the first largest (512 rows a group)."""
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    w0 = F.greatest(F.lit(1), F.expr("freq * 65536 div total"))
    out = hist.withColumn("total", F.sum("freq").over(over)).withColumn("w0", w0)
    out = out.withColumn("residue", 65536 - F.sum("w0").over(over)).withColumn("top", F.row_number().over(over.orderBy(F.desc("w0"), "bucket")))
    return out.select(*groups, "bucket", "freq", F.when(F.col("top") == 1, F.col("w0") + F.col("residue")).otherwise(F.col("w0")).cast("long").alias("w"))


def deviation(df: DataFrame, value: str, sketch: DataFrame, bin_size: float, *groups: str) -> DataFrame:
    """(groups..., n, mad, bits): mean absolute deviation from mid, and the Laplace cost of the values."""
    x = F.col(value).cast("double")
    rows = _joined(df.where(x.isNotNull()), sketch.select(*groups, "mid"), groups)
    sums = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.abs(x - F.col("mid"))).alias("s"))
    mad = F.when(F.col("s") < bin_size, 0.0).otherwise(F.col("s") / F.col("n"))
    bits = F.when(mad == 0, 0.0).otherwise(F.col("n") * (F.log2(mad) + 1 + F.log2(F.exp(F.lit(1.0))) - F.log2(F.lit(bin_size))))
    return sums.select(*groups, "n", F.round(mad, 6).alias("mad"), F.round(bits + 32 * 517 + 16 * len(groups) + 40, 2).alias("bits"))


def outliers(df: DataFrame, value: str, sketch: DataFrame, bin_size: float) -> DataFrame:
    """``df`` with in_range: the bin index lies strictly between the end buckets."""
    rows = df.join(F.broadcast(sketch.select("mid", "bb")))
    i = bin_index(F.col(value).cast("double"), F.col("mid"), bin_size)
    return rows.withColumn("in_range", (i > -255 * F.col("bb")) & (i < 255 * F.col("bb"))).drop("mid", "bb")


def quantise(value: Column, mid: Column, bin_size: float, decimals: int, nearest: bool = True) -> Column:
    """The value that comes back from its bin: the nearest bin's, or the lower edge's."""
    step = (value - mid) / bin_size
    return F.round(mid + F.floor(step + (0.5 if nearest else 0.0)) * bin_size, decimals)


def median_sketch(df: DataFrame, value: str, order: list[str], bin_size: float, sigmas: int, branches: int) -> DataFrame:
    """(n, median, spread, per_branch): the other layout, around the rank n div 2 of the priming values.

    spread is their mean distance from it; a branch holds 2 * sigmas * spread / bin bins over the inner
    branches, 1 at least.
    """
    lists = df.orderBy(*order).limit(PRIME).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("v")).where("size(v) > 0")
    mid = lists.select("v", F.size("v").cast("long").alias("n"), F.get("v", F.expr("cast(size(v) div 2 as int)")).alias("median"))
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("median"))) / F.col("n")
    out = mid.select("n", "median", spread.alias("spread"))
    per = F.greatest(F.lit(1), F.floor(F.floor(2 * sigmas * F.col("spread") / bin_size) / (branches - 2)))
    return out.select("n", "median", F.round("spread", 4).alias("spread"), per.cast("long").alias("per_branch"))
