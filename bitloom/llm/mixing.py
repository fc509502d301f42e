"""Mixing sources to target weights: whole copies, then Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.llm.common import SPACES, checkpoint, small_join

#: Weights of the sources in code point order, repeating; the mix as a share of all words; most copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
#: Exponent of the size in the inclusion probabilities: longer documents are somewhat likelier to be drawn.
TILT = 0.5
#: Rank of documents that are included for certain.
CERTAIN = -1e9
SEED = "mix-1"
#: Cells on each of the two levels of the search for a source's cut; a cell of a cell is read in order.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _odds(doc_id: Column, text: Column, seed: str) -> Column:
    """Log of the random odds u/(1-u); u comes from an MD5 of seed and id (of the text where the id is null), so reruns agree."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 13)
    u = (F.conv(hexes, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return F.log(u / (1 - u))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: float = COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with target: weights by rank, capped, the excess reshared by weight.

    Sources rank by code point, null last. The rank is found without a global window: a range
    partitioning, ranks inside the parts, and the parts' offsets. Each round of resharing caps every
    source whose share is above ``copies`` times its size; only sums come back to the driver.
    """
    key = [F.col("source").isNull(), F.col("source")]
    parts = checkpoint(sizes.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("before") + F.col("inside") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = parts.withColumn("inside", inside).join(before, "part")
    ranked = checkpoint(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (copies * F.col("source_size")).cast("double").alias("cap")))
    total = share * (ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * level
        now = ranked.agg(
            F.count(F.when(full, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if now.capped == capped or not now.weights:
            break
        capped, level = now.capped, (total - now.fixed) / now.weights
    return ranked.select("source", "source_size", F.round(F.least("cap", F.col("weight") * level), 6).alias("target"))


def _cuts(ranked: DataFrame, model: DataFrame, n_sources: int) -> DataFrame:
    """``model`` with the cell (c1, c2) and key (q) up to which a source's documents are drawn.

    Sums of cells are pre-aggregated, so a source of any size is cut without ordering its rows: first
    among CELLS cells of the key, then among CELLS parts of the cell that holds the cut, and only
    that part's few rows are read in order. Documents are drawn while that brings the words closer.
    """
    at = ranked.where("size > 0 and q is not null")
    for level in ("c1", "c2"):
        keys = ["source", *(["c1"] if level == "c2" else [])]
        rows = at.groupBy("source", *["c1", "c2"][: 2 if level == "c2" else 1]).agg(F.sum("size").alias("words"))
        over = Window.partitionBy(*keys).orderBy(level)
        rows = rows.withColumn("upto", F.sum("words").over(over))
        rows = rows.withColumnRenamed("source", "s")
        on = F.col("source").eqNullSafe(F.col("s")) & (F.lit(True) if level == "c1" else F.col("c1") == F.col("cut1"))
        found = small_join(rows, model, on, "inner", n_sources).where(F.col("base") + F.col("upto") >= F.col("rest"))
        found = found.groupBy("source").agg(F.min(F.struct(level, (F.col("base") + F.col("upto") - F.col("words")).alias("b"))).alias("m"))
        found = found.select(F.col("source").alias("s"), F.col(f"m.{level}").alias("cut" + level[1]), F.col("m.b").alias("b"))
        model = model.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        model = checkpoint(model.withColumn("base", F.coalesce("b", "base")).drop("b"))
        cells = model.where(F.col("cut" + level[1]).isNotNull()).withColumnRenamed("source", "s")
        inside = [F.col("source").eqNullSafe(F.col("s")), F.col("c1") == F.col("cut1")] + ([F.col("c2") == F.col("cut2")] if level == "c2" else [])
        on = inside[0]
        for x in inside[1:]:
            on = on & x
        at = small_join(ranked.where("size > 0 and q is not null"), cells, on, "inner", n_sources)
        at = at.select("source", "size", "q", "c1", "c2", "base", "rest") if level == "c2" else at.select("source", "size", "q", "c1", "c2")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    last = at.withColumn("run", run).where(2 * (F.col("base") + F.col("run")) - F.col("size") <= 2 * F.col("rest"))
    last = last.groupBy("source").agg(F.max("q").alias("cutq")).withColumnRenamed("source", "s")
    return model.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "rest", "rate", "cut1", "cut2", "cutq")


def inclusion(rows: DataFrame, model: DataFrame, n_sources: int) -> DataFrame:
    """``model`` with rate: a document of the source is drawn with probability least(1, rate * size ** TILT).

    The probabilities times the sizes sum to the words that are left to draw (rest). Sizes whose
    probability would be above 1 are certain, and the others share what these leave: found over the source's
    distinct sizes, in one window over this histogram, which grows with the longest text and not with the
    number of documents. No rate: all documents are certain.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    sizes = small_join(sizes, model.where("rest > 0").select("source", "rest"), F.col("source").eqNullSafe(F.col("s")), "inner", n_sources)
    own = Window.partitionBy("s")
    words = F.sum(F.col("n") * F.col("size"))
    above = words.over(own.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("size")
    below = F.sum(F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1 + TILT))).over(own.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rates = sizes.withColumn("rate", (F.col("rest") - above) / below)
    fits = rates.where(F.col("rate") * F.pow(F.col("size").cast("double"), F.lit(TILT)) <= 1)
    rates = fits.groupBy("s").agg(F.max_by("rate", "size").alias("rate"))
    return model.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _ranked(rows: DataFrame, model: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` (source, size, odds and others) with their source's model, q (log of random odds over inclusion odds) and its cells c1, c2."""
    model = model.withColumnRenamed("source", "s")
    out = small_join(rows, model, F.col("source").eqNullSafe(F.col("s")), "left", n_sources).drop("s")
    pi = F.col("rate") * F.pow(F.col("size").cast("double"), F.lit(TILT))
    q = F.when(F.col("rate").isNull() | (pi >= 1), F.lit(CERTAIN)).otherwise(F.col("odds") - F.log(pi / (1 - pi)))
    scaled = (F.least(F.greatest(F.col("q"), F.lit(-64.0)), F.lit(63.999999)) + 64) / 128 * CELLS
    out = out.withColumn("q", F.when(F.col("size") > 0, q))
    return out.withColumn("c1", F.floor(scaled).cast("int")).withColumn("c2", F.floor((scaled - F.col("c1")) * CELLS).cast("int"))


def mix_model(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, int]:
    """Per source of ``rows`` (source, size, odds): source_size, target, whole copies of every document, rate, and the cut of the sample; and how many sources."""
    sizes = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    model = source_targets(sizes, weights, share, copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    model = model.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    model = checkpoint(model.withColumn("base", F.lit(0).cast("double")))
    n = model.count()
    model = checkpoint(inclusion(rows, model, n))
    ranked = _ranked(rows.select("source", "size", "odds"), model.select("source", "rate"), n).select("source", "size", "q", "c1", "c2")
    return checkpoint(_cuts(ranked, model, n)), n


def _copies() -> Column:
    """Copies of a row of ``ranked`` joined with its source's model."""
    drawn = (F.col("c1") < F.col("cut1")) | (
        (F.col("c1") == F.col("cut1")) & ((F.col("c2") < F.col("cut2")) | ((F.col("c2") == F.col("cut2")) & (F.col("q") <= F.col("cutq"))))
    )
    # No cell reaches the rest: all documents are drawn (the rest is all words but for rounding).
    drawn = F.when(F.col("rest") <= 0, False).when(F.col("cut1").isNull(), True).otherwise(F.coalesce(drawn, F.lit(False)))
    return F.col("whole") + F.when(drawn & (F.col("size") > 0), 1).otherwise(0)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Every document gets floor(target / source_size) whole copies; the source's remaining words come
    from a Pareto order sample: each document has an inclusion probability pi (see ``inclusion``), and those
    with the smallest random odds u/(1-u) over inclusion odds pi/(1-pi) are drawn until the words are as near
    the target as another document can bring them. Null texts and texts without words have size 0 and are
    never drawn; equal rows share one random number and are drawn together; a null source is a source, last
    in order; no rows give no rows; columns of other names are not looked at.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _odds(F.col("doc_id"), F.col("text"), seed).alias("odds"))
    rows = checkpoint(rows)
    model, n = mix_model(rows, weights, share, copies)
    return _ranked(rows, model, n).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the words that a 5:2:1 mix of all documents takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixed(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the mix itself, a row for each copy, numbered from 1 in a new column ``copy``.

    A ``copy`` of the caller's stays: the number is then in copy_2, or the next free one. The rows keep their
    place: the sources' model is found on narrow columns and then applied row by row. Texts without words
    (null, empty) go, as they add nothing to a mix; repeated rows are drawn together; no rows give no rows.
    """
    keys = [F.col("source").alias("source"), n_words(F.col("text")).alias("size"), _odds(F.col("doc_id"), F.col("text"), SEED).alias("odds")]
    model, n = mix_model(checkpoint(docs.select(*keys)))
    out = _ranked(docs.select(F.struct("*").alias("row"), *keys), model, n).withColumn("copies", _copies()).where("copies > 0")
    held = next(c for c in ("copy", *(f"copy_{k}" for k in range(2, len(docs.columns) + 3))) if c not in docs.columns)
    numbered = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("number"))
    return numbered.select("row.*", F.col("number").alias(held))


#: The same rows from DuckDB; the level of the capped shares is found over the sorted caps.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) AS k FROM documents),
r AS (SELECT *, ln(((k + 0.5) / 4503599627370496) / (1 - (k + 0.5) / 4503599627370496)) AS odds FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM r GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5 * (SELECT sum(source_size) FROM s) AS total FROM s),
o AS (SELECT *, cap / w AS ratio, sum(cap) OVER f - cap AS fixed, sum(w) OVER () - sum(w) OVER f + w AS ws FROM c
      WINDOW f AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(arg_min((total - fixed) / ws, ratio) FILTER (WHERE (total - fixed) / ws <= ratio), 1e300) AS level FROM o),
t AS (SELECT source, source_size, round(least(cap, w * level), 6) AS target FROM c, l),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS rest FROM t),
h AS (SELECT source, size, count(*) AS n FROM r WHERE size > 0 GROUP BY ALL),
k AS (SELECT h.source, size, rest, sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) - n * size AS above,
      sum(n * pow(size, {1 + TILT})) OVER (PARTITION BY h.source ORDER BY size ROWS UNBOUNDED PRECEDING) AS below
      FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source WHERE rest > 0),
i AS (SELECT source, arg_max((rest - above) / below, size) AS rate FROM k WHERE (rest - above) / below * pow(size, {TILT}) <= 1 GROUP BY source),
p AS (SELECT r.*, source_size, target, whole, rest, rate * pow(size, {TILT}) AS pi FROM r JOIN m ON r.source IS NOT DISTINCT FROM m.source
      LEFT JOIN i ON r.source IS NOT DISTINCT FROM i.source),
y AS (SELECT *, CASE WHEN size > 0 THEN CASE WHEN pi < 1 THEN odds - ln(pi / (1 - pi)) ELSE {CERTAIN} END END AS q FROM p),
x AS (SELECT *, sum(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND size > 0 AND 2 * run - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
