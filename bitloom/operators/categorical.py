"""Categorical models: histograms, 16-bit weights, rare branches, costs in bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.plans.lineage import checkpoint

#: A probability is a share of so many.
ONE = 65536


def histogram(df: DataFrame, code: str, *predictors: str) -> DataFrame:
    """(predictors..., code, cnt)."""
    return df.groupBy(*predictors, code).agg(F.count("*").alias("cnt"))


def _with_totals(df: DataFrame, predictors: tuple[str, ...], **sums: Column) -> DataFrame:
    """Joins each row with sums over its predictors' rows; without predictors that is a single row."""
    keys = [F.col(p).alias(f"_{p}") for p in predictors]
    totals = df.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    if not predictors:
        return df.join(F.broadcast(totals))
    on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in predictors]
    return df.join(totals, on).drop(*(f"_{p}" for p in predictors))


def weights(hist: DataFrame, code: str, *predictors: str) -> DataFrame:
    """``hist`` with w: cnt * 65536 div total, the leftover on the first largest code, unless some code
    got weight 0: then the leftover is the rare branch (rare_w), with 1 borrowed from the largest if
    there is none left; rare codes share it evenly. The histogram, which has a row a code and not a row of
    the data, is checkpointed: the data are counted once for all sums over it."""
    hist = checkpoint(hist)
    raw = _with_totals(hist, predictors, total=F.sum("cnt"))
    raw = raw.withColumn("w0", F.expr(f"cnt * {ONE} div total"))
    first = F.min_by(F.struct(code), F.struct(-F.col("w0"), F.col(code)))
    raw = _with_totals(raw, predictors, left=ONE - F.sum("w0"), rare=F.count(F.when(F.col("w0") == 0, 1)), top=first)
    is_top = F.col(code).eqNullSafe(F.col("top")[code])
    borrowed = (F.col("rare") > 0) & (F.col("left") == 0)
    w = F.when(is_top & (F.col("rare") == 0), F.col("w0") + F.col("left")).when(is_top & borrowed, F.col("w0") - 1).otherwise(F.col("w0"))
    rare_w = F.when(F.col("rare") > 0, F.when(borrowed, 1).otherwise(F.col("left"))).otherwise(0)
    return raw.select(*predictors, code, "cnt", "total", w.cast("long").alias("w"), rare_w.cast("long").alias("rare_w"), F.col("rare").alias("n_rare"))


def model_cost(weighted: DataFrame, n_codes: int | None, n_predictors: int = 0) -> DataFrame:
    """(bits): entropy of the coded rows plus 16 bits for each free weight, 16 a predictor and 32."""
    p = F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("rare_w") / F.greatest(F.col("n_rare"), F.lit(1)))
    coded = weighted.agg(F.sum(F.col("cnt") * -F.log2(p / ONE)).alias("coded"), F.count("*").alias("codes"))
    codes = F.lit(n_codes) if n_codes else F.col("codes")
    return coded.select(F.round(F.col("coded") + (codes - 1) * 16 + n_predictors * 16 + 32, 4).alias("bits"))


def candidate_costs(df: DataFrame, candidates: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(target, predictors, coded, weights) for each candidate (target, predictors): bits of the target's
    codes given its predictors, and the free weights of the tables that say so.

    One scan for all: a grouping-sets aggregation counts each set of columns, and its rows (cells of the
    histograms) are dealt out to the candidates they belong to.
    """
    columns = [c for c in df.columns if any(c == t or c in p for t, p in candidates)]
    sets = sorted({tuple(c for c in columns if c == t or c in p) for t, p in candidates})
    gid = lambda s: (1 << len(columns)) - 1 - sum(1 << (len(columns) - 1 - columns.index(c)) for c in s)
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("_cnt"), F.grouping_id().alias("_g"))
    cells = []
    for number, (target, predictors) in enumerate(candidates):
        held = tuple(c for c in columns if c == target or c in predictors)
        cell = F.to_json(F.array(*(F.col(c).cast("string") for c in predictors))) if predictors else F.lit("")
        cells.append(F.when(F.col("_g") == gid(held), F.struct(F.lit(number).alias("candidate"), cell.alias("cell"))))
    each = counted.select("_cnt", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("_cnt", "c.*")
    by = each.groupBy("candidate", "cell").agg(F.sum(F.col("_cnt") * F.log2("_cnt")).alias("inner"), F.sum("_cnt").alias("n"), F.count("*").alias("codes"))
    out = by.groupBy("candidate").agg(F.sum(F.col("n") * F.log2("n") - F.col("inner")).alias("coded"), F.sum(F.col("codes") - 1).alias("weights"))
    name = lambda k: F.get(F.lit(k), F.col("candidate"))
    return out.select(name([t for t, _ in candidates]).alias("target"), name([",".join(p) for _, p in candidates]).alias("predictors"), "coded", "weights")


def pair_costs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(target, predictor, bits): coded bits of each column given each other one, or none, in one scan."""
    pairs = [(t, p) for t in columns for p in [(), *((c,) for c in columns if c != t)]]
    return candidate_costs(df, pairs).select("target", F.col("predictors").alias("predictor"), F.round("coded", 4).alias("bits"))


#: Fixed value: most cells of a conditional table, by the product of its predictors' caps.
MOST_CELLS = 1000


def structure(df: DataFrame, caps: dict[str, int], skip_learning: bool = False) -> list[tuple[str, tuple[str, ...], float]]:
    """[(column, predictors, bits)] of the columns in ``caps`` (column: most codes), in the order in which they are coded.

    Each round grows every open column's predictors, from those already placed, one at a time by the largest
    saving while the cost falls (coded bits, 16 for each free weight and predictor, 32), and places the
    cheapest column; ties go to the first. Tables over MOST_CELLS cells are no candidates. All costs that
    are not known yet come from one scan of the whole table; a few numbers per candidate reach the driver.
    With ``skip_learning`` the columns keep their order and have no predictors.
    """
    known: dict[tuple[str, tuple[str, ...]], float] = {}

    def learn(wanted: list[tuple[str, tuple[str, ...]]]) -> None:
        new = [x for x in dict.fromkeys(wanted) if x not in known]
        for r in candidate_costs(df, new).collect() if new else []:
            p = tuple(r.predictors.split(",")) if r.predictors else ()
            known[r.target, p] = r.coded + 16 * (r.weights + len(p)) + 32
        known.update({x: 32.0 + 16 * len(x[1]) for x in new if x not in known})  # an empty table

    def wider(predictors: tuple[str, ...], placed: list[str]) -> list[tuple[str, ...]]:
        out = [(*predictors, p) for p in placed if p not in predictors]
        return [x for x in out if math.prod(caps[c] for c in x) <= MOST_CELLS]

    learn([(c, ()) for c in caps])
    if skip_learning:
        return [(c, (), known[c, ()]) for c in caps]
    out: list[tuple[str, tuple[str, ...], float]] = []
    while len(out) < len(caps):
        placed = [c for c, *_ in out]
        best = {c: () for c in caps if c not in placed}
        growing = list(best)
        while growing:
            learn([(c, x) for c in growing for x in wider(best[c], placed)])
            still = []
            for c in growing:
                options = [(known[c, x], x) for x in wider(best[c], placed)]
                if options and min(options, key=lambda x: x[0])[0] < known[c, best[c]]:
                    best[c] = min(options, key=lambda x: x[0])[1]
                    still.append(c)
            growing = still
        chosen = min(best, key=lambda c: known[c, best[c]])
        out.append((chosen, best[chosen], known[chosen, best[chosen]]))
    return out


def coded_bits(df: DataFrame, weighted: DataFrame, code: str, *predictors: str) -> DataFrame:
    """(n, bits): rows meet their predictors' weights; each costs 16 - log2(w), rare ones the rare branch too."""
    model = weighted.select(*(F.col(c).alias(f"_{c}") for c in (code, *predictors)), "w", "rare_w", "n_rare")
    rows = df.groupBy(code, *predictors).agg(F.count("*").alias("n"))  # equal rows cost the same
    joined = rows.join(model, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (code, *predictors)])
    bits = F.when(F.col("w") > 0, 16 - F.log2("w")).otherwise(16 - F.log2("rare_w") + F.log2("n_rare"))
    return joined.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * bits), 4).alias("bits"))


def cumulative(hist: DataFrame, code: str, base: int = ONE) -> DataFrame:
    """(code, cnt, low, high): each code's share of [0, base) in code order.

    One window over a histogram, which has as many rows as codes and not as the data.
    """
    over = Window.partitionBy(F.lit(0)).orderBy(code).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("_run", F.sum("cnt").over(over)).withColumn("_all", F.sum("cnt").over(Window.partitionBy(F.lit(0))))
    return run.select(code, "cnt", F.expr(f"(_run - cnt) * {base} div _all").alias("low"), F.expr(f"_run * {base} div _all").alias("high"))
