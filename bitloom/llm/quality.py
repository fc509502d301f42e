"""Quality rules as weak supervision: votes, expectation-maximisation, posteriors. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import SPACES, checkpoint, shared_folder

#: Rounds of expectation-maximisation, and the posterior from which a document is kept.
ROUNDS, KEEP_FROM = 20, 0.5
#: Start values and pseudo-counts: share of good documents, P(good vote | good), P(bad vote | bad).
PRIOR, SURE, WEIGHT = 0.85, (0.99, 0.5), 20.0


def _counts(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return {
        "_words": words,
        "_lines": lines,
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACES}]+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
    }


def _windows(words: Column) -> Column:
    """Three-word windows with their places, sorted."""
    three = F.transform(
        F.slice(words, 1, F.size(words) - 2),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    return F.when(F.size(words) >= 3, F.sort_array(three))


def _covered(ranked: Column) -> Column:
    """Words inside windows that occur twice or more: equal neighbours are kept, their places merged in order.

    ``ranked`` must be a column of its own, not an expression, as the lambdas look it up per window.
    """

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(ranked, i - 1)["w"], F.get(ranked, i + 1)["w"]
        return F.coalesce(x["w"] == before, F.lit(False)) | F.coalesce(x["w"] == after, F.lit(False))

    places = F.sort_array(F.transform(F.filter(ranked, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    return F.coalesce(F.aggregate(places, start, step, lambda a: a["n"]), F.lit(0))


#: Columns that ``text_statistics`` adds; those with an underscore serve the rules.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_n_lines", "_n_distinct", "_n_upper", "_n_lower", "_n_bare", "_n_loud")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of STATISTICS (n_words, word_chars, ..., base_failed).

    A null text counts as empty; no rows give no rows. Columns of ``docs`` with a statistic's name give
    way to it, others are kept whatever their names. Row by row: long texts stay within their row, ties
    and repeated rows need no rule, and nothing is shuffled.
    """
    out = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    out = out.withColumns(_counts(t))
    out = out.withColumn("_ranked", _windows(F.col("_words")))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_repeat_words": _covered(F.col("_ranked")).cast("long"),
            "_n_upper": (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))).cast("long"),
            "_n_lower": (F.length(t) - F.length(F.regexp_replace(t, "\\p{Ll}+", ""))).cast("long"),
            "_n_bare": F.regexp_count(t, F.lit(f"(?<![^{SPACES}])[^{SPACES}\\p{{L}}]+(?![^{SPACES}])")).cast("long"),
            "_n_loud": (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long"),
        }
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"word_chars": F.col("word_chars").cast("long"), "n_symbols": F.col("n_symbols").cast("long"), "base_failed": base})
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in STATISTICS), *STATISTICS)


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains) on the columns of ``text_statistics``."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")

    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("_n_upper") + F.col("_n_lower")
    return {
        "length": vote(F.col("n_words") < 20, F.col("n_words") >= 60),
        "symbols": vote(F.col("n_symbols") > 0.3 * n, F.col("n_symbols") < 0.15 * n),
        "letters": vote(letters < 0.7 * F.col("word_chars"), letters > 0.85 * F.col("word_chars")),
        "bare": vote(F.col("_n_bare") > 0.2 * n, F.col("_n_bare") < 0.05 * n),
        "capitals": vote(F.col("_n_upper") > 0.5 * letters, F.col("_n_upper") < 0.25 * letters),
        "shouting": vote(F.col("_n_loud") > 0.5 * n, F.col("_n_loud") < 0.1 * n),
        "lines": vote((F.col("n_dup_lines") > 0.3 * F.col("_n_lines")) & (F.col("n_dup_lines") >= 3), F.col("n_dup_lines") == 0),
        "repeats": vote(F.col("n_repeat_words") > 0.35 * n, F.col("n_repeat_words") < 0.15 * n),
        "variety": vote(F.col("_n_distinct") < 0.25 * n, F.col("_n_distinct") > 0.4 * n),
    }


def voted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text_statistics`` with votes (array, in the order of ``rules``)."""
    return text_statistics(docs, text).withColumn("votes", F.array(*rules().values()))


def label_model(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior, prior, good, bad) for every row of ``patterns`` (votes, n).

    Latent good/bad quality; each rule has two accuracies, P(good vote | good) and P(bad vote | bad),
    among the documents on which it doesn't abstain: ``good`` and ``bad``, as expectation-maximisation
    estimates them (nothing overwrites the estimates; WEIGHT pseudo-counts keep them off 0 and 1 and lose
    their weight as documents are added). The patterns are at most 3 ** n_rules rows, however many
    documents there are, so the whole fit is one expression over their single list; no patterns give no rows.
    """
    one = F.lit(1.0)

    def posterior(state: Column, votes: Column) -> Column:
        def log_ratio(acc: Column, v: Column, i: Column) -> Column:
            g, b = F.get(state["good"], i), F.get(state["bad"], i)
            return F.when(v == 1, F.log(g) - F.log(one - b)).when(v == -1, F.log(one - g) - F.log(b)).otherwise(F.lit(0.0))

        total = F.aggregate(
            F.transform(votes, lambda v, i: log_ratio(state, v, i)), F.log(state["prior"]) - F.log(one - state["prior"]), lambda a, x: a + x
        )
        return one / (one + F.exp(-total))

    def accuracies(rows: Column, p, vote: int, start: float) -> Column:
        def of(i: Column) -> Column:
            hit = F.aggregate(rows, F.lit(WEIGHT * start), lambda a, r: a + F.when(F.get(r["votes"], i) == vote, r["n"] * p(r)).otherwise(0.0))
            all_ = F.aggregate(rows, F.lit(WEIGHT), lambda a, r: a + F.when(F.get(r["votes"], i) != 0, r["n"] * p(r)).otherwise(0.0))
            return hit / all_

        return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), of)

    def step(rows: Column, state: Column) -> Column:
        soft = F.transform(rows, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), posterior(state, r["votes"]).alias("p")))
        # A list of one, so that the posteriors of a round are made once.
        return F.get(F.transform(F.array(soft), maximise), F.lit(0))

    def maximise(soft: Column) -> Column:
        n = F.aggregate(soft, F.lit(WEIGHT), lambda a, r: a + r["n"])
        good = F.aggregate(soft, F.lit(WEIGHT * PRIOR), lambda a, r: a + r["n"] * r["p"])
        return F.struct(
            (good / n).alias("prior"),
            accuracies(soft, lambda r: r["p"], 1, SURE[0]).alias("good"),
            accuracies(soft, lambda r: one - r["p"], -1, SURE[1]).alias("bad"),
        )

    start = F.struct(
        F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(SURE[0]), n_rules).alias("good"), F.array_repeat(F.lit(SURE[1]), n_rules).alias("bad")
    )
    one_row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, k: step(F.col("rows"), state))
    fitted = checkpoint(one_row.withColumn("state", run))
    each = fitted.select("state", F.explode("rows").alias("r"))
    return each.select(F.col("r.votes").alias("votes"), posterior(F.col("state"), F.col("r.votes")).alias("posterior"), "state.*")


def _fit(votes: DataFrame) -> DataFrame:
    """Posteriors by pattern, as a checkpointed table of at most 3 ** rules rows."""
    return checkpoint(label_model(votes.groupBy("votes").agg(F.count("*").alias("n")), len(rules())).select("votes", "posterior"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, votes, posterior and good for every row of ``docs``.

    good is posterior >= KEEP_FROM, the method's verdict. The statistics are made once and checkpointed
    without the texts; the posteriors come back by a broadcast of at most 3 ** rules rows. Null and empty
    texts are judged as texts without words; repeated rows get equal verdicts, null ids no special ones.
    """
    rows = checkpoint(voted(docs.select("doc_id", "text")).drop("text"))
    return rows.join(F.broadcast(_fit(rows)), "votes").withColumn("good", F.col("posterior") >= KEEP_FROM)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: base statistics and the label model's verdict on every document."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("good")).alias("kept"), "posterior",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the label model takes for bad go.

    The posterior alone decides, as the method has it: it replaces filters of which all must pass, so a
    short clean text stays. Rows and their votes are written once to the shared folder: no text is shuffled, and
    repeated or null ids need no key. The caller's columns travel in one struct, so their names don't matter.
    Null and empty texts are judged as texts without words; no rows give no rows.
    """
    packed = voted(docs.select(F.struct("*").alias("packed"), F.col("text").alias("text"))).select("packed", "votes")
    path = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    packed.write.parquet(path)
    rows = spark.read.schema(packed.schema).parquet(path)
    return rows.join(F.broadcast(_fit(rows.select("votes"))), "votes").where(F.col("posterior") >= KEEP_FROM).select("packed.*")
