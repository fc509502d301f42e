"""Learned models against brute force: the label model, Kneser-Ney, and the edges of their stages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitloom.llm import quality, toxicity

NAMES = ["packed", "votes", "_words", "posterior", "row", "t"]


def test_label_model_recovers_planted_accuracies(spark):
    """Votes drawn from known accuracies come back within sampling error, and posteriors as by Bayes' rule."""
    r = random.Random(5)
    prior, good, bad = 0.8, [0.95, 0.9, 0.85, 0.97, 0.8], [0.7, 0.8, 0.6, 0.55, 0.9]
    seen = Counter()
    for _ in range(40_000):
        is_good = r.random() < prior
        seen[tuple(0 if r.random() < 0.2 else (1 if is_good == (r.random() < (g if is_good else b)) else -1) for g, b in zip(good, bad))] += 1
    rows = quality.label_model(spark.createDataFrame([(list(v), n) for v, n in seen.items()], "votes array<int>, n long"), 5, 60).collect()
    got = rows[0]
    assert abs(got.prior - prior) < 0.02
    assert np.abs(np.array(got.good) - good).max() < 0.02 and np.abs(np.array(got.bad) - bad).max() < 0.05
    for x in rows:
        p = [got.prior, 1 - got.prior]
        for v, g, b in zip(x.votes, got.good, got.bad):
            p = [p[0] * (g if v > 0 else 1 - g), p[1] * (b if v < 0 else 1 - b)] if v else p
        assert abs(x.posterior - p[0] / sum(p)) < 1e-9


def test_statistics_and_stage_keep_columns_of_any_name(spark):
    text = "Some words of plain prose stand here, " * 3 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, text, *NAMES), (1, text, *NAMES), (None, text, *NAMES), (2, None, *NAMES), (3, "", *NAMES), (4, "## $$ %% " * 40, *NAMES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {n} string" for n in NAMES))
    assert [r["_words"] for r in quality.text_statistics(docs).collect()] == ["_words"] * 6
    out = quality.stage(spark, docs, "")
    assert out.columns == docs.columns and all(tuple(r)[2:] == tuple(NAMES) for r in out.collect())
    assert sorted(r.doc_id or 0 for r in out.collect() if r.text == text) == [0, 1, 1]
    assert quality.stage(spark, docs.where("false"), "").count() == 0
    assert quality.quality(docs).count() == 6 and quality.quality(docs.where("false")).count() == 0


def test_symbols_and_characters(spark):
    texts = ["a#b *$ é|x\t%", "", None, "é" * 9 + "\x0b<>&&"]
    got = quality.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.word_chars, r.n_symbols) for r in got] == [(sum(c not in " \t\n\x0b\x0c\r" for c in t or ""), sum(c in "#*$%&|<>" for c in t or "")) for t in texts]


def test_kneser_ney_ratios_by_brute_force(spark):
    """Each word's log-ratio is the product over its beginnings of the two classes' smoothed shares."""
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    rows = [(k % 2, " ".join(r.choice(words[: 40 + 20 * (k % 2)]) for _ in range(12)).encode()) for k in range(80)]
    counts = spark.createDataFrame(rows, "toxic int, text binary").mapInArrow(toxicity._counts, "node long, parent long, toxic long, n long")
    F = toxicity.F
    n = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).cast("double")
    got = toxicity.model_table(counts.groupBy("node", "parent").agg(n(1).alias("one"), n(0).alias("zero"))).toPandas()
    nodes = got["node"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(nodes)
    model = toxicity.KneserNey(nodes[order], got["ratio"].to_numpy()[order], got["rest"].to_numpy()[order])

    def path(word):
        ends = [i for i in toxicity.STEMS if len(word) > i]
        names = ["", *(word[:i] for i in ends), word + "$"]
        return list(zip(names, names[1:]))

    held = [Counter(), Counter()]
    for toxic, text in rows:
        held[toxic].update({e for w in text.decode().split() for e in path(w)})
    below = defaultdict(set)
    for e in set(held[0]) | set(held[1]):
        below[e[0]].add(e)
    D = toxicity.DISCOUNT

    def p(c, e):
        nexts = below[e[0]]
        both = sum(held[0][x] + held[1][x] for x in nexts)
        rest = sum(min(held[c][x], D) for x in nexts) + 1
        return (max(held[c][e] - D, 0) + rest * (held[0][e] + held[1][e]) / both) / (sum(held[c][x] for x in nexts) + 1)

    for w in words:
        want = 0.0
        for e in path(w):
            if not held[0][e] + held[1][e]:
                break
            want += math.log(p(1, e) / p(0, e))
        else:
            assert abs(model.log_ratios(w.encode())[0] - want) < 1e-9


def test_a_wholly_toxic_text_is_not_taken_for_a_typical_one():
    assert toxicity.feature(np.array([5.0, 5.0])) > toxicity.feature(np.array([5.0, *[0.0] * 40])) > toxicity.feature(np.zeros(41)) == 0.0
    assert toxicity.feature(np.array([])) == 0.0 > toxicity.feature(np.array([-3.0, -3.0, -3.0]))


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, ""), (2, "x" * 100_000)]])
def test_toxicity_of_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(rows)
