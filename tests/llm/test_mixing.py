"""The mix: inclusion probabilities, realised inclusion, edges of the stage."""

import numpy as np

from bitloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_inclusion_probabilities_sum_to_the_sample(spark):
    """Against bisection: sum of least(1, rate * size ** TILT) * size is what is left to draw."""
    r = np.random.default_rng(4)
    sizes = np.r_[r.integers(1, 40, 300), 5000, 5000, 900]
    for share in (0.05, 0.3, 0.6, 0.95):
        rest = float(sizes.sum() * share)
        rows = spark.createDataFrame([("a", int(x)) for x in sizes], "source string, size long")
        model = spark.createDataFrame([("a", rest)], "source string, rest double")
        rate = mixing.inclusion(rows, model, 1).first().rate
        pi = np.minimum(1, rate * sizes**mixing.TILT)
        assert abs((pi * sizes).sum() - rest) < 1e-6 * rest


def test_realised_inclusion_follows_the_probabilities(spark):
    """Documents of three sizes are drawn about as often as their inclusion probabilities say."""
    sizes = [4, 16, 64] * 3000
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], SCHEMA)
    got = mixing.mixed(docs, weights=(1,), share=0.5, copies=1).groupBy("size").agg({"copies": "avg"}).collect()
    rate = 0.5 * sum(sizes) / sum(n**1.5 for n in sizes)
    assert all(abs(r["avg(copies)"] - rate * r["size"] ** 0.5) < 0.04 for r in got)


def test_stage_keeps_clashing_columns(spark):
    rows = [(i, "a b c " * (1 + i % 5), s, "mine", "row", 3) for i in range(60) for s in (["x", "y", None][i % 3],)]
    docs = spark.createDataFrame([*rows, (None, None, None, "mine", "row", 3), (99, "", "x", "mine", "row", 3)], SCHEMA + ", copy string, row string, size int")
    out = mixing.stage(spark, docs, "")
    assert out.columns == [*docs.columns, "copy_2"]
    assert {(r.copy, r.row, r.size) for r in out.collect()} == {("mine", "row", 3)}
    assert mixing.stage(spark, docs.where("false"), "").count() == 0
    assert mixing.mixed(docs).count() == docs.count()
