"""Registered learners, stored models, schema files and nested JSON."""

import pytest
from pyspark.sql import functions as F

from bitloom.operators import sequences
from bitloom.plans import registry
from bitloom.sources import config, documents, models


def test_registry_and_stored_models(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 10), f"big word {i}") for i in range(60)], "k int, e string, x double, s string")
    schema = config.parse("ENUM 2\nDOUBLE 0.05\nSTRING", ["e", "x", "s"])
    assert registry.candidates(schema, "x", ("e",)) and not registry.candidates(schema, "s", ("e",)) and not registry.candidates(schema, "e", ("x",))
    registry.interpret("x", lambda c: registry.bucket(c, [5.0]))
    try:
        assert registry.candidates(schema, "e", ("x",))
        learned = registry.learn(df, schema, ["k"], {"e": ("x",)})
    finally:
        registry.INTERPRETERS.clear()
    assert {(r.x, r.e): r.cnt for r in learned["e"].collect()} == {(0, "a"): 18, (0, "b"): 12, (1, "a"): 12, (1, "b"): 18}
    with pytest.raises(ValueError):
        registry.learn(df, schema, ["k"], {"s": ("e",)})
    models.write(spark, learned, [("x", (), 5.0), ("e", ("x",), 2.0)], f"{tmp_path}/m")
    back, order = models.read(spark, f"{tmp_path}/m")
    assert order == [("x", (), 5.0), ("e", ("x",), 2.0)] and set(back) == {"e", "x", "s"}
    for name in learned:
        assert sorted(map(str, back[name].collect())) == sorted(map(str, learned[name].collect()))


def test_schema_file(spark, tmp_path):
    rows = [('{"b": {"c": [1, 2], "a.b": "x"}, "n": null}',), ('{"b": 1.5, "s": [1.5, 2.5]}',), (None,)]
    found = documents.nodes(spark.createDataFrame(rows, "j string").select(F.try_parse_json("j").alias("doc")))
    documents.write_schema(found, f"{tmp_path}/s")
    back = documents.read_schema(spark, f"{tmp_path}/s").orderBy("place").collect()
    assert [(tuple(r.parts), r.code) for r in back] == [(("b",), 3), (("b", "a.b"), 5), (("b", "c"), 4), (("b", "c", "[]"), 6), (("n",), 0), (("s",), 8)]
    there = {r.path: (r.present, r.absent) for r in documents.existence(found).collect()}
    assert there == {".b": (2, 0), ".b.c": (1, 0), ".b.a.b": (1, 0), ".n": (1, 1), ".s": (1, 1)}
    assert {(r.path, r.elements): r.cnt for r in documents.lengths(found).collect()} == {(".b.c", 2): 1, (".s", 2): 1}


def test_nodes_of_no_documents(spark):
    found = documents.nodes(spark.createDataFrame([], "j string").select(F.try_parse_json("j").alias("doc")))
    assert found.count() == documents.existence(found).count() == documents.costs(found).count() == 0


def test_prefixes_come_back(spark):
    texts = ["", "customer one", "customer two", None, "customer three", "customer three", "日本語の文章です", "日本語の文章でも", "x" * 500, "x" * 501]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    back = sequences.prefix_decode(sequences.prefix_encode(df, "s", "k", 4), "s", "k")
    assert [r.s for r in back.orderBy("k").collect()] == texts
