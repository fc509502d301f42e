"""Nulls, empty tables, single values and odd strings."""

import math
import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from bitloom.functions import tokens
from bitloom.operators import blocks, categorical, dictionary, numeric, sequences
from bitloom.sources import documents


def test_blocks_keep_nulls_and_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"v{i}", i * 10**15 if i % 2 else None) for i in range(50)], "k int, s string, n long")
    packed = blocks.encode(df, "k", rows_a_block=7)
    assert packed.count() == 8
    back = blocks.decode(packed, df.schema)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    assert [r.k for r in blocks.lookup(packed, df.schema, [0, 13, 49], 7).orderBy("k").collect()] == [0, 13, 49]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, s string")
    assert blocks.decode(blocks.encode(df, "k"), df.schema).count() == 0
    assert dictionary.build(df, "s", "k").count() == 0
    assert categorical.weights(categorical.histogram(df, "s"), "s").count() == 0
    assert numeric.quantile_sketch(df, "k", ["k"], 1.0).count() == 0


def test_single_value_has_all_the_weight(spark):
    df = spark.createDataFrame([("x",)] * 10, "s string")
    row = categorical.weights(categorical.histogram(df, "s"), "s").first()
    assert (row.w, row.rare_w) == (65536, 0)


def test_rare_branch(spark):
    hist = spark.createDataFrame([("a", 200_000), ("b", 1)], "s string, cnt long")
    rows = {r.s: r for r in categorical.weights(hist, "s").collect()}
    assert rows["b"].w == 0 and rows["a"].w + rows["a"].rare_w == 65536


def _bits(rows, target, predictors):
    """Coded bits of a column given others, 16 a free weight and predictor, 32: by counting."""
    cells = {}
    for r in rows:
        cells.setdefault(tuple(r[p] for p in predictors), Counter())[r[target]] += 1
    coded = sum(sum(c.values()) * math.log2(sum(c.values())) - sum(n * math.log2(n) for n in c.values()) for c in cells.values())
    return coded + 16 * (sum(len(c) - 1 for c in cells.values()) + len(predictors)) + 32


def test_structure_against_enumeration(spark):
    """c depends on a and b together, d on c; e is free. The caps keep e out of every table."""
    r = random.Random(1)
    rows = []
    for _ in range(3000):
        a, b = r.randrange(3), r.randrange(2)
        c = (2 * a + b + (r.random() < 0.05)) % 6
        rows.append({"a": a, "b": b, "c": c, "d": c if r.random() < 0.9 else r.randrange(6), "e": r.randrange(40)})
    caps = {"a": 3, "b": 2, "c": 6, "d": 6, "e": 2000}
    got = categorical.structure(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), caps)
    placed, want = [], []
    while len(placed) < len(caps):
        best = {}
        for t in (c for c in caps if c not in placed):
            held = ()
            while options := [(*held, p) for p in placed if p not in held and math.prod(caps[x] for x in (*held, p)) <= 1000]:
                x = min(options, key=lambda x: _bits(rows, t, x))
                if _bits(rows, t, x) >= _bits(rows, t, held):
                    break
                held = x
            best[t] = held
        t = min(best, key=lambda t: _bits(rows, t, best[t]))
        want.append((t, best[t], round(_bits(rows, t, best[t]), 4)))
        placed.append(t)
    assert [(c, p, round(bits, 4)) for c, p, bits in got] == want
    assert max(len(p) for _, p, _ in got) == 2
    skipped = categorical.structure(spark.createDataFrame(rows), caps, skip_learning=True)
    assert [(c, p) for c, p, _ in skipped] == [(c, ()) for c in caps]


def test_blocks_of_wide_ranges_dates_and_clashing_names(spark):
    rows = [(i, (-1) ** i * 6 * 10**18, i % 5, date(1969, 12, 20) + timedelta(i), Decimal(i - 9).scaleb(-2), f"x{i}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id int, wide long, block_id int, day date, price decimal(12,2), e string, n_rows int")
    back = blocks.decode(blocks.encode(df, "row_id", rows_a_block=6), df.schema)
    assert sorted(map(tuple, back.collect())) == rows and back.schema == df.schema


def test_json_of_any_depth_and_name(spark):
    deep = "{" + '"a":{' * 13 + '"b":1' + "}" * 14
    texts = [deep, '{"a.b":1,"a":{"b":"x"},"s":[1.5,2.25],"m":[1,"x"],"n":null}', '{"a.b":2.5,"m":[]}', "no json", "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = {(r.path, r.kind): r.cnt for r in sequences.json_members(df, "j").collect()}
    assert got == {("a", "object"): 2, ("a.b", "int"): 1, ("a.b", "double"): 1, ("s", "array"): 1, ("m", "array"): 2, ("n", "null"): 1}
    assert sorted(map(tuple, sequences.json_lengths(df, "j").collect())) == [("m", 0, 1), ("m", 2, 1), ("s", 2, 1)]
    paths = {(r.path, r.kind): r.cnt for r in documents.paths(df.select(F.try_parse_json("j").alias("doc"))).collect()}
    assert paths[".a" * 13 + ".b", "int"] == 1 and paths[".s", "series"] == 1 and paths[".m[]", "string"] == 1


def test_grouped_sketch_reads_the_first_rows_of_each_group(spark):
    """Groups of 30,000, 3 and a third of the rows on one order value, against a sort of each group."""
    r = random.Random(3)
    rows = [("big", None if i % 1000 == 0 else r.randrange(50_000), r.random()) for i in range(30_000)] + [("few", i, float(i)) for i in range(3)] + [("tie", 7, r.random()) for _ in range(12_000)]
    got = {r.g: r for r in numeric.quantile_sketch(spark.createDataFrame(rows, "g string, o long, v double"), "v", ["o", "v"], 0.01, "g").collect()}
    for g in ("big", "few", "tie"):
        first = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))[: numeric.PRIME]
        v = sorted(x[2] for x in first)
        assert (got[g].n, got[g].p05, got[g].p95) == (len(v), v[int(len(v) * 0.05)], v[int(len(v) * 0.95)])


def test_splitter(spark):
    cases = {
        "": [],
        "a/": [("a", "/"), ("", "")],
        "fooBar12": [("foo", ""), ("Bar", ""), ("12", "")],
        "http://www.x-y": [("http:/", "/"), ("www", "."), ("x", "-"), ("y", "")],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokens.split_words(F.col("t")).alias("w"))
    assert {r.t: [tuple(x) for x in r.w] for r in df.collect()} == cases
