"""Declarations, text and JSON sources and sinks, the block store and the streaming encoder."""

import pytest
from pyspark.sql import functions as F

from bitloom.operators import sampling
from bitloom.sources import blockstore, config, delimited, documents
from bitloom.streaming import encoder


def same(one, two):
    return one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_declarations():
    schema = config.parse("ENUM 8 0\n\nINTEGER 0.5\nDOUBLE 0.0025\nSTRING\n", ["a", "b", "c", "d"])
    assert [f.dataType.simpleString() for f in schema] == ["string", "bigint", "double", "string"]
    assert schema["a"].metadata["cap"] == 8 and schema["b"].metadata["bin"] == 1 and schema["c"].metadata["bin"] == 0.005
    assert config.enums(schema) == ["a"]
    for wrong in ("DOUBLE 0", "DOUBLE 0.5", "NUMBER 1", "ENUM"):
        with pytest.raises(ValueError):
            config.parse(wrong)


@pytest.mark.parametrize("sep", [",", "|"])
def test_delimited_round_trip(spark, tmp_path, sep):
    schema = config.parse("ENUM 8 0\nINTEGER 0\nDOUBLE 0.0025")
    df = spark.createDataFrame([('a,"b"|c', 1, 0.25), ("plain", -2, 3.5), (None, None, None), ("é", 3, 1e6)], schema)
    delimited.write(df, f"{tmp_path}/t", sep)
    assert same(delimited.read(spark, f"{tmp_path}/t", schema, sep), df)


def test_bad_fields_stop_the_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,1\r\n\r\ny,z\n")
    with pytest.raises(Exception):
        delimited.read(spark, str(tmp_path / "t.csv"), config.parse("STRING\nINTEGER 0")).collect()


def test_json_paths(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a":{"b":1},"list":[{"x":"y"}],"n":null}\n\n{"a":{"b":"s"}}\nnot json\n')
    found = {(r.path, r.kind): r.cnt for r in documents.paths(documents.read(spark, str(tmp_path / "t.json"))).collect()}
    assert found[("", "object")] == 2 and found[(".a.b", "int")] == found[(".a.b", "string")] == 1
    assert found[(".list", "array")] == found[(".list[].x", "string")] == found[(".n", "null")] == 1


def test_json_sink(spark, tmp_path):
    documents.write(spark.createDataFrame([(1, "a")], "k int, s string"), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"k":1,"s":"a"}'


def test_block_store(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("s"))
    blockstore.write(df, f"{tmp_path}/b", "k", rows_a_block=16)
    assert same(blockstore.read(spark, f"{tmp_path}/b", df.schema), df)
    ids = spark.createDataFrame([(3,), (99,), (3,), (500,)], "row_id long")
    assert [r.k for r in blockstore.rows(spark, f"{tmp_path}/b", df.schema, ids, 16).orderBy("k").collect()] == [3, 99]
    assert blockstore.factor(spark, f"{tmp_path}/b", delimited.rendered(df)).first().factor > 0


def test_stream_of_blocks(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        encoder.encode(stream, f"{tmp_path}/out", f"{tmp_path}/check", "k", rows_a_block=8).awaitTermination(60)
    assert same(encoder.decode(spark, f"{tmp_path}/out", df.schema), df)


def test_samples(spark):
    df = spark.range(10)
    drawn = sampling.with_replacement(df, "id", 100)
    assert drawn.count() == 100 and drawn.select("id").distinct().count() > 5
    assert sampling.with_replacement(df.limit(0), "id", 5).count() == 0
    assert sampling.share(df, "id", 0.0).count() == 0 and sampling.share(df, "id", 1.0).count() == 10
