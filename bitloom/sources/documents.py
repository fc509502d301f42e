"""JSON documents: text source and sink, and the schema of paths and kinds that they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.plans.lineage import checkpoint, with_row_id


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc) a VARIANT for each line that is a JSON value; lines that are none give null."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("doc"))


def write(df: DataFrame, path: str) -> None:
    """One JSON object a line, null members left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def kind(value: Column) -> Column:
    found = F.schema_of_variant(value)
    return (
        F.when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array").when(found == "BIGINT", "int")
        .when(found.startswith("DECIMAL") | (found == "DOUBLE"), "double").when(found == "VOID", "null").otherwise(F.lower(found))
    )


def nodes(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(parts, parent, path, kind, elements, cnt, least, most, total) of all nodes of the documents.

    parts are the names down to the node, ``[]`` for an array's elements; path puts a dot before each member's
    name. elements is an array's length; least, most and total are of a number's values or of a string's bytes.
    Each level is one explode of the level before, checkpointed, until a level has no nodes: nodes of any
    depth are counted. An array that has elements, all decimals or doubles, is a ``series`` and not gone
    into. Null documents give nothing.
    """
    root = (F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("path"), F.col(column).alias("node"))
    level = docs.where(F.col(column).isNotNull()).select(*root)
    counts = None
    while True:
        series = F.schema_of_variant("node").rlike(r"^ARRAY<(DECIMAL\(\d+,\d+\)|DOUBLE)>$")
        each = level.withColumn("kind", F.when(series, "series").otherwise(kind(F.col("node"))))
        elements = F.when(F.col("kind").isin("array", "series"), F.size(F.try_variant_get("node", "$", "array<variant>")).cast("long"))
        size = F.when(F.col("kind").isin("int", "double"), F.try_variant_get("node", "$", "double"))
        size = F.coalesce(size, F.when(F.col("kind") == "string", F.octet_length(F.try_variant_get("node", "$", "string")).cast("double")))
        own = each.withColumn("elements", elements).withColumn("size", size).groupBy("parts", "parent", "path", "kind", "elements")
        own = checkpoint(own.agg(F.count("*").alias("cnt"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total")))
        counts = own if counts is None else counts.union(own)
        if own.where("kind in ('object', 'array')").isEmpty():
            return counts
        inner = each.where("kind in ('object', 'array')").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("node").outer()))
        name = F.when(F.col("kind") == "array", "[]").otherwise(F.col("key"))
        step = F.when(F.col("kind") == "array", "[]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = checkpoint(inner.select(
            F.concat("parts", F.array(name)).alias("parts"), F.col("path").alias("parent"), F.concat("path", step).alias("path"), F.col("value").alias("node")
        ))


def paths(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(path, kind, cnt) of all nodes of the documents, as ``nodes`` finds them."""
    return nodes(docs, column).groupBy("path", "kind").agg(F.sum("cnt").alias("cnt"))


def existence(found: DataFrame) -> DataFrame:
    """(path, present, absent) of each member over the objects that may hold it; ``found`` is of ``nodes``."""
    objects = found.where("kind = 'object'").groupBy(F.col("path").alias("parent")).agg(F.sum("cnt").alias("objects"))
    members = found.where("substr(path, length(parent) + 1, 1) = '.'").groupBy("parent", "path").agg(F.sum("cnt").alias("present"))
    return members.join(objects, "parent").select("path", "present", (F.col("objects") - F.col("present")).alias("absent"))


def lengths(found: DataFrame) -> DataFrame:
    """(path, elements, cnt) of the arrays and series."""
    return found.where("elements is not null").groupBy("path", "elements").agg(F.sum("cnt").alias("cnt"))


def leaves(found: DataFrame) -> DataFrame:
    """(path, kind, cnt, least, most, total) of numbers (their values) and strings (their bytes)."""
    by = found.where("kind in ('int', 'double', 'string')").groupBy("path", "kind")
    return by.agg(F.sum("cnt").alias("cnt"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


def costs(found: DataFrame) -> DataFrame:
    """(path, model, bits): what the nodes' existence, kinds and array lengths cost as categorical models.

    Coded bits, 16 for each free weight, and 32; a node's cost is the sum of its models'.
    """
    there = existence(found).select("path", F.lit("existence").alias("model"), F.explode(F.array("present", "absent")).alias("cnt")).where("cnt > 0")
    kinds = found.groupBy("path", "kind").agg(F.sum("cnt").alias("cnt")).select("path", F.lit("kind").alias("model"), "cnt")
    sizes = lengths(found).select("path", F.lit("length").alias("model"), "cnt")
    by = there.union(kinds).union(sizes).groupBy("path", "model").agg(F.sum(F.col("cnt") * F.log2("cnt")).alias("inner"), F.sum("cnt").alias("n"), F.count("*").alias("codes"))
    return by.select("path", "model", F.round(F.col("n") * F.log2("n") - F.col("inner") + 16 * (F.col("codes") - 1) + 32, 4).alias("bits"))


# The numbers of the kinds in schema files; false is 1 and true is 2, here both are boolean.
CODES = {"null": 0, "boolean": 2, "object": 3, "array": 4, "string": 5, "int": 6, "double": 7, "series": 8}


def schema(found: DataFrame) -> DataFrame:
    """(place, parts, code): each path with its most frequent kind, in the order of the joined names."""
    by = found.where("parent is not null").groupBy("parts", "kind").agg(F.sum("cnt").alias("cnt"))
    best = by.groupBy("parts").agg(F.max_by("kind", F.struct("cnt", "kind")).alias("kind")).withColumn("name", F.concat_ws("", "parts"))
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), F.col("kind")), F.lit(CODES["string"]))
    return with_row_id(best, "name", "parts", name="place").select("place", "parts", code.cast("int").alias("code"))


def write_schema(found: DataFrame, path: str) -> None:
    """A text file: a heading, a line of names for each path, an empty line, a heading, all codes in one line.

    Other types of JSON variants (dates, binary) are written as strings. A schema has a row for each path
    and not for each document; it is put in order in one file.
    """
    rows = schema(found)
    lines = rows.select(F.col("place"), F.concat_ws(", ", "parts").alias("value"))
    codes = rows.agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])).alias("value"))
    last = 1 << 62
    heads = rows.sparkSession.createDataFrame([(-1, "Attribute path: "), (last, ""), (last + 1, "Attribute Type: ")], "place long, value string")
    every = lines.union(heads).union(codes.select(F.lit(last + 2), "value"))
    every.repartition(1).sortWithinPartitions("place").select("value").write.text(path)


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """(place, parts, code) of a file of ``write_schema``."""
    text = spark.read.text(path, wholetext=True).where("value <> ''").select(F.split(F.regexp_replace("value", "\r", ""), "\n\n").alias("halves"))
    names = F.filter(F.split(F.col("halves")[0], "\n"), lambda _, i: i > 0)
    codes = F.split(F.split(F.col("halves")[1], "\n")[1], ", ")
    rows = text.select(F.posexplode(F.arrays_zip(names.alias("name"), codes.alias("code"))).alias("place", "e"))
    return rows.where("e.name <> ''").select(F.col("place").cast("long").alias("place"), F.split("e.name", ", ").alias("parts"), F.col("e.code").cast("int").alias("code"))
