"""Delimited text without a header, read and written with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Rows of the file or folder. Quotes follow RFC 4180, blank lines are skipped, CRLF ends a line too.

    A field that does not parse stops the job (FAILFAST), so no row is lost unseen. Empty fields are null.
    """
    return spark.read.csv(path, schema=schema, sep=sep, header=False, mode="FAILFAST", escape='"')


def rendered(df: DataFrame, decimals: int = 6) -> DataFrame:
    """``df`` as text: doubles with a fixed number of decimals, everything else as Spark casts it."""
    show = lambda f: F.format_string(f"%.{decimals}f", f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string")
    return df.select(*(F.when(F.col(f.name).isNotNull(), show(f)).alias(f.name) for f in df.schema.fields))


def write(df: DataFrame, path: str, sep: str = ",", decimals: int = 6) -> None:
    """Text that ``read`` takes back; fields with separators or quotes are quoted."""
    rendered(df, decimals).write.csv(path, sep=sep, header=False, escape='"')
