"""The corpus pipeline: quality rules, near-dedup, decontamination, PII masking, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import common, decontaminate, mixing, neardup, pii, quality

#: (name, function of spark, docs and sf_dir); each works on all that its predecessor kept.
STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
]

#: The label model, the field's marginals and the draws have no SQL form; tests use brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the documents are a Parquet table in the shared folder.

    A stage's table goes once its successor's is written; the last one stays, as the result reads it.
    """
    docs, last = common.read(spark, sf_dir, "documents"), None
    for number, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                _remove(spark, last)
            last = path
    return docs
