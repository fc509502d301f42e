"""Learned models as Parquet tables beside the blocks, with the order of the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(spark: SparkSession, models: dict[str, DataFrame], order: list[tuple[str, tuple[str, ...], float]], path: str) -> None:
    """One table for each model, numbered, and one of the columns: place, name, predictors, bits.

    ``order`` is what ``categorical.structure`` gives; columns without a place in it follow by name.
    Names are data and not folders, so that any name will do.
    """
    known = {name: (predictors, bits) for name, predictors, bits in order}
    names = [*known, *sorted(n for n in models if n not in known)]
    rows = [(i, n, list(known.get(n, ((), None))[0]), known.get(n, ((), None))[1], n in models) for i, n in enumerate(names)]
    for i, n, *_ in rows:
        if n in models:
            models[n].write.option("compression", "zstd").parquet(f"{path}/model_{i}")
    # Written last: a folder without it is not whole.
    spark.createDataFrame(rows, "place int, name string, predictors array<string>, bits double, stored boolean").coalesce(1).write.parquet(f"{path}/columns")


def read(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[tuple[str, tuple[str, ...], float]]]:
    """(models, order) of what ``write`` left; a row for each column reaches the driver."""
    rows = sorted(spark.read.parquet(f"{path}/columns").collect())
    models = {r.name: spark.read.parquet(f"{path}/model_{r.place}") for r in rows if r.stored}
    return models, [(r.name, tuple(r.predictors), r.bits) for r in rows if r.bits is not None]
