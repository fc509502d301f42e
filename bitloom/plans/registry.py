"""Kinds of columns with what learns their models, and interpreters that turn values into predictors' codes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions import tokens
from bitloom.operators import categorical, numeric
from bitloom.operators.categorical import MOST_CELLS
from bitloom.plans.lineage import checkpoint

#: kind: function of (table, field, order columns, predictors) to a model's table.
LEARNERS: dict[str, Callable] = {}
#: column: function of the column to a small code.
INTERPRETERS: dict[str, Callable[[Column], Column]] = {}


def learner(kind: str):
    """Registers the decorated function for columns of the kind; a later one replaces it."""

    def add(function):
        LEARNERS[kind] = function
        return function

    return add


def interpret(column: str, function: Callable[[Column], Column]) -> None:
    """Lets a column that is no ENUM serve as a predictor, by the code that the function gives."""
    INTERPRETERS[column] = function


def bucket(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds the value reaches (long); null stays null."""
    return sum((F.when(value.isNotNull(), (value >= b).cast("long")) for b in bounds), F.lit(0).cast("long"))


@learner("ENUM")
def _(df: DataFrame, field: T.StructField, order: list[str], *predictors: str) -> DataFrame:
    return categorical.weights(categorical.histogram(df, field.name, *predictors), field.name, *predictors)


@learner("INTEGER")
@learner("DOUBLE")
def _(df: DataFrame, field: T.StructField, order: list[str], *predictors: str) -> DataFrame:
    return numeric.quantile_sketch(df, field.name, order, field.metadata["bin"], *predictors)


@learner("STRING")
def _(df: DataFrame, field: T.StructField, order: list[str], *predictors: str) -> DataFrame:
    pieces = checkpoint(tokens.piece_counts(df, field.name))
    return tokens.global_dictionary(tokens.words_of(pieces), tokens.phrases_of(pieces))


def candidates(schema: T.StructType, target: str, predictors: tuple[str, ...]) -> bool:
    """Whether the target may have these predictors: ENUM columns or interpreted ones, MOST_CELLS cells in all
    by their caps; a STRING has none, ENUM-MARKOV none but its own state."""
    if schema[target].metadata["kind"] not in ("ENUM", "INTEGER", "DOUBLE"):
        return not predictors
    caps = [schema[p].metadata.get("cap") if schema[p].metadata["kind"] == "ENUM" else MOST_CELLS if p in INTERPRETERS else None for p in predictors]
    return target not in predictors and all(caps) and math.prod(caps) <= MOST_CELLS


def learn(df: DataFrame, schema: T.StructType, order: list[str], predictors: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """Each declared column's model, by the learner of its kind; interpreted predictors are columns of their codes.

    Raises ValueError where a kind has no learner or predictors are no candidates.
    """
    out = {}
    for field in schema.fields:
        wanted = (predictors or {}).get(field.name, ())
        if field.metadata["kind"] not in LEARNERS or not candidates(schema, field.name, wanted):
            raise ValueError(f"{field.name}: no learner of its kind, or predictors that it may not have: {wanted}")
        coded = df.withColumns({p: INTERPRETERS[p](F.col(p)) for p in wanted if p in INTERPRETERS and p not in order})
        out[field.name] = LEARNERS[field.metadata["kind"]](coded, field, order, *wanted)
    return out
