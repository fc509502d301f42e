"""Column declarations, one a line: ``ENUM cap err``, ``INTEGER err``, ``DOUBLE err``, ``STRING`` and so on."""

from __future__ import annotations

from pyspark.sql import types as T

# The declared kinds, and the type that a column of the kind has.
KINDS = {
    "ENUM": T.StringType(),
    "ENUM-MARKOV": T.StringType(),
    "INTEGER": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESERIES": T.ArrayType(T.FloatType()),
}


def parse(text: str, names: list[str] | None = None) -> T.StructType:
    """The schema that a declaration gives; kind, cap, error and bin size are in each field's metadata.

    Names default to c0, c1, ...; blank lines are passed over. The bin is 2 * error, for integers 1 at
    least; a DOUBLE needs 0 < bin < 1. Unknown kinds and wrong numbers of values raise ValueError.
    """
    fields = []
    for line in text.splitlines():
        if not (words := line.split()):
            continue
        kind, numbers = words[0], [float(w) for w in words[1:]]
        if kind not in KINDS:
            raise ValueError(f"unknown kind of column: {line!r}")
        about: dict = {"kind": kind}
        if kind.startswith("ENUM"):
            if not numbers:
                raise ValueError(f"no cap: {line!r}")
            about["cap"] = int(numbers.pop(0))
        about["error"] = numbers[0] if numbers else 0.0
        if kind == "INTEGER":
            about["bin"] = float(max(1, int(2 * about["error"])))
        elif kind == "DOUBLE":
            about["bin"] = 2 * about["error"]
            if not 0 < about["bin"] < 1:
                raise ValueError(f"the error of a DOUBLE must be over 0 and under 0.5: {line!r}")
        name = names[len(fields)] if names else f"c{len(fields)}"
        fields.append(T.StructField(name, KINDS[kind], True, about))
    return T.StructType(fields)


def enums(schema: T.StructType) -> list[str]:
    """Columns that may serve as predictors."""
    return [f.name for f in schema.fields if f.metadata.get("kind") == "ENUM"]
