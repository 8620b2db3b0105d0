"""The five whole-input aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.types import TYPES, spark_type

AGGREGATES = ("COUNT", "AVG", "SUM", "MIN", "MAX")


def aggregate(function: str, column: Column | None, declared: str, strict: bool = False) -> Column:
    """An aggregate of a column; COUNT without a column counts rows.

    Nulls are skipped, sums and averages have Spark's types, and an empty input gives null (COUNT: 0). In the strict
    dialect COUNT counts rows, an empty SUM is 0, and SUM and AVG come back in the type of the column, whole numbers
    rounded half to even.
    """
    if function == "COUNT":
        return F.count(F.lit(1)) if column is None or strict else F.count(column)
    out = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[function](column)
    if strict and function in ("AVG", "SUM") and declared in TYPES:
        if function == "AVG" and TYPES[declared].integral:
            out = F.bround(out, 0)
        out = out.cast(spark_type(declared))
        out = F.coalesce(out, F.lit(0).cast(spark_type(declared))) if function == "SUM" else out
    return out
