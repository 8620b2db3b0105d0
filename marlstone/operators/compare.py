"""Comparison and lookup without the dialect: plain filters, which reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import CatalogError
from marlstone.functions.types import compare


def compare_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """Rows whose column compares with a value; null never does."""
    return df.where(compare(F.col(f"`{column}`"), operator, F.lit(value)))


def find(df: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """Rows with the given values of the first keys."""
    if not values or len(values) > len(keys):
        raise CatalogError(f"{len(values)} values for the keys {keys}")
    return df.where(reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.lit(v) for k, v in zip(keys, values))))
