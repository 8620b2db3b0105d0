"""The declared column types, what they are in Spark, and how text becomes a value."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL_SCALE = 10


@dataclass(frozen=True)
class ColumnType:
    """A declared type; low and high bound integers, integral and numeric classify it."""

    name: str
    spark: T.DataType
    numeric: bool = False
    integral: bool = False
    low: int | None = None
    high: int | None = None


def _whole(name: str, spark: T.DataType, bits: int, signed: bool = True) -> ColumnType:
    low = -(1 << bits - 1) if signed else 0
    return ColumnType(name, spark, True, True, low, low + (1 << bits) - 1)


#: Byte is unsigned, which Spark's own byte is not.
TYPES: dict[str, ColumnType] = {
    t.name: t
    for t in (
        _whole("Byte", T.ShortType(), 8, signed=False),
        _whole("Int16", T.ShortType(), 16),
        _whole("Int32", T.IntegerType(), 32),
        _whole("Int64", T.LongType(), 64),
        ColumnType("Single", T.FloatType(), True),
        ColumnType("Double", T.DoubleType(), True),
        ColumnType("Decimal", T.DecimalType(38, DECIMAL_SCALE), True),
        ColumnType("Char", T.StringType()),
        ColumnType("String", T.StringType()),
        ColumnType("Bool", T.BooleanType()),
    )
}
#: Names that a cast may use beside the types' own.
CAST_NAMES = {name: name for name in TYPES} | {"Float": "Single"}
#: Casts of the strict dialect.
STRICT_CASTS = ("Byte", "Int16", "Int32", "Int64", "Double", "Decimal", "Char", "String")

_INTEGER, _NUMBER = re.compile(r"\s*[+-]?\d+\s*"), re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


def spark_type(name: str, scale: int = DECIMAL_SCALE) -> T.DataType:
    """The Spark type of a declared type."""
    return T.DecimalType(38, scale) if name == "Decimal" else TYPES[name].spark


def declared_type(kind: T.DataType) -> str:
    """The declared type that is closest to a Spark type; types without one are called by Spark's name."""
    simple = {"tinyint": "Int16", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Single", "double": "Double", "string": "String", "boolean": "Bool"}
    return "Decimal" if isinstance(kind, T.DecimalType) else simple.get(kind.simpleString(), kind.simpleString())


def is_numeric(name: str) -> bool:
    return name in TYPES and TYPES[name].numeric


def to_value(name: str, text: str | None):
    """Text as a value of a declared type; None if it is none."""
    if text is None or text == "":
        return None
    kind = TYPES[name]
    if kind.integral:
        value = int(text) if _INTEGER.fullmatch(text) else None
        return value if value is not None and kind.low <= value <= kind.high else None
    if name in ("Single", "Double"):
        return float(text) if _NUMBER.fullmatch(text) else None
    if name == "Decimal":
        try:
            return Decimal(text.strip()) if _NUMBER.fullmatch(text) else None
        except InvalidOperation:
            return None
    if name == "Char":
        return text if len(text) == 1 else None
    if name == "Bool":
        return {"true": True, "false": False}.get(text.strip().lower())
    return text


def checked(column: Column, name: str, label: str) -> Column:
    """A column with the rules of its declared type that Spark's type does not have; a breach fails the query."""
    if name == "Byte":
        broken = (column < 0) | (column > 255)
    elif name == "Char":
        broken = F.length(column) != 1
    else:
        return column
    return F.when(broken, F.raise_error(F.concat(F.lit(f"{label} is no {name}: "), column.cast("string")))).otherwise(column)


def cast(column: Column, name: str) -> Column:
    """A cast by its dialect name."""
    return column.cast(spark_type(CAST_NAMES[name]))


#: Comparison tokens.
COMPARISONS = ("==", "<>", ">", ">=", "<", "<=")


def comparison(token: str) -> str:
    """The comparison a token stands for; `=` and `!=` are other spellings."""
    token = {"=": "==", "!=": "<>"}.get(token, token)
    if token not in COMPARISONS:
        raise ValueError(f"not a comparison: {token}")
    return token


def compare(left: Column, operator: str, right: Column) -> Column:
    """left operator right."""
    return {
        "==": lambda: left == right, "<>": lambda: left != right, ">": lambda: left > right,
        ">=": lambda: left >= right, "<": lambda: left < right, "<=": lambda: left <= right,
    }[comparison(operator)]()
