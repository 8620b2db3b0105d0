"""Databases: named tables with declared columns, keys and indexes."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, make_dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.dialect import nodes as N
from marlstone.dialect.parser import parse
from marlstone.dialect.validator import resolve
from marlstone.errors import CatalogError, NameError_
from marlstone.functions.types import DECIMAL_SCALE, TYPES, declared_type, spark_type, to_value
from marlstone.operators import compare as compare_op
from marlstone.operators import indexing
from marlstone.plans.planner import plan

CATALOG_FILE = "catalog.json"


@dataclass
class ColumnMeta:
    """A declared column. distinct is the number of its distinct values, known for indexed columns after a load."""

    name: str
    type: str
    key: bool = False
    indexed: bool = False
    unique: bool = False
    scale: int = DECIMAL_SCALE
    distinct: int | None = None

    def field(self) -> T.StructField:
        kind = spark_type(self.type, self.scale) if self.type in TYPES else T._parse_datatype_string(self.type)
        return T.StructField(self.name, kind, True, {"key": self.key, "indexed": self.indexed, "unique": self.unique, "type": self.type})


@dataclass
class TableMeta:
    """A declared table; a table that is not generated is skipped by the loader.

    Where no field of its CSV file holds a line break, multiline may be false, and tasks share the file.
    """

    name: str
    columns: list[ColumnMeta]
    rows: int | None = None
    generate: bool = True
    format: str = "parquet"
    multiline: bool = True

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    def multikey(self) -> bool:
        return len(self.keys()) > 1

    def column(self, which: str | int) -> ColumnMeta:
        """A column by name or by ordinal."""
        if isinstance(which, int):
            return self.columns[which]
        for c in self.columns:
            if c.name == which:
                return c
        raise NameError_(f"no column {which} in {self.name}")


@dataclass
class CatalogMeta:
    """What the catalog file holds."""

    name: str = ""
    version: str = "1"
    description: str = ""
    page_size: int = 255
    tables: list[TableMeta] = field(default_factory=list)

    def check(self) -> CatalogMeta:
        """Every table needs a key; names are unique; types are known; a page holds at least one entry."""
        if self.page_size < 1:
            raise CatalogError("the page size must be positive")
        if len({t.name for t in self.tables}) < len(self.tables):
            raise CatalogError("a table is declared twice")
        for t in self.tables:
            if not t.keys():
                raise CatalogError(f"table {t.name} has no key")
            if len({c.name for c in t.columns}) < len(t.columns):
                raise CatalogError(f"table {t.name} declares a column twice")
            for c in t.columns:
                if c.type not in TYPES:
                    raise CatalogError(f"{t.name}.{c.name}: no type {c.type}")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> CatalogMeta:
        """A catalog of our own shape, or of that with names like `Tables`, `Columns`, `Key` and `PageSize`."""
        raw = json.loads(text)
        if "Tables" in raw:
            return CatalogMeta._of_titled(raw)
        tables = [TableMeta(**{**t, "columns": [ColumnMeta(**c) for c in t["columns"]]}) for t in raw.pop("tables")]
        return CatalogMeta(**raw, tables=tables)

    @staticmethod
    def _of_titled(raw: dict) -> CatalogMeta:
        """Columns stand in the order of their `Index` where they have one; what only describes files is ignored."""
        tables = []
        for t in raw["Tables"]:
            columns = sorted(enumerate(t["Columns"]), key=lambda c: c[1].get("Index", c[0]))
            made = [ColumnMeta(c["Name"], c["Type"], c.get("Key", False), c.get("Indexed", False), c.get("Unique", False)) for _, c in columns]
            tables.append(TableMeta(t["Name"], made, t.get("Rows"), t.get("Generate", True)))
        return CatalogMeta(raw.get("Name", ""), raw.get("Version", "1"), raw.get("Description", ""), raw.get("PageSize", 255), tables)


#: What a catalog file has to look like.
CATALOG_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["tables"],
    "properties": {
        "name": {"type": "string"}, "version": {"type": "string"}, "description": {"type": "string"}, "page_size": {"type": "integer", "minimum": 1},
        "tables": {"type": "array", "items": {"type": "object", "required": ["name", "columns"], "properties": {
            "name": {"type": "string"}, "rows": {"type": ["integer", "null"]}, "generate": {"type": "boolean"}, "format": {"enum": ["parquet", "csv"]}, "multiline": {"type": "boolean"},
            "columns": {"type": "array", "items": {"type": "object", "required": ["name", "type"], "properties": {
                "name": {"type": "string"}, "type": {"enum": list(TYPES)}, "key": {"type": "boolean"}, "indexed": {"type": "boolean"},
                "unique": {"type": "boolean"}, "scale": {"type": "integer"}, "distinct": {"type": ["integer", "null"]}}}}}}},
    },
}


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through Spark's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Overwrite a small file, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


class Database:
    """Tables that can be asked by the dialect or by method. strict chooses the strict dialect for all queries."""

    def __init__(self, spark: SparkSession, meta: CatalogMeta, frames: dict[str, DataFrame], strict: bool = False, path: str | None = None):
        self.spark, self.meta, self.frames, self.strict, self.path = spark, meta, frames, strict, path

    @classmethod
    def open(cls, spark: SparkSession, path: str, strict: bool = False) -> Database:
        """Open a database that the loader wrote. Tables that were not generated are not there."""
        meta = CatalogMeta.from_json(read_text(spark, f"{path}/{CATALOG_FILE}")).check()
        frames = {}
        for t in meta.tables:
            if t.generate:
                reader = spark.read.schema(t.schema())
                frames[t.name] = reader.csv(f"{path}/{t.name}", header=True, quote='"', escape='"', mode="FAILFAST", multiLine=t.multiline) if t.format == "csv" else reader.parquet(f"{path}/{t.name}")
        return cls(spark, meta, frames, strict, path)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, tables: Iterable[str], keys: dict[str, list[str]] | None = None, strict: bool = False) -> Database:
        """A database over Parquet tables `path/name.parquet` without a catalog; keys are declared here and indexed."""
        frames = {t: spark.read.parquet(f"{path}/{t}.parquet") for t in tables}
        return cls.from_frames(spark, frames, keys, strict)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, strict: bool = False) -> Database:
        """A database over DataFrames."""
        own = lambda t: (keys or {}).get(t, [])
        tables = [TableMeta(t, [ColumnMeta(f.name, declared_type(f.dataType), f.name in own(t), f.name in own(t)) for f in df.schema]) for t, df in frames.items()]
        return cls(spark, CatalogMeta(tables=tables), frames, strict)

    # What queries may name.

    def table_names(self) -> list[str]:
        return list(self.frames)

    def has_table(self, table: str) -> bool:
        return table in self.frames

    def columns_of(self, table: str) -> list[str]:
        return [c.name for c in self.table_meta(table).columns]

    def has_column(self, table: str, column: str) -> bool:
        return self.has_table(table) and column in self.columns_of(table)

    def tables_of(self, column: str) -> list[str]:
        return [t for t in self.frames if column in self.columns_of(t)]

    def column_type(self, table: str, column: str) -> str:
        return self.table_meta(table).column(column).type

    # Catalog.

    def table_meta(self, table: str) -> TableMeta:
        for t in self.meta.tables:
            if t.name == table:
                return t
        raise NameError_(f"no table {table}")

    def table(self, table: str) -> DataFrame:
        if table not in self.frames:
            raise NameError_(f"no table {table}")
        return self.frames[table]

    __getitem__ = table

    def index(self, table: str, column: str | None = None) -> ColumnMeta:
        """A column by table and name, or by `table.column`."""
        if column is None:
            table, _, column = table.partition(".")
        return self.table_meta(table).column(column)

    def tables_info(self) -> DataFrame:
        """One row per column: table, rows, ordinal, column, type, key, indexed, unique, distinct, pages."""
        rows = [
            (t.name, t.rows, i, c.name, c.type, c.key, c.indexed, c.unique, c.distinct, sum(indexing.page_counts(c.distinct, self.meta.page_size)) if c.distinct is not None else None)
            for t in self.meta.tables for i, c in enumerate(t.columns)
        ]
        return self.spark.createDataFrame(rows, "table string, rows long, ordinal int, column string, type string, key boolean, indexed boolean, unique boolean, distinct long, pages long")

    def record_class(self, table: str) -> type:
        """A dataclass with a field for each column of a table; `from_row` makes one of a row."""
        meta = self.table_meta(table)
        kinds = {"Single": float, "Double": float, "Decimal": Decimal, "Bool": bool} | {t.name: int for t in TYPES.values() if t.integral}
        made = make_dataclass(meta.name, [(c.name, kinds.get(c.type, str) | None, field(default=None)) for c in meta.columns], frozen=True)
        made.from_row = classmethod(lambda cls, row: cls(*(row[c.name] for c in meta.columns)))
        return made

    def export_json(self, path: str) -> None:
        write_text(self.spark, path, self.meta.to_json())

    def save(self) -> None:
        """Write the catalog back to the folder the database was opened from."""
        if self.path is None:
            raise CatalogError("this database has no folder")
        self.export_json(f"{self.path}/{CATALOG_FILE}")

    # Queries.

    def parse(self, text: str, strict: bool | None = None) -> N.Query:
        """Parse a query and bind its names; nothing is run."""
        strict = self.strict if strict is None else strict
        return resolve(parse(text, strict), self, strict)

    def sql(self, text: str, strict: bool | None = None) -> DataFrame:
        """The result of a query of the dialect."""
        strict = self.strict if strict is None else strict
        return plan(self.parse(text, strict), self.table, lambda t: self.table_meta(t).keys(), self.columns_of, strict)

    def _split(self, name: str) -> tuple[str, str]:
        table, _, column = name.partition(".")
        if not self.has_column(table, column):
            raise NameError_(f"no column {name}")
        return table, column

    def compare(self, name: str, operator: str, value) -> DataFrame:
        """The rows of a table whose column `table.column` compares with a value, given as such or as text."""
        table, column = self._split(name)
        declared = self.column_type(table, column)
        if isinstance(value, str) and declared in TYPES:
            parsed = to_value(declared, value)
            if parsed is None and value != "":
                raise NameError_(f"{value!r} is no {declared}")
            value = parsed
        return compare_op.compare_rows(self.table(table), column, operator, value)

    def compare_keys(self, name: str, operator: str, value) -> DataFrame:
        """The keys of those rows; for tables of one key."""
        table, _ = self._split(name)
        keys = self.table_meta(table).keys()
        if len(keys) != 1:
            raise CatalogError(f"{table} has {len(keys)} keys")
        return self.compare(name, operator, value).select(keys[0])

    def find(self, table: str, *values) -> DataFrame:
        """The rows with the given key values, in the order of the keys."""
        return compare_op.find(self.table(table), self.table_meta(table).keys(), values)

    def between(self, name: str, low, high) -> DataFrame:
        """The rows whose column lies between two values, both included."""
        table, column = self._split(name)
        return self.table(table).where(F.col(f"`{column}`").between(low, high))

    def scan(self, table: str, ordered: bool = False) -> DataFrame:
        """All rows; ordered ones ascend by the first key."""
        df, keys = self.table(table), self.table_meta(table).keys()
        return df.orderBy(F.col(f"`{keys[0]}`").asc_nulls_first()) if ordered and keys else df

    def index_groups(self, name: str) -> DataFrame:
        table, column = self._split(name)
        return indexing.index_groups(self.table(table), column)

    def duplicate_keys(self, name: str) -> DataFrame:
        table, column = self._split(name)
        return indexing.duplicate_keys(self.table(table), column)

    def is_unique(self, name: str) -> DataFrame:
        table, column = self._split(name)
        return indexing.is_unique(self.table(table), column)

    def index_report(self, name: str) -> DataFrame:
        table, column = self._split(name)
        return indexing.index_report(self.table(table), column, self.meta.page_size)
