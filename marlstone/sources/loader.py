"""From an archive of CSV files to a database."""

from __future__ import annotations

import csv
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import LoadError
from marlstone.functions.types import checked
from marlstone.operators.indexing import is_unique
from marlstone.sources.catalog import CATALOG_FILE, CatalogMeta, Database, TableMeta, write_text


def unzip(archive: str, folder: str) -> list[str]:
    """Copy the files of an archive into a folder, by base name; returns the names."""
    if not os.path.isfile(archive) or not archive.lower().endswith(".zip"):
        raise LoadError(f"no zip archive: {archive}")
    names = []
    with zipfile.ZipFile(archive) as source:
        for info in source.infolist():
            if not info.is_dir():
                names.append(os.path.basename(info.filename))
                with source.open(info) as a, open(os.path.join(folder, names[-1]), "wb") as b:
                    shutil.copyfileobj(a, b)
    return names


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def upload(spark: SparkSession, local: str, path: str) -> None:
    """Copy a file of the driver to where executors can read it."""
    files, target = _filesystem(spark, path)
    files.mkdirs(target.getParent())
    files.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _filesystem(spark, path)
    files.delete(target, True)


def check_header(spark: SparkSession, path: str, table: TableMeta) -> None:
    """The first line must name the declared columns in their order."""
    first = spark.read.text(path).limit(1).collect()
    found = next(csv.reader([first[0][0].lstrip("﻿")])) if first else []
    declared = [c.name for c in table.columns]
    if found != declared:
        raise LoadError(f"{table.name}: the header is {found}, declared is {declared}")


def read_csv(spark: SparkSession, path: str, table: TableMeta) -> DataFrame:
    """A CSV file by its declaration. Empty fields are null; a value that does not fit fails the query."""
    check_header(spark, path, table)
    df = spark.read.csv(path, schema=table.schema(), header=True, enforceSchema=True, mode="FAILFAST", quote='"', escape='"', multiLine=table.multiline, encoding="UTF-8")
    return df.select(*(checked(F.col(f"`{c.name}`"), c.type, f"{table.name}.{c.name}").alias(c.name, metadata=c.field().metadata) for c in table.columns))


def write_table(df: DataFrame, path: str, table: TableMeta, kind: str = "parquet") -> None:
    """Write a table sorted by its first key, so that a key lookup skips row groups; other indexed columns get a bloom filter."""
    keys = table.keys()
    if keys:
        df = df.repartitionByRange(F.col(f"`{keys[0]}`")).sortWithinPartitions(*(F.col(f"`{k}`") for k in keys))
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        writer = df.write.mode("overwrite")
        for c in table.columns:
            if c.indexed and c.name not in keys[:1] and c.type not in ("Byte", "Bool"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
        writer.parquet(path)


def load(spark: SparkSession, archive: str, catalog: str | CatalogMeta, path: str, kind: str = "parquet", strict: bool = False) -> Database:
    """Load the tables of a zip archive, `<table>.txt` or `<table>.csv` each, into the folder `path`; open the database.

    catalog is the JSON of a catalog or a catalog; tables not to be generated are skipped. In the strict dialect an
    indexed column may hold no null. The archive is the driver's; its files are copied beside the tables, where all
    executors can read them, and removed at the end. The catalog is written with row counts, and for indexed columns
    with distinct counts and uniqueness.
    """
    meta = (CatalogMeta.from_json(catalog) if isinstance(catalog, str) else catalog).check()
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="load-")
    try:
        names = unzip(archive, folder)
        for table in meta.tables:
            if not table.generate:
                continue
            name = next((n for n in (f"{table.name}.txt", f"{table.name}.csv") if n in names), None)
            if name is None:
                raise LoadError(f"{table.name}: not in the archive")
            upload(spark, os.path.join(folder, name), f"{staging}/{name}")
            write_table(read_csv(spark, f"{staging}/{name}", table), f"{path}/{table.name}", table, kind)
            table.format = kind
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        remove(spark, staging)
    write_text(spark, f"{path}/{CATALOG_FILE}", meta.to_json())
    db = Database.open(spark, path, strict)
    for table in db.meta.tables:
        if table.generate:
            _count(db, table, strict)
    db.save()
    return db


def _count(db: Database, table: TableMeta, strict: bool) -> None:
    df = db.table(table.name)
    indexed = [c for c in table.columns if c.indexed]
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.col(f"`{c.name}`").isNull(), 1)).alias(f"null{i}") for i, c in enumerate(indexed))).first()
    table.rows = sums["rows"]
    for i, c in enumerate(indexed):
        if strict and sums[f"null{i}"]:
            raise LoadError(f"{table.name}.{c.name} is indexed and has {sums[f'null{i}']} nulls")
        found = is_unique(df, c.name).first()
        c.distinct, c.unique = found["distinct"], found["unique"]
