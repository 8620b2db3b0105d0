"""The engine's own queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import LoadError
from marlstone.sources.catalog import CatalogMeta, ColumnMeta, Database, TableMeta
from marlstone.sources.loader import load

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}

LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

#: name: (query of the dialect, SQL; None where both are the same text)
SQL: dict[str, tuple[str, str | None]] = {
    "scan_all": ("SELECT * FROM region", None),
    "project_columns": ("SELECT n_name, n_regionkey FROM nation", None),
    "project_alias": ("SELECT n.n_name AS nm, n_regionkey AS rk FROM nation AS n", None),
    "project_repeated": ("SELECT n_name AS a, n_name AS b FROM nation", None),
    "filter_eq": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey == 7", None),
    "filter_ne": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2", None),
    "filter_lt": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 100", None),
    "filter_le": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 100", None),
    "filter_gt": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 1400", None),
    "filter_ge": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 1400", None),
    "filter_string": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment == 'BUILDING'", None),
    "filter_string_range": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'", None),
    "filter_string_quote": ("SELECT c_custkey FROM customer WHERE c_name <> 'it''s'", None),
    "filter_double": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25.0", None),
    "filter_mixed_numbers": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 25", None),
    "filter_and": ("SELECT o_orderkey FROM orders WHERE o_custkey >= 100 AND o_orderstatus == 'F'", None),
    "filter_or": ("SELECT o_orderkey FROM orders WHERE o_custkey < 50 OR o_totalprice > 400000.0", None),
    "filter_precedence": ("SELECT o_orderkey FROM orders WHERE o_custkey < 500 AND o_orderstatus == 'F' OR o_custkey > 1450", None),
    "filter_parentheses": ("SELECT o_orderkey FROM orders WHERE o_custkey < 500 AND (o_orderstatus == 'F' OR o_totalprice > 300000.0)", None),
    "filter_constant_left": ("SELECT o_orderkey, o_custkey FROM orders WHERE 100 > o_custkey", None),
    "filter_columns": ("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax", None),
    "cast_column": ("SELECT p_partkey FROM part WHERE (Int64)p_size > 10", "SELECT p_partkey FROM part WHERE CAST(p_size AS BIGINT) > 10"),
    "cast_literal": ("SELECT p_partkey FROM part WHERE p_retailprice > (Double)1000", "SELECT p_partkey FROM part WHERE p_retailprice > CAST(1000 AS DOUBLE)"),
    "cast_literal_whole": ("SELECT p_partkey, p_size FROM part WHERE p_size > (Int64)20", "SELECT p_partkey, p_size FROM part WHERE p_size > CAST(20 AS BIGINT)"),
    "cast_single": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (Single)l_quantity >= 30", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_quantity AS FLOAT) >= 30"),
    "cast_float": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (Float)l_quantity < 7", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_quantity AS FLOAT) < 7"),
    "cast_to_whole": ("SELECT l_orderkey FROM lineitem WHERE (Decimal)l_quantity == 17", "SELECT l_orderkey FROM lineitem WHERE CAST(l_quantity AS DECIMAL(38, 10)) = 17"),
    "top": (f"SELECT TOP 10 {ORDERS} FROM orders", f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey NULLS FIRST LIMIT 10"),
    "top_where": (f"SELECT TOP 25 {ORDERS} FROM orders WHERE o_custkey > 700 AND o_orderstatus == 'O'", f"SELECT {ORDERS} FROM orders WHERE o_custkey > 700 AND o_orderstatus = 'O' ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST LIMIT 25"),
    "top_or": ("SELECT TOP 5 n_nationkey, n_name FROM nation WHERE n_regionkey == 3 OR n_regionkey == 1", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3 OR n_regionkey = 1 ORDER BY n_nationkey NULLS FIRST LIMIT 5"),
    "top_ties": (f"SELECT TOP 100 {LINES} FROM lineitem WHERE l_quantity >= 50.0", f"SELECT {LINES} FROM lineitem WHERE l_quantity >= 50.0 ORDER BY l_quantity NULLS FIRST, l_orderkey NULLS FIRST, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 100"),
    "top_percent": ("SELECT TOP 7 PERCENT p_partkey, p_name FROM part", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey NULLS FIRST LIMIT (SELECT CAST(ceil(7 * count(*) / 100.0) AS BIGINT) FROM part)"),
    "count_column": ("SELECT COUNT(o_orderkey) AS n FROM orders", "SELECT count(o_orderkey) AS n FROM orders"),
    "count_where": ("SELECT COUNT(o_orderkey) AS n FROM orders WHERE o_totalprice > 100000.0", "SELECT count(o_orderkey) AS n FROM orders WHERE o_totalprice > 100000.0"),
    "count_rows": ("SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "count_unnamed": ("SELECT COUNT(r_regionkey) FROM region", 'SELECT count(r_regionkey) AS "COUNT" FROM region'),
    "sum_whole": ("SELECT SUM(p_size) AS s FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part"),
    "sum_where": ("SELECT SUM(l_linenumber) AS s FROM lineitem WHERE l_returnflag == 'R'", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'R'"),
    "sum_empty": ("SELECT SUM(p_size) AS s FROM part WHERE p_size < 0", "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part WHERE p_size < 0"),
    "avg_whole": ("SELECT AVG(p_size) AS a FROM part", "SELECT avg(p_size) AS a FROM part"),
    "min_max": ("SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_custkey > 10", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_custkey > 10"),
    "min_string": ("SELECT MIN(c_name) AS m FROM customer", "SELECT min(c_name) AS m FROM customer"),
    "max_string": ("SELECT MAX(c_mktsegment) AS m FROM customer WHERE c_acctbal > 0.0", "SELECT max(c_mktsegment) AS m FROM customer WHERE c_acctbal > 0.0"),
    "join_inner": ("SELECT c_name, o_orderkey, o_totalprice FROM customer AS c INNER JOIN orders AS o ON c.c_custkey == o.o_custkey", "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_left": ("SELECT p_partkey, n_name FROM part AS p LEFT OUTER JOIN nation AS n ON p.p_size == n.n_nationkey", "SELECT p_partkey, n_name FROM part LEFT JOIN nation ON p_size = n_nationkey"),
    "join_right": ("SELECT p_partkey, n_name FROM part AS p RIGHT OUTER JOIN nation AS n ON p.p_size == n.n_nationkey", "SELECT p_partkey, n_name FROM part RIGHT JOIN nation ON p_size = n_nationkey"),
    "join_full": ("SELECT p_partkey, n_name FROM part AS p FULL OUTER JOIN nation AS n ON p.p_size == n.n_nationkey", "SELECT p_partkey, n_name FROM part FULL JOIN nation ON p_size = n_nationkey"),
    "join_theta": ("SELECT n_name, r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey < r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_theta_ne": ("SELECT n_name, r_name FROM nation AS n LEFT OUTER JOIN region AS r ON n.n_regionkey <> r.r_regionkey", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey <> r_regionkey"),
    "join_cross_on": ("SELECT n_name, r_name FROM nation AS n CROSS JOIN region AS r ON n.n_regionkey >= r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey >= r_regionkey"),
    "join_where_right": ("SELECT c_name, o_orderkey FROM customer AS c INNER JOIN orders AS o ON c.c_custkey == o.o_custkey WHERE o.o_totalprice > 300000.0 AND c.c_mktsegment == 'BUILDING'", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000.0 AND c_mktsegment = 'BUILDING'"),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey == b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_several": ("SELECT c_name, n_name, r_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey == n.n_nationkey INNER JOIN region AS r ON n.n_regionkey == r.r_regionkey WHERE r_name == 'ASIA'", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "join_aggregate": ("SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM customer AS c LEFT OUTER JOIN orders AS o ON c.c_custkey == o.o_custkey WHERE c_nationkey == 3", "SELECT count(*) AS n, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3"),
    "from_several": ("SELECT n_name, r_name FROM nation AS n, region AS r WHERE n.n_regionkey == r.r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "lenient_text": ("select c_custkey id from customer where c_mktsegment = \"BUILDING\" and c_acctbal > -500;", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > -500"),
    "limit_order": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "is_null": ("SELECT n_name FROM part AS p RIGHT OUTER JOIN nation AS n ON p.p_size == n.n_nationkey WHERE p_partkey IS NULL", "SELECT n_name FROM part RIGHT JOIN nation ON p_size = n_nationkey WHERE p_partkey IS NULL"),
    "is_not_null": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL"),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9", None),
    "in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)", None),
    "like": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND NOT p_brand LIKE '%1'", None),
}


def database(spark: SparkSession, sf_dir: str, strict: bool = False) -> Database:
    return Database.from_parquet(spark, sf_dir, KEYS, KEYS, strict)


#: The catalog of the archive, with names in the titled form.
TITLED = """{"Version": "1.01", "Description": "two tables", "Name": "test", "PageSize": 255, "Tables": [
 {"Name": "nation", "FileName": "nation.txt", "Generate": true, "Multikey": false, "Rows": 25, "Columns": [
  {"Name": "n_nationkey", "Index": 0, "Type": "Int32", "Key": true, "Indexed": true, "Unique": true}, {"Name": "n_name", "Index": 1, "Type": "String", "Key": false, "Indexed": false},
  {"Name": "n_regionkey", "Index": 2, "Type": "Int32", "Key": false, "Indexed": true, "Unique": false}]},
 {"Name": "absent", "Generate": false, "Columns": [{"Name": "a", "Index": 0, "Type": "Byte", "Key": true, "Indexed": true}]}]}"""


def _loaded(spark: SparkSession, sf_dir: str, kind: str, header: str = "n_nationkey,n_name,n_regionkey", catalog: str | CatalogMeta = TITLED) -> Database:
    """Write nation as CSV into an archive and load it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    folder = tempfile.mkdtemp()
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").toLocalIterator()
    archive = os.path.join(folder, "tables.zip")
    with zipfile.ZipFile(archive, "w") as out:
        lines = [header, *(f'{r["n_nationkey"]},"{r["n_name"]}",{r["n_regionkey"]}' for r in rows)]
        out.writestr("nation.txt", "\n".join(lines) + "\n")
    return load(spark, archive, catalog, f"{shared}/load-{uuid.uuid4().hex}", kind)


def _roundtrip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    columns = [ColumnMeta("n_nationkey", "Int32", True, True), ColumnMeta("n_name", "String"), ColumnMeta("n_regionkey", "Int32", indexed=True)]
    return lambda spark, sf_dir: _loaded(spark, sf_dir, kind, catalog=CatalogMeta("test", tables=[TableMeta("nation", columns)])).table("nation")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loader says to a header that names columns in another order."""
    try:
        _loaded(spark, sf_dir, "csv", "n_name,n_nationkey,n_regionkey")
        said = "loaded"
    except LoadError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a catalog after it was written as JSON and read again."""
    meta = CatalogMeta.from_json(CatalogMeta.from_json(TITLED).check().to_json())
    rows = [(t.name, t.generate, i, c.name, c.type, c.key, c.indexed, c.unique) for t in meta.tables for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "tab string, generated boolean, ordinal int, col string, type string, is_key boolean, indexed boolean, uniq boolean")


def _printed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The result of a query that was parsed and printed before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        return db.sql(db.parse(text).to_sql())

    return run


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of region as objects of its record class, and back."""
    db = database(spark, sf_dir)
    kind = db.record_class("region")
    made = [kind.from_row(r) for r in db.table("region").collect()]  # five rows
    return spark.createDataFrame([(r.r_regionkey, r.r_name) for r in made], "r_regionkey long, r_name string")


TREE_SQL = """WITH RECURSIVE d AS (SELECT count(DISTINCT {column}) AS n FROM {table}), t(n) AS (SELECT n FROM d UNION ALL SELECT unnest([n // 2, n - n // 2 - 1]) FROM t WHERE n > 255)
SELECT (SELECT n FROM d) AS "distinct", count(*) FILTER (n BETWEEN 1 AND 255) AS leaf_pages, count(*) FILTER (n > 255) AS inner_nodes, count(*) FILTER (n BETWEEN 1 AND 255) AS leaf_nodes, 2 * count(*) FILTER (n BETWEEN 1 AND 255) + count(*) FILTER (n > 255) AS pages FROM t"""

API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "compare_rows": (lambda s, d: database(s, d).compare("part.p_size", ">", "20"), "SELECT * FROM part WHERE p_size > 20"),
    "compare_keys": (lambda s, d: database(s, d).compare_keys("part.p_size", "<=", 4), "SELECT p_partkey FROM part WHERE p_size <= 4"),
    "find_key": (lambda s, d: database(s, d).find("customer", 77), "SELECT * FROM customer WHERE c_custkey = 77"),
    "find_keys": (lambda s, d: database(s, d).find("lineitem", 9, 1).select(*LINES.split(", ")), f"SELECT {LINES} FROM lineitem WHERE l_orderkey = 9 AND l_linenumber = 1"),
    "range_keys": (lambda s, d: database(s, d).between("supplier.s_suppkey", 3, 30), "SELECT * FROM supplier WHERE s_suppkey BETWEEN 3 AND 30"),
    "ordered_scan": (lambda s, d: database(s, d).scan("supplier", ordered=True), "SELECT * FROM supplier"),
    "index_groups": (lambda s, d: database(s, d).index_groups("orders.o_custkey"), "SELECT o_custkey AS key, count(*) AS rows FROM orders GROUP BY 1"),
    "duplicate_keys": (lambda s, d: database(s, d).duplicate_keys("lineitem.l_orderkey"), "SELECT l_orderkey AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1"),
    "is_unique": (lambda s, d: database(s, d).is_unique("orders.o_orderkey"), 'SELECT count(o_orderkey) AS rows, count(DISTINCT o_orderkey) AS distinct, count(o_orderkey) = count(DISTINCT o_orderkey) AS "unique" FROM orders'),
    "tables_info": (
        lambda s, d: database(s, d).tables_info().where("table IN ('region', 'nation', 'lineitem')").select("table", "ordinal", "column", "key"),
        """SELECT * FROM (VALUES ('region', 0, 'r_regionkey', true), ('region', 1, 'r_name', false), ('nation', 0, 'n_nationkey', true), ('nation', 1, 'n_name', false), ('nation', 2, 'n_regionkey', false),
        ('lineitem', 0, 'l_orderkey', true), ('lineitem', 1, 'l_partkey', false), ('lineitem', 2, 'l_suppkey', false), ('lineitem', 3, 'l_linenumber', true), ('lineitem', 4, 'l_quantity', false), ('lineitem', 5, 'l_extendedprice', false),
        ('lineitem', 6, 'l_discount', false), ('lineitem', 7, 'l_tax', false), ('lineitem', 8, 'l_returnflag', false), ('lineitem', 9, 'l_linestatus', false), ('lineitem', 10, 'l_shipdate', false)) AS t("table", ordinal, "column", "key")""",
    ),
    "load_parquet": (_roundtrip("parquet"), "SELECT * FROM nation"),
    "load_csv": (_roundtrip("csv"), "SELECT * FROM nation"),
    "index_report": (lambda s, d: database(s, d).index_report("orders.o_orderkey"), TREE_SQL.format(column="o_orderkey", table="orders")),
    "index_report_small": (lambda s, d: database(s, d).index_report("orders.o_custkey"), TREE_SQL.format(column="o_custkey", table="orders")),
    "find_two_keys": (lambda s, d: database(s, d).find("lineitem", 2, 4).select(*LINES.split(", ")), f"SELECT {LINES} FROM lineitem WHERE l_orderkey = 2 AND l_linenumber = 4"),
    "csv_compare": (lambda s, d: _loaded(s, d, "csv").compare("nation.n_regionkey", ">=", "2"), "SELECT * FROM nation WHERE n_regionkey >= 2"),
    "csv_sum": (lambda s, d: _loaded(s, d, "csv").sql("SELECT SUM(n_nationkey) AS s, AVG(n_regionkey) AS a FROM nation"), "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s, avg(n_regionkey) AS a FROM nation"),
    "load_counts": (
        lambda s, d: _loaded(s, d, "parquet").tables_info().select(F.col("table").alias("tab"), F.col("rows").alias("n"), F.col("column").alias("col"), "indexed", F.col("distinct").alias("n_distinct"), F.col("unique").alias("uniq")),
        """SELECT 'nation' AS tab, (SELECT count(*) FROM nation) AS n, 'n_nationkey' AS col, true AS indexed, (SELECT count(DISTINCT n_nationkey) FROM nation) AS n_distinct, true AS uniq
        UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_name', false, NULL, false
        UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 'n_regionkey', true, (SELECT count(DISTINCT n_regionkey) FROM nation), false
        UNION ALL SELECT 'absent', NULL, 'a', true, NULL, false""",
    ),
    "load_header_refused": (_refused, """SELECT 'nation: the header is [''n_name'', ''n_nationkey'', ''n_regionkey''], declared is [''n_nationkey'', ''n_name'', ''n_regionkey'']' AS said"""),
    "catalog_exported": (
        _exported,
        """SELECT * FROM (VALUES ('nation', true, 0, 'n_nationkey', 'Int32', true, true, true), ('nation', true, 1, 'n_name', 'String', false, false, false), ('nation', true, 2, 'n_regionkey', 'Int32', false, true, false),
        ('absent', false, 0, 'a', 'Byte', true, true, false)) AS t(tab, generated, ordinal, col, type, is_key, indexed, uniq)""",
    ),
    "query_printed": (
        _printed("select top 7 c.c_custkey as id, n_name from customer c join nation n on c.c_nationkey = n.n_nationkey where (c.c_acctbal > -10 or n_name <> \"x\") and c_custkey in (1, 2, 3, 50)"),
        "SELECT c_custkey AS id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_acctbal > -10 OR n_name <> 'x') AND c_custkey IN (1, 2, 3, 50)",
    ),
    "record_class": (_records, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "strict_average": (lambda s, d: database(s, d, strict=True).sql("SELECT AVG(p_size) AS a FROM part"), "SELECT CAST(round_even(avg(p_size), 0) AS INTEGER) AS a FROM part"),
    "strict_sum": (lambda s, d: database(s, d, strict=True).sql("SELECT SUM(n_regionkey) AS s FROM nation WHERE n_nationkey < 0"), "SELECT CAST(0 AS INTEGER) AS s"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    asked = {name: (lambda s, d, text=text: database(s, d).sql(text)) for name, (text, _) in SQL.items()}
    rounded = {
        "sum_double": lambda s, d: database(s, d).sql("SELECT SUM(l_extendedprice) AS v FROM lineitem").select(F.round("v", 2).alias("v")),
        "avg_double": lambda s, d: database(s, d).sql("SELECT AVG(o_totalprice) AS v FROM orders WHERE o_custkey > 100").select(F.round("v", 4).alias("v")),
    }
    return asked | rounded | {name: run for name, (run, _) in API.items()}


def oracle_sql() -> dict[str, str]:
    asked = {name: sql or text.replace("==", "=") for name, (text, sql) in SQL.items()}
    rounded = {"sum_double": "SELECT round(sum(l_extendedprice), 2) AS v FROM lineitem", "avg_double": "SELECT round(avg(o_totalprice), 4) AS v FROM orders WHERE o_custkey > 100"}
    return asked | rounded | {name: sql for name, (_, sql) in API.items()}
