import io
import json
import zipfile

import duckdb
import pytest

from marlstone import queries as engine
from marlstone.cli import Console
from marlstone.errors import CatalogError, LoadError, NameError_, ParseError
from marlstone.functions.types import TYPES, comparison, to_value
from marlstone.operators.indexing import page_counts
from marlstone.render import pages
from marlstone.sources.catalog import CATALOG_SCHEMA, CatalogMeta, ColumnMeta, Database, TableMeta
from marlstone.sources.loader import load
from marlstone.streaming import stream_sql

SF = "/root/testdata/sf0.001"
ROUTES = [ColumnMeta("route_id", "Int32", True, True), ColumnMeta("agency_id", "String"), ColumnMeta("short", "String", indexed=True), ColumnMeta("kind", "Int16"), ColumnMeta("price", "Decimal"), ColumnMeta("level", "Byte"), ColumnMeta("mark", "Char")]
HEADER = "route_id,agency_id,short,kind,price,level,mark"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in engine.KEYS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", list(engine.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    got = engine.queries()[name](spark, SF)
    want = oracle.execute(engine.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.fetchall())


@pytest.fixture(scope="module")
def small(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, None, None), (3, "y", 4.0), (3, "z", None), (None, "x", 5.0)], "k int, s string, v double")
    return Database.from_frames(spark, {"t": a, "u": a.limit(0)}, {"t": ["k"]})


def test_nulls(small):
    ask = lambda text, **o: [tuple(r) for r in small.sql(text, **o).collect()]
    assert ask("SELECT COUNT(s) FROM t") == [(4,)] and ask("SELECT COUNT(s) FROM t", strict=True) == [(5,)]
    assert ask("SELECT k FROM t WHERE s <> 'x'") == [(3,), (3,)]
    assert ask("SELECT TOP 2 k, s FROM t") == [(None, "x"), (1, "x")]
    assert ask("SELECT SUM(v), AVG(v), MIN(v), MAX(s), COUNT(*) FROM u") == [(None, None, None, None, 0)]
    assert ask("SELECT SUM(k) FROM u", strict=True) == [(0,)]
    assert ask("SELECT AVG(k) FROM t", strict=True) == [(2,)]
    assert ask("SELECT TOP 50 PERCENT k, s FROM t") == [(None, "x"), (1, "x"), (2, None)]
    assert ask("SELECT TOP 3 PERCENT k, s FROM t", strict=True) == [(None, "x"), (1, "x"), (2, None)]
    assert small.is_unique("t.k").first()[:] == (4, 3, False)


def test_names_and_values(small):
    for call in (lambda: small.sql("SELECT K FROM t"), lambda: small.table("x"), lambda: small.compare("t.x", "==", 1), lambda: small.compare("t.k", "==", "a")):
        with pytest.raises(NameError_):
            call()
    with pytest.raises(CatalogError):
        small.find("t", 1, 2)
    assert small.index("t.k").key and small.index("t", "s").type == "String" and small.table_meta("t").column(2).name == "v"
    record = small.record_class("t")
    assert record.from_row(small.find("t", 2).first()) == record(2, None, None)
    assert small.tables_of("k") == ["t", "u"] and small.compare("t.v", ">=", "4").count() == 2


def test_pushdown(spark):
    plan = engine.database(spark, SF).sql("SELECT o_orderkey FROM orders WHERE o_custkey == 7 AND o_totalprice > 5.0")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "GreaterThan(o_totalprice,5.0)" in plan
    assert "o_orderstatus" not in plan.split("ReadSchema")[1]


def archive(path, text, name="routes.txt"):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr(name, text)
    return str(path)


def declared(**options):
    return CatalogMeta("transit", tables=[TableMeta("routes", [ColumnMeta(**vars(c)) for c in ROUTES], **options)])


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_load(spark, tmp_path, kind):
    text = HEADER + '\n180,NJB,74,3,1.5,255,a\n204,"a ""b"", c",,3,,0,\n181,é,"line\nbreak",-7,2,7,b\n'
    db = load(spark, archive(tmp_path / "a.zip", text), declared().to_json(), f"file://{tmp_path}/db", kind)
    got = {r["route_id"]: r for r in db.table("routes").collect()}
    assert got[204]["agency_id"] == 'a "b", c' and got[204]["short"] is None and got[204]["price"] is None
    assert got[181]["short"] == "line\nbreak" and got[181]["agency_id"] == "é" and got[180]["level"] == 255
    again = Database.open(spark, f"file://{tmp_path}/db")
    meta = again.table_meta("routes")
    assert (meta.rows, meta.column("route_id").distinct, meta.column("route_id").unique, meta.column("short").distinct) == (3, 3, True, 2)
    assert [r[0] for r in again.sql("SELECT route_id FROM routes WHERE kind == 3 AND agency_id == 'NJB'").collect()] == [180]
    assert again.tables_info().count() == 7


@pytest.mark.parametrize("text", ["route_id,wrong\n1,2\n", HEADER + "\nx,a,b,3,1,1,a\n", HEADER + "\n1,a,b,3,1,256,a\n", HEADER + "\n1,a,b,3,1,1,ab\n", ""])
def test_load_refuses(spark, tmp_path, text):
    with pytest.raises(Exception):
        load(spark, archive(tmp_path / "a.zip", text), declared(), f"file://{tmp_path}/db")


def test_load_rules(spark, tmp_path):
    with pytest.raises(LoadError):
        load(spark, str(tmp_path / "none.zip"), declared(), str(tmp_path))
    with pytest.raises(LoadError):
        load(spark, archive(tmp_path / "b.zip", "", "other.txt"), declared(), str(tmp_path))
    with pytest.raises(LoadError):
        load(spark, archive(tmp_path / "c.zip", HEADER + "\n,a,b,3,1,1,a\n"), declared(), f"file://{tmp_path}/db", strict=True)
    skipped = load(spark, archive(tmp_path / "d.zip", "", "other.txt"), declared(generate=False), f"file://{tmp_path}/none")
    assert skipped.table_names() == []
    for bad in (TableMeta("t", [ColumnMeta("a", "Int32")]), TableMeta("t", [ColumnMeta("a", "Date", True)]), TableMeta("t", [ColumnMeta("a", "Int32", True), ColumnMeta("a", "Int32")])):
        with pytest.raises(CatalogError):
            CatalogMeta(tables=[bad]).check()
    assert json.loads(declared().to_json())["tables"][0]["columns"][0]["name"] == "route_id" and CATALOG_SCHEMA["type"] == "object"


def test_pages_of_an_index():
    assert page_counts(16_517, 255) == (128, 127, 128) and page_counts(30_747, 255) == (128, 127, 128)
    assert sum(page_counts(16_517, 255)) == 383 and page_counts(0, 255) == (0, 0, 0) and page_counts(255, 255) == (1, 0, 1)


def test_values():
    assert to_value("Int32", "7") == 7 and to_value("Byte", "-1") is None and to_value("Byte", "255") == 255 and to_value("Double", "x") is None
    assert to_value("Char", "ab") is None and to_value("Bool", "True") is True and str(to_value("Decimal", "1.50")) == "1.50" and to_value("String", "") is None
    assert comparison("=") == "==" and all(comparison(c) == c for c in ("==", "<>", ">", ">=", "<", "<="))
    assert len(TYPES) == 10
    with pytest.raises(ValueError):
        comparison("~")


def test_render_and_console(spark, small):
    assert next(pages(small.sql("SELECT k, s FROM t WHERE k == 2"), framed=True, numbers=True)).count("+") == 12
    assert len(list(pages(small.table("t"), page=2))) == 3 and len(list(pages(small.table("u")))) == 1 and len(list(pages(small.table("t"), paged=False))) == 1
    out = io.StringIO()
    console = Console(spark, small, out)
    for line in ("help", "search SELECT k FROM t WHERE s == 'y'", "execute select k from t", "display", "display t.k >= 2", "index t.k", "keys t.s", "rows t 2", "record t", "nonsense", "search SELECT", ""):
        assert console.run(line)
    assert not console.run("quit")
    said = out.getvalue()
    assert "SELECT k FROM t" in said and "error:" in said and "no command nonsense" in said and "\n3\n" in said


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, s string").parquet(str(tmp_path / "in"))
    query = stream_sql({"t": stream}, "SELECT k AS n FROM t WHERE s == 'a'").writeStream.format("memory").queryName("told").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r[0] for r in spark.table("told").collect()) == [1, 3]
    with pytest.raises(ParseError):
        stream_sql({"t": stream}, "SELECT TOP 1 k FROM t")


def test_titled_catalog():
    from marlstone.queries import TITLED
    from marlstone.sources.catalog import CatalogMeta

    meta = CatalogMeta.from_json(TITLED.replace('"Index": 0, "Type": "Int32"', '"Index": 9, "Type": "Int32"')).check()
    assert [t.name for t in meta.tables] == ["nation", "absent"] and (meta.name, meta.version, meta.page_size) == ("test", "1.01", 255)
    nation = meta.tables[0]
    assert [c.name for c in nation.columns] == ["n_name", "n_regionkey", "n_nationkey"] and nation.keys() == ["n_nationkey"] and nation.rows == 25
    assert not meta.tables[1].generate and CatalogMeta.from_json(meta.to_json()) == meta


def test_splittable_csv(spark, tmp_path):
    from marlstone.sources.catalog import ColumnMeta, TableMeta
    from marlstone.sources.loader import read_csv

    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(5000)))
    columns = [ColumnMeta("a", "Int32", True, True), ColumnMeta("b", "String")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        whole, parts = (read_csv(spark, str(path), TableMeta("t", columns, multiline=m)) for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < parts.rdd.getNumPartitions()
        assert sorted(whole.collect()) == sorted(parts.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
