import pytest
from pyspark.sql.types import StructType

from freshet.operators import checks, publish
from freshet.plans.rebuild import rebuild_set, views_to_build
from freshet.plans.refresh import refresh_plan
from freshet.plans.replan import PlanError, empty_catalog, replan
from freshet.sources import definitions as folder

NOW = 1_700_000_000

FILES = {
    "global.conf": "snapshots_stored_for = 30d\n\n# a month\n",
    "report.conf": "grant_select=ana, bo\ndiststyle=all",
    "report.shortage 2h.sql": "select * from shop.stock where pieces < 5",
    "report/margins.sql": "  select day, price from shop.sales\t",
    "report/weekly.conf": "diststyle=null\ngrant_select=+cy, -bo\n",
    "report/weekly — 7d.sql": "select max(price) as best from report.margins",
    "report/weekly_test.sql": "select best > 0 as sold from report.weekly",
    "requirements.txt": "numpy\n",
    "shop.sales.conf": "sortkey=day",
    "shop.sales_test.sql": "select count(*) > 0 as any_row from shop.sales\n",
    "shop/sales - 45m.sql": "select day, sum(price) as price\n    from shop.receipts\ngroup by day\n",
    "shop/stock — 3d.sql": "create table shop.stock (\nItem varchar(40) encode lzo,\npieces bigint\n)",
    "shop/stock.py": "import numpy\n",
    "shop/stock_requirements.txt": "numpy>1\n",
    "shop/stock_select.sql": "\tselect item, delta from shop.movements;",
    "shop/stock_test.sql": "select min(pieces) >= 0 as never_below_zero from shop.stock",
    "todo.md": "no definition",
}


def write(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return str(root)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write(tmp_path_factory.mktemp("my views+more"), FILES)


@pytest.fixture(scope="module")
def classified(spark, root):
    return folder.classify(folder.scan_folder(spark, root)).cache()


def test_scan(spark, root):
    found = {r.path: r.text for r in folder.scan_folder(spark, root).collect()}
    assert set(found) == set(FILES) - {"todo.md"}
    assert found["shop/sales - 45m.sql"] == "select day, sum(price) as price\nfrom shop.receipts\ngroup by day"
    assert found["report/margins.sql"] == "select day, price from shop.sales"


def test_kinds(classified):
    kinds = {r.path: (r.kind, r.table_name, r.interval) for r in classified.collect()}
    assert kinds["report.shortage 2h.sql"] == ("query", "report.shortage", "2h")
    assert kinds["report/weekly — 7d.sql"] == ("query", "report.weekly", "7d")
    assert kinds["report/margins.sql"] == ("query", "report.margins", None)
    assert kinds["shop/sales - 45m.sql"] == ("query", "shop.sales", "45m")
    assert kinds["shop/stock — 3d.sql"] == ("ddl", "shop.stock", "3d")
    for ending, kind in (("_select.sql", "select"), (".py", "processor"), ("_requirements.txt", "requirements"), ("_test.sql", "test")):
        assert kinds[f"shop/stock{ending}"] == (kind, "shop.stock", None)
    assert kinds["shop.sales_test.sql"] == ("test", "shop.sales", None)
    assert kinds["report.conf"] == ("settings", None, None)
    assert kinds["requirements.txt"] == ("requirements", None, None)


def test_definitions(classified):
    got = {r.table_name: (r.query, r.interval) for r in folder.load_definitions(classified).collect()}
    assert got == {
        "report.margins": ("select day, price from shop.sales", None),
        "report.shortage": ("select * from shop.stock where pieces < 5", 120),
        "report.weekly": ("select max(price) as best from report.margins", 7 * 1440),
        "shop.sales": ("select day, sum(price) as price\nfrom shop.receipts\ngroup by day", 45),
        "shop.stock": ("select item, delta from shop.movements;", 3 * 1440),
    }
    tests = {r.table_name for r in folder.load_tests(classified).collect()}
    assert tests == {"report.weekly", "shop.sales", "shop.stock"}


def test_select_ending_without_processor(spark):
    files = spark.createDataFrame([("a/b_select.sql", "select 1")], "path string, text string")
    row = folder.classify(files).first()
    assert (row.kind, row.table_name) == ("query", "a.b_select")


def test_file_inside_the_schema_folder_wins(spark):
    files = spark.createDataFrame(
        [("a.b_test.sql", "beside"), ("a/b_test.sql", "inside"), ("z/a.b_test.sql", "elsewhere")],
        "path string, text string",
    )
    assert [r.text for r in folder.load_tests(folder.classify(files)).collect()] == ["inside"]


def test_declared_schema(classified):
    ddl = folder.load_ddl(classified).first().text
    assert folder.declared_schema(ddl) == StructType.fromDDL("item string, pieces bigint")
    nested = 'create table a.b(x decimal(10,2), y varchar(max)) diststyle all sortkey("x");'
    assert folder.declared_schema(nested) == StructType.fromDDL("x decimal(10,2), y string")
    with pytest.raises(ValueError):
        folder.declared_schema("select 1")


def test_missing_files(spark):
    files = [
        ("a/x_test.sql", "select 1"), ("a/y.py", "pass"), ("a/y_test.sql", "select 1"),
        ("a/z.py", "pass"), ("a/z.sql", "create table a.z(i int)"), ("a/z_select.sql", ""), ("a/ok.sql", "select 1"),
    ]
    known = folder.classify(spark.createDataFrame(files, "path string, text string"))
    got = sorted(tuple(r) for r in checks.missing_files(known).collect())
    assert got == [
        ("processor without ddl", "a.y"),
        ("processor without select", "a.y"),
        ("processor without select", "a.z"),
        ("test without query", "a.x"),
        ("test without query", "a.y"),
    ]
    report = {r.check_name: r["names"] for r in checks.missing_files_report(known).collect()}
    assert report["test without query"] == "a.x, a.y"


def test_replan(spark, root):
    plan = replan(spark, root, empty_catalog(spark), NOW, strict=True)
    rows = {r.table_name: r for r in plan.catalog.collect()}
    assert len(rows) == 5 and all(r.force == 1 and r.mean == 0 for r in rows.values())
    assert rows["shop.sales"].config == '{"snapshots_stored_for":"30d","sortkey":"day"}'
    assert rows["report.margins"].config == '{"diststyle":"all","grant_select":"ana, bo","snapshots_stored_for":"30d"}'
    assert rows["report.weekly"].config == '{"diststyle":null,"grant_select":"ana, cy","snapshots_stored_for":"30d"}'
    assert sorted(tuple(r) for r in plan.edges.collect()) == [
        ("report.margins", "shop.sales"),
        ("report.shortage", "shop.stock"),
        ("report.weekly", "report.margins"),
    ]
    again = replan(spark, root, plan.catalog, NOW)
    assert {r.status for r in again.diff.collect()} == {"unchanged"}


@pytest.mark.parametrize(
    "files, strict, reason",
    [
        ({"a/b.sql": "select 1"}, False, "sources without an interval: a.b"),
        ({"a/b_test.sql": "select 1"}, False, "missing files"),
        ({"a/b 1h.sql": "select x from t", "a/b.conf": "sortkey=y"}, False, "unknown layout keys: a.b, sortkey, y"),
        ({"a/b 1h.sql": "from a.c", "a/c 1h.sql": "from a.b"}, True, "cycles"),
    ],
)
def test_replan_refuses(spark, tmp_path, files, strict, reason):
    with pytest.raises(PlanError, match=reason):
        replan(spark, write(tmp_path, files), empty_catalog(spark), NOW, strict)


def test_folder_to_tables(spark, tmp_path, schema):
    """From files to published tables: plan, rebuild in order, record, nothing due afterwards."""
    raw = f"{schema}.receipts"
    spark.sql(f"CREATE TABLE {raw} USING parquet AS SELECT id % 3 AS day, id AS price FROM range(1, 8)")
    root = write(
        tmp_path,
        {
            f"{schema}/sales.sql": f"select day, sum(price) as price from {raw} group by day",
            f"{schema}/sales_test.sql": f"select min(price) > 0 as sold from {schema}.sales",
            f"{schema}/best — 1h.sql": f"select max(price) as best from {schema}.sales;",
            f"{schema}/best.conf": "snapshots_interval=1h\nsnapshots_stored_for=2d",
        },
    )
    plan = replan(spark, root, empty_catalog(spark), NOW)
    publish.replace_table(plan.catalog, f"{schema}.catalog")
    catalog = spark.table(f"{schema}.catalog")

    due = refresh_plan(catalog, plan.edges, NOW)
    assert {r.table_name: r.level for r in due.collect()} == {f"{schema}.sales": 0, f"{schema}.best": 1}
    views = views_to_build(due, catalog, folder.classify(folder.scan_folder(spark, root)))
    outcomes, runs = rebuild_set(
        spark, views, clock=lambda: NOW, catalog=f"{schema}.catalog", log=f"{schema}.runs"
    )
    assert {r.status for r in outcomes.collect()} == {"built"}
    assert spark.table(f"{schema}.best").first().best == 12
    assert spark.table(f"{schema}.best_history").count() == 1

    assert sorted(map(tuple, spark.table(f"{schema}.runs").collect())) == sorted(map(tuple, runs.collect()))
    recorded = spark.table(f"{schema}.catalog").collect()
    assert [(r.times_run, r.last_created, r.force) for r in recorded] == [(1, NOW, None)] * 2
    assert refresh_plan(spark.table(f"{schema}.catalog"), plan.edges, NOW + 60).count() == 0
