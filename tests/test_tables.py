import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import checks, expectations, lineage, publish, snapshots
from freshet.operators.layout import Layout, read_table, table_bytes
from freshet.plans.rebuild import View, rebuild, rebuild_set
from freshet.sources.delimited import read_delimited, write_delimited
from freshet.session import shared_dir

NOW = 1_700_000_000


def ticking(start=NOW):
    now = start - 1

    def clock():
        nonlocal now
        now += 1
        return now

    return clock


@pytest.fixture
def cities(spark, schema):
    spark.createDataFrame(
        [("Paris", "France"), ("Ottawa", "Canada"), ("Lyon", "France")], "city string, country string"
    ).write.saveAsTable(f"{schema}.cities_raw")
    return schema


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def view_of(schema, **more):
    return View(f"{schema}.cities", f"select city, country from {schema}.cities_raw;\n", **more)


TESTS = """
select count(*) = 1 as one_capital from {0}.cities where city = 'Paris';
select max(country) = 'France' as known_country from {0}.cities;
"""


def test_rebuild(spark, cities):
    run = rebuild(spark, view_of(cities, tests=TESTS.format(cities)), ticking())
    assert rows(spark.table(f"{cities}.cities")) == rows(spark.table(f"{cities}.cities_raw"))
    logged = {k: v - NOW for k, v in run.items() if k != "table_name" and v is not None}
    assert logged == {
        "start": 0, "connect": 1, "create_temp": 2, "tests": 3, "replace_old": 4, "drop_old": 5, "finish": 5,
    }
    left = {t.name for t in spark.catalog.listTables(cities) if not t.isTemporary}
    assert left == {"cities", "cities_raw"}


def test_failed_test_keeps_the_live_table(spark, cities):
    view = view_of(cities)
    rebuild(spark, view, ticking())
    stale = view._replace(
        query=f"select 'x' as city, 'y' as country from {cities}.cities_raw limit 1",
        tests=TESTS.format(cities),
    )
    with pytest.raises(expectations.DataTestsFailed) as error:
        rebuild(spark, stale, ticking())
    assert error.value.failed == ["one_capital", "known_country"]
    assert spark.table(view.name).count() == 3
    assert not spark.catalog.tableExists(view.name + publish.CANDIDATE)


def test_grants_are_kept_with_the_table(spark, cities):
    rebuild(spark, view_of(cities, config={"grant_select": "jane, john"}), ticking())
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {cities}.cities").collect()}
    assert properties[publish.GRANTS_PROPERTY] == "jane, john"


def test_interrupted_swap_is_undone(spark, cities):
    name = f"{cities}.cities"
    rebuild(spark, view_of(cities), ticking())
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}{publish.PREVIOUS}")
    assert publish.recover(spark, name)
    assert not publish.recover(spark, name)
    assert spark.table(name).count() == 3


def test_plain_view_gives_way(spark, cities):
    name = f"{cities}.cities"
    spark.sql(f"CREATE VIEW {name} AS SELECT 1 AS id")
    rebuild(spark, view_of(cities), ticking())
    assert spark.catalog.getTable(name).tableType == "MANAGED"
    assert not publish.drop_plain_view(spark, name)


def test_dependent_views(spark, cities):
    name = f"{cities}.cities"
    rebuild(spark, view_of(cities), ticking())
    spark.sql(f"CREATE VIEW {cities}.french AS SELECT * FROM {name} WHERE country = 'France'")
    spark.sql(f"CREATE VIEW {cities}.other AS SELECT * FROM {cities}.cities_raw")
    found = lineage.dependent_views(spark, name)
    assert [r.table_name for r in found.collect()] == [f"{cities}.french"]
    wide = view_of(cities)._replace(query=f"select city, country, 1 as n from {cities}.cities_raw")
    rebuild(spark, wide, ticking())
    assert spark.table(f"{cities}.french").count() == 2
    assert lineage.refresh_dependent_views(spark, name) == [f"{cities}.french"]
    assert spark.table(f"{cities}.french").columns == ["city", "country", "n"]


def test_columns_by_analysis(spark, cities):
    definitions = spark.createDataFrame(
        [
            ("a.b", f"select city, country as land from {cities}.cities_raw;", {"distkey": "country", "sortkey": "land"}),
            ("a.c", "select x from not_there.yet", {"distkey": "y"}),
        ],
        "table_name string, query string, config map<string,string>",
    )
    columns = checks.analysed_columns(spark, definitions)
    assert rows(columns) == [("a.b", "city"), ("a.b", "land")]
    keys = checks.declared_keys(definitions, F.col("config")).join(columns.select("table_name").distinct(), "table_name")
    unknown = checks.unknown_layout_columns(keys.select("table_name", "setting", "key"), columns)
    assert rows(unknown) == [("a.b", "country", "distkey")]
    by_text = checks.unknown_layout_keys(definitions, F.col("config"))
    # The text check finds "country" in the text, and "y" in "yet".
    assert rows(by_text) == []


def test_statement_forms(spark, cities):
    text = f"select true as t from {cities}.cities_raw; ; select false as f;\nselect null as n;\n"
    results = expectations.run_tests(spark, text)
    assert rows(results) == [("f", False), ("n", False), ("t", True)]
    assert expectations.verdict(results) == (False, ["f", "n"])
    assert expectations.verdict(expectations.run_tests(spark, " ;\n")) == (True, [])
    empty = expectations.run_tests(spark, f"select true as t from {cities}.cities_raw where 1 = 0")
    assert expectations.verdict(empty) == (False, ["t"])


def test_row_expectations_of_an_empty_table(spark):
    got = expectations.row_expectations(spark.range(0), {"positive": F.col("id") > 0})
    assert rows(got) == [("positive", True, 0)]


def test_layouts(spark, schema):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    name = f"{schema}.t"
    for layout in (
        Layout("k", "id"), Layout("k"), Layout(sortkey="k"), Layout(diststyle="even"), Layout(diststyle="all"),
    ):
        publish.replace_table(df, name, layout)
        back = read_table(spark, name, layout)
        assert back.agg(F.sum("id"), F.count("*")).first()[:] == (499500, 1000)
    assert table_bytes(spark, name) > 0
    assert Layout.from_config({"distkey": "", "sortkey": None, "diststyle": "all"}) == Layout(diststyle="all")


def test_bucketed_join_needs_no_shuffle(spark, schema):
    for name in ("a", "b"):
        publish.replace_table(spark.range(1000).selectExpr("id as k", f"id as {name}"), f"{schema}.{name}", Layout("k"))
    joined = spark.table(f"{schema}.a").hint("merge").join(spark.table(f"{schema}.b"), "k")
    assert joined.count() == 1000
    assert "Exchange" not in joined._jdf.queryExecution().toString()


def test_hot_bucket_is_whole(spark, schema):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    publish.replace_table(df, f"{schema}.t", Layout("k"))
    assert spark.table(f"{schema}.t").where("k = 1").count() == 1001


def test_snapshots(spark, cities):
    view = view_of(cities, snapshot_minutes=1440, keep_minutes=3000)
    name, day = view.name, 86400
    assert snapshots.snapshot_dates(spark, name) == (None, None)
    assert rebuild(spark, view, lambda: NOW)["make_snapshot"] == NOW
    assert rebuild(spark, view, lambda: NOW + day)["make_snapshot"] is None
    assert rebuild(spark, view, lambda: NOW + day + 1)["make_snapshot"] == NOW + day + 1
    assert snapshots.snapshot_dates(spark, name) == (NOW + day + 1, NOW)
    # A repeated snapshot of one moment replaces itself.
    snapshots.append_snapshot(spark, name, NOW)
    history = snapshots.read_history(spark, name)
    assert history.count() == 6 and history.columns == ["city", "country", "snapshot_timestamp"]
    # Exactly at the retention a snapshot stays; a second later it goes.
    assert snapshots.prune_snapshots(spark, name, NOW + 180000, 3000) == 0
    assert snapshots.prune_snapshots(spark, name, NOW + 180001, 3000) == 1
    assert snapshots.snapshot_dates(spark, name) == (NOW + day + 1,) * 2


def test_snapshot_of_changed_columns(spark, cities):
    view = view_of(cities, snapshot_minutes=1)
    rebuild(spark, view, lambda: NOW)
    wide = view._replace(query=f"select city, country, 1 as n from {cities}.cities_raw", snapshot_minutes=None)
    rebuild(spark, wide, lambda: NOW + 1)
    with pytest.raises(snapshots.SnapshotSchemaError, match="'n'"):
        snapshots.make_snapshot(spark, view.name, NOW + 600, 1)
    assert snapshots.make_snapshot(spark, view.name, NOW + 600, 1, allow_missing=True)
    history = snapshots.read_history(spark, view.name)
    assert sorted(history.columns) == ["city", "country", "n", "snapshot_timestamp"]
    assert history.count() == 6 and history.where("n is null").count() == 3


def test_empty_history_is_created(spark, cities):
    rebuild(spark, view_of(cities), ticking())
    snapshots.create_history(spark, f"{cities}.cities", NOW)
    assert snapshots.read_history(spark, f"{cities}.cities").count() == 0
    assert snapshots.snapshot_dates(spark, f"{cities}.cities") == (None, None)
    assert snapshots.make_snapshot(spark, f"{cities}.cities", NOW, 5)


def test_processor(spark, schema):
    def row_sums(batches):
        for batch in batches:
            yield pd.DataFrame({"total": batch.sum(axis=1)})

    spark.createDataFrame([(1, 2), (3, 4)], "a int, b int").write.saveAsTable(f"{schema}.pairs")
    view = View(
        f"{schema}.sums",
        f"select a, b from {schema}.pairs;",
        processor=row_sums,
        ddl=f"CREATE TABLE {schema}.sums(\n total bigint encode zstd\n) distkey(total)",
    )
    run = rebuild(spark, view, ticking())
    assert rows(spark.table(view.name)) == [(3,), (7,)]
    assert run["create_temp"] is None and run["insert"] and run["finish"] == run["drop_old"]


def test_rebuild_set_goes_on_after_a_failure(spark, cities):
    views = spark.createDataFrame(
        [
            (f"{cities}.bad", 0, "select no_such_column"),
            (f"{cities}.cities", 0, f"select * from {cities}.cities_raw"),
            (f"{cities}.count", 1, f"select count(*) as n from {cities}.cities"),
        ],
        "table_name string, level int, query string",
    )
    outcomes, runs = rebuild_set(spark, views, clock=ticking())
    assert [(r.level, r.status) for r in outcomes.orderBy("table_name").collect()] == [
        (0, "failed"), (0, "built"), (1, "built"),
    ]
    assert spark.table(f"{cities}.count").first().n == 3
    # The failed run is kept as far as it came.
    logged = {r.table_name.split(".")[1]: (r.connect is not None, r.finish is not None) for r in runs.collect()}
    assert logged == {"bad": (True, False), "cities": (True, True), "count": (True, True)}


def test_delimited_values(spark):
    nasty = [
        (1, 'a;b "quoted" \\ back\\', 1.5), (2, "line\nend\r\nmore", None), (3, "  ", 0.0), (4, "", 1e300),
        (5, None, -2.0), (6, " padded ", 3.0), (7, '"', 4.0), (8, "\\", 5.0), (9, "é—日本", 6.0), (10, '\\"', 7.0),
        (11, '";"', 8.0), (12, "#x", 9.0),
    ]
    df = spark.createDataFrame(nasty, "id int, v string, x double").repartition(3)
    path = f"{shared_dir(spark)}/delimited"
    write_delimited(df, path)
    back = {r.id: (r.v, r.x) for r in read_delimited(spark, path, "id int, v string, x double").collect()}
    assert back == {i: (v if v and v.strip() else None, x) for i, v, x in nasty}


def test_delimited_empty(spark):
    path = f"{shared_dir(spark)}/delimited-empty"
    write_delimited(spark.createDataFrame([], "id int, v string"), path)
    assert read_delimited(spark, path, "id int, v string").count() == 0


def test_observed_tests_split_by_what_spark_takes(spark, schema):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, word string")
    text = f"""
        select min(n) > 0 as positive from {schema}.t; select count(word) = 3 as all_words from {schema}.t;
        select count(distinct n) = 3 as different from {schema}.t; select n > 0 as first_row from {schema}.t;
        select max(n) < 9 as small from {schema}.t where n > 1; select max(n) > 0 as elsewhere from {schema}.other;
        select max(n) > 0 as twice from {schema}.t; select max(n) < 0 as twice from {schema}.t;
        select max(gone) > 0 as no_column from {schema}.t; select bool_and(word <> ';') as quoted from {schema}.t
    """
    tests = expectations.observable(rows, text, f"{schema}.t")
    assert set(tests.metrics) == {"positive", "all_words", "quoted"}
    assert len(expectations.split_statements(tests.rest)) == 7


@pytest.mark.parametrize("config", [None, {"distkey": "n"}, {"sortkey": "n"}, {"diststyle": "even"}])
@pytest.mark.parametrize("keep", [None, 1])
def test_rebuild_reads_verdicts_from_the_write(spark, schema, config, keep):
    name = f"{schema}.numbers"
    query = "select id as n from range(1000)"
    hold = f"select count(*) = 1000 as whole from {name}; select sum(n) = 499500 as summed from {name}"
    rebuild(spark, View(name, query, config, hold, keep_versions=keep), lambda: 1)
    broken = f"{hold}; select max(n) < 10 as small from {name}; select count(distinct n) = 1 as one from {name}"
    with pytest.raises(expectations.DataTestsFailed) as failed:
        rebuild(spark, View(name, query, config, broken, keep_versions=keep), lambda: 1)
    assert sorted(failed.value.failed) == ["one", "small"]
    assert spark.table(name).count() == 1000


def test_tests_of_an_empty_table(spark, schema):
    name = f"{schema}.nothing"
    tests = f"select count(*) = 0 as none from {name}; select min(n) > 0 as unknown from {name}"
    with pytest.raises(expectations.DataTestsFailed) as failed:
        rebuild(spark, View(name, "select id as n from range(10) where 1 = 0", None, tests), lambda: 1)
    assert failed.value.failed == ["unknown"]
