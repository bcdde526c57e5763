import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import catalog as catalogs
from freshet.operators import runlog, settings
from freshet.plans import refresh
from freshet.sources.definitions import find_definition

NOW = 1_700_000_000


def catalog_of(spark, rows):
    """Rows as dicts; columns not given are NULL."""
    names = [f.split()[0] for f in catalogs.CATALOG_SCHEMA.split(", ")]
    return spark.createDataFrame(
        [tuple(row.get(n) for n in names) for row in rows], catalogs.CATALOG_SCHEMA
    )


def by_name(df):
    return {r.table_name: r for r in df.collect()}


# Five tables of a shop; margins is built whenever weekly is.
SHOP = {
    "report.margins": ("select day, price from shop.sales", None),
    "report.shortage": ("select * from shop.stock where pieces < 5", 120),
    "report.weekly": ("select max(price) as best from report.margins", 10080),
    "shop.sales": ("select day, price from shop.receipts", 45),
    "shop.stock": ("select item, pieces from shop.movements", 4320),
}


def shop(spark, **changes):
    rows = [
        {"table_name": n, "query": q, "interval": m, "mean": 0.0, "times_run": 0, **changes.get(n, {})}
        for n, (q, m) in SHOP.items()
    ]
    return catalog_of(spark, rows)


def test_running_mean_by_batches(spark):
    catalog = shop(spark)
    durations = [12, 30, 3, 55]
    for n, duration in enumerate(durations, 1):
        built = spark.createDataFrame(
            [("shop.stock", 100 * n, duration)], "table_name string, start bigint, duration bigint"
        )
        catalog = catalogs.record_builds(
            catalogs.set_flag(catalog, "started", 5, built.select("table_name")), built
        )
        row = by_name(catalog)["shop.stock"]
        assert (row.mean, row.times_run, row.last_created) == (sum(durations[:n]) / n, n, 100 * n)
        assert (row.started, row.force, row.waiting) == (None, None, None)
    assert by_name(catalog)["shop.sales"].times_run == 0


def test_running_mean_without_earlier_mean(spark):
    catalog = catalog_of(spark, [{"table_name": "a.b", "force": 1, "waiting": 3, "started": 2}])
    built = spark.createDataFrame([("a.b", 7, 40)], "table_name string, start bigint, duration bigint")
    row = by_name(catalogs.record_builds(catalog, built))["a.b"]
    assert (row.mean, row.times_run, row.force, row.waiting, row.started) == (40.0, 1, None, None, None)


def test_flags(spark):
    names = spark.createDataFrame([("shop.stock",), ("shop.unknown",)], "table_name string")
    catalog = catalogs.mark_waiting(shop(spark), names, NOW)
    assert {n: r.waiting for n, r in by_name(catalog).items() if r.waiting} == {"shop.stock": NOW}
    catalog = catalogs.clear_waiting(catalog, names)
    assert by_name(catalog)["shop.stock"].waiting == 0
    catalog = catalogs.set_flag(catalogs.set_flag(catalog, "started", 9, names), "started", None)
    assert {r.started for r in catalog.collect()} == {None}


def test_queue(spark):
    def queue(**changes):
        ages = {n: {"last_created": NOW} for n in SHOP}
        made = shop(spark, **{n: {**ages[n], **changes.get(n, {})} for n in SHOP})
        return [r.table_name for r in refresh.refresh_queue(made, NOW).collect()]

    def aged(seconds):
        return {"last_created": NOW - seconds}

    assert queue() == []
    assert queue(**{n: {"last_created": None} for n in SHOP}) == sorted(SHOP)
    assert queue(**{"report.shortage": {"last_created": None}}) == ["report.shortage"]
    # Age does not count without an interval, and counts in whole minutes with one.
    assert queue(**{"report.margins": aged(10**7)}) == []
    for name, (_, minutes) in SHOP.items():
        if minutes:
            assert queue(**{name: aged(60 * minutes + 59)}) == []
            assert queue(**{name: aged(60 * minutes + 60)}) == [name]
    due = {"report.shortage": aged(10**7), "shop.sales": aged(10**7)}
    assert queue(**due, **{"shop.stock": {"force": 1}}) == ["shop.stock", "report.shortage", "shop.sales"]
    assert queue(**due, **{"shop.stock": {"force": 1, "deleted": NOW - 1}}) == ["report.shortage", "shop.sales"]


@pytest.mark.parametrize(
    "row, expected",
    [
        ({}, (True, "never built")),
        ({"waiting": NOW - 10}, (False, "waiting")),
        ({"waiting": 0}, (True, "never built")),
        ({"waiting": NOW - 10800, "last_created": NOW - 10}, (False, "fresh")),
        ({"started": NOW - 180}, (True, "never built")),
        ({"started": NOW - 180, "mean": 100.0}, (False, "running")),
        ({"started": NOW - 501, "mean": 100.0, "last_created": NOW}, (False, "fresh")),
        ({"force": 1, "last_created": NOW}, (True, "forced")),
        ({"last_created": NOW, "interval": None}, (True, "no interval")),
        ({"last_created": NOW - 1200}, (False, "fresh")),
        ({"last_created": NOW - 1201}, (True, "stale")),
    ],
)
def test_decision(spark, row, expected):
    catalog = catalog_of(spark, [{"table_name": "a.b", "interval": 20, **row}])
    got = refresh.refresh_decision(catalog, NOW).first()
    assert (got.build, got.reason) == expected


def test_waiting_and_overdue(spark):
    catalog = catalog_of(
        spark,
        [
            {"table_name": "a.none"},
            {"table_name": "a.short", "waiting": NOW - 7200, "started": NOW - 50, "mean": 10.0},
            {"table_name": "a.long", "waiting": NOW - 7201, "started": NOW - 51, "mean": 10.0},
        ],
    )
    status = by_name(refresh.waiting_status(catalog, NOW))
    assert [(status[n].waiting, status[n].too_long) for n in ("a.none", "a.short", "a.long")] == [
        (False, False), (True, False), (True, True),
    ]
    overdue = refresh.overdue_runs(catalog, NOW).collect()
    assert [(r.table_name, r.running_seconds, r.bound_seconds) for r in overdue] == [("a.long", 51, 50.0)]


def plan(spark, rows, pairs):
    catalog = catalog_of(spark, [{"table_name": n, **r} for n, r in rows.items()])
    edges = spark.createDataFrame(pairs, "src string, dst string")
    return {r.table_name: (r.level, r.interval) for r in refresh.refresh_plan(catalog, edges, NOW).collect()}


def test_plan_inherits_the_interval(spark):
    """people (1h) reads shops (no interval), shops reads cities (24h)."""
    pairs = [("x.people", "x.shops"), ("x.shops", "x.cities")]
    rows = {
        "x.people": {"interval": 60, "last_created": NOW - 7200},
        "x.shops": {"last_created": NOW - 5400},
        "x.cities": {"interval": 1440, "last_created": NOW - 3600},
    }
    assert plan(spark, rows, pairs) == {"x.people": (1, 60), "x.shops": (0, 60)}
    rows["x.shops"] = {"last_created": NOW - 600}
    assert plan(spark, rows, pairs) == {"x.people": (0, 60)}
    rows["x.shops"], rows["x.cities"] = {"last_created": NOW - 5400}, {"interval": 1440}
    assert plan(spark, rows, pairs) == {"x.people": (2, 60), "x.shops": (1, 60), "x.cities": (0, 1440)}


def test_plan_takes_the_shortest_interval_of_those_that_ask(spark):
    pairs = [("x.slow", "x.base"), ("x.quick", "x.base"), ("x.base", "x.deep")]
    rows = {
        "x.slow": {"interval": 1440, "last_created": NOW - 90000},
        "x.quick": {"interval": 10, "last_created": NOW - 1200},
        "x.base": {"last_created": NOW - 1800},
        "x.deep": {"last_created": NOW - 1800},
    }
    got = plan(spark, rows, pairs)
    assert got["x.base"] == (1, 10) and got["x.deep"] == (0, 10)


def test_plan_ends_on_a_cycle(spark):
    pairs = [("x.a", "x.b"), ("x.b", "x.a"), ("x.c", "x.b")]
    rows = {"x.a": {"interval": 5}, "x.b": {}, "x.c": {"interval": 1}}
    got = plan(spark, rows, pairs)
    assert set(got) == {"x.a", "x.b", "x.c"} and got["x.c"][0] > got["x.b"][0]


def test_diff_of_equal_sets_is_unchanged(spark):
    catalog = shop(spark)
    statuses = catalogs.definition_diff(catalog, catalog.select("table_name", "query", "interval", "config"))
    assert {r.table_name: r.status for r in statuses.collect()} == dict.fromkeys(SHOP, "unchanged")


def test_diff_and_apply(spark):
    catalog = shop(
        spark,
        **{
            "report.shortage": {"deleted": 41},
            "report.weekly": {"deleted": 17},
            "shop.stock": {"started": 8, "waiting": 9, "force": 1},
        },
    )
    kept = [(n, *SHOP[n], None) for n in ("report.margins", "report.weekly")]
    new = spark.createDataFrame(
        [*kept, ("shop.sales", "select day from shop.receipts", 45, None), ("shop.returns", "select 1", 30, None)],
        "table_name string, query string, interval int, config string",
    )
    diff = {r.table_name: r.status for r in catalogs.definition_diff(catalog, new).collect()}
    assert diff == {
        "report.margins": "unchanged", "report.shortage": "gone", "report.weekly": "revived",
        "shop.returns": "new", "shop.sales": "updated", "shop.stock": "deleted",
    }
    after = by_name(catalogs.apply_definitions(catalog, new, NOW))
    stock = after["shop.stock"]
    assert (stock.deleted, stock.started, stock.waiting, stock.force) == (NOW, None, None, None)
    assert after["report.shortage"].deleted == 41 and after["report.margins"].force is None
    assert (after["shop.sales"].force, after["shop.sales"].query) == (1, "select day from shop.receipts")
    assert (after["report.weekly"].force, after["report.weekly"].deleted) == (1, None)
    returns = after["shop.returns"]
    assert (returns.mean, returns.times_run, returns.force, returns.last_created) == (0.0, 0, 1, None)
    notice = catalogs.change_notice(catalogs.definition_diff(catalog, new))
    assert sorted(r.notice for r in notice.collect()) == ["New tables: shop.returns.", "Updated tables: shop.sales."]


@pytest.mark.parametrize("size", [0, 1, 1000, 1001, 2500])
def test_name_lines_are_the_sorted_list(spark, size):
    rows = spark.range(size).select(F.lit("new").alias("status"), F.concat(F.lit("s.t"), "id").alias("table_name"))
    lines = sorted(catalogs.diff_summary(rows).collect(), key=lambda r: r.line)
    assert [r.n for r in lines] == [1000] * (size // 1000) + [size % 1000] * (size % 1000 > 0)
    names = [n for line in lines for n in line["names"].split(", ")]
    assert names == sorted(f"s.t{i}" for i in range(size))


def test_listing_keeps_recent_deletions(spark):
    week = 7 * 86400
    catalog = shop(
        spark,
        **{
            "report.margins": {"last_created": 60},
            "report.weekly": {"deleted": NOW - week + 1, "last_created": 50},
            "shop.sales": {"deleted": 0, "last_created": 70},
            "shop.stock": {"deleted": NOW - week, "last_created": 80},
        },
    )
    got = [r.table_name for r in catalogs.catalog_listing(catalog, NOW).collect()]
    assert got == ["shop.sales", "report.margins", "report.weekly", "report.shortage"]


def test_lookup(spark):
    assert find_definition(shop(spark), "shop.stock").interval == 4320
    with pytest.raises(LookupError):
        find_definition(shop(spark), "shop.unknown")


GRANTS = ["ana", "bo, cy", "di, ana ", "+di", "-bo", "+bo, -cy", "ana, +cy", "+di, -di", "-ana,-bo", "null", "", None]


def folded(layers):
    """The rule for grants, layer by layer, on a set of names."""
    held = set()
    for _, value in sorted(layers):
        names = [x.strip() for x in (value or "").split(",") if x.strip()]
        if names == ["null"]:
            held = set()
        elif any(x[0] in "+-" for x in names):
            held |= {x[1:] for x in names if x[0] == "+"}
            held -= {x[1:] for x in names if x[0] == "-"}
        elif names:
            held = set(names)
    return ", ".join(sorted(held))


def test_grants(spark):
    """Every pair of values, and random values in all four layers, in any order."""
    pick = random.Random(7)
    cases = [[(0, x), (3, y)] for x in GRANTS for y in GRANTS]
    cases += [list(enumerate(pick.choices(GRANTS, k=4))) for _ in range(150)]
    rows = [(f"t.t{i}", level, value) for i, layers in enumerate(cases) for level, value in layers]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "table_name string, level int, value string")
    made = settings.effective_grants(df).select("table_name", settings.grant_text(F.col("grantees")).alias("names"))
    got = {r.table_name: r["names"] for r in made.collect()}
    for i, layers in enumerate(cases):
        assert (got.get(f"t.t{i}") or "") == folded(layers), layers


def test_settings_layers(spark):
    df = spark.createDataFrame(
        [("a.b", 0, "diststyle", "all"), ("a.b", 3, "diststyle", "null"), ("a.b", 1, "sortkey", "x"), ("a.c", 0, "sortkey", "")],
        "table_name string, level int, key string, value string",
    )
    got = {(r.table_name, r.key): r.value for r in settings.effective_settings(df).collect()}
    assert got == {("a.b", "diststyle"): None, ("a.b", "sortkey"): "x", ("a.c", "sortkey"): None}


# A Friday, 05:20:00 UTC.
T0 = 1_650_000_000


def run_of(name, start, **seconds):
    """A row of the log: each step so many seconds after the one before; without steps it still runs."""
    at, row = start, {"table_name": name, "start": start}
    for step, more in seconds.items():
        at += more
        row[step] = row["finish"] = at
    return tuple(row.get(c) for c in ("table_name", *runlog.STEP_COLUMNS))


LOG = [
    run_of("shop.sales", T0, select=30, insert=10),
    run_of("shop.stock", T0 + 100, connect=5, process=3600),
    run_of("shop.sales", T0 + 3600, create_temp=15, insert=5),
    run_of("shop.sales", T0 + 7200),
]


@pytest.fixture
def runs(spark):
    return spark.createDataFrame(LOG, runlog.RUN_SCHEMA)


def test_overview(spark, runs):
    """40, 3605 and 20 seconds of work, the last two finished within the hour."""
    assert tuple(runlog.overview_stats(runs, T0 + 7200, 3).first()) == (2, 3, round(100 * 3665 / 10800, 2))
    assert tuple(runlog.overview_stats(runs, T0 + 7200, 1).first()) == (2, 2, round(100 * 3625 / 3600, 2))
    assert tuple(runlog.overview_stats(runs, NOW, 1).first()) == (0, 0, None)


def test_details_and_jobs(spark, runs):
    details = runlog.table_details(shop(spark), runs, "shop.sales").collect()
    assert [(r.start - T0, r.interval) for r in details] == [(3600, 45), (0, 45), (7200, 45)]
    assert runlog.table_details(shop(spark), runs, "shop.sales", 2).count() == 2
    assert [r.start for r in runlog.table_details(shop(spark), runs, "report.weekly").collect()] == [None]
    assert runlog.table_details(shop(spark), runs, "shop.unknown").count() == 0
    assert runlog.jobs(runs, shop(spark), 0, NOW).count() == len(LOG)
    assert runlog.jobs(runs, shop(spark), 0, T0 - 1).count() == 0
    running = shop(spark, **{"report.margins": {"started": 6}, "shop.stock": {"started": 7, "deleted": 8}})
    assert [r.table_name for r in runlog.jobs(runs, running, 0, 1).collect()] == ["report.margins"]
    texts = {tuple(r) for r in runlog.job_texts(runlog.jobs(runs, shop(spark), 0, NOW)).collect()}
    assert ("shop.sales", "2022-04-15T05:20:00+00:00", "2022-04-15T05:20:40+00:00") in texts


def test_step_lines(spark):
    run = run_of("report.weekly", T0, connect=3, select=59, process=61, insert=1, replace_old=20)
    df = spark.createDataFrame([run], runlog.RUN_SCHEMA)
    lines = runlog.step_texts(runlog.step_durations(df, ["table_name"])).orderBy("step_no")
    assert [r.line for r in lines.collect()] == [
        "Friday, April 15, 05:20:00",
        "05:20:03: connect (3s)",
        "05:21:02: select (59s)",
        "05:22:03: process (1m 1s)",
        "05:22:04: insert (1s)",
        "05:22:24: replace old (20s)",
    ]
    series = runlog.duration_series(df, ["table_name"]).first()
    assert (series.date, series.duration) == ("2022-04-15 05:20:00+00:00", 144)
    empty = df.withColumn("start", F.lit(None).cast("bigint"))
    assert runlog.duration_series(empty, ["table_name"]).count() == 0


def test_running_means_over_slices(spark, runs):
    more = spark.createDataFrame([run_of("shop.sales", T0 + 9000, select=90)], runlog.RUN_SCHEMA)
    log = runs.unionByName(more)
    for slice_seconds in (60, 5000, 86400):
        means = runlog.running_means(log, slice_seconds).where("table_name = 'shop.sales'").orderBy("start")
        assert [(r.mean, r.times_run) for r in means.collect()] == [(40, 1), (30, 2), (50, 3)]
    stats = {r.table_name: (r.mean, r.times_run, r.last_created) for r in runlog.table_stats(log).collect()}
    assert stats == {"shop.sales": (50, 3, T0 + 9000), "shop.stock": (3605, 1, T0 + 100)}


def test_latest_runs(spark, runs):
    got = runlog.latest_runs(shop(spark), runs, 1).collect()
    starts = {"shop.sales": T0 + 3600, "shop.stock": T0 + 100}
    assert {(r.table_name, r.start, r.rank) for r in got} == {(n, starts.get(n), 1 if n in starts else None) for n in SHOP}


def test_log_append(spark, schema, runs):
    runlog.append_runs(runs, f"{schema}.log")
    runlog.append_runs(runs.limit(1), f"{schema}.log")
    assert spark.table(f"{schema}.log").count() == len(LOG) + 1
    assert runlog.finish_time({"select": 1, "insert": 2, "drop_old": 3}) == 3
    assert runlog.finish_time({"insert": 2, "drop_old": None}) == 2
    assert runlog.finish_time({"connect": 1}) is None
