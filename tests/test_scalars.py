import pytest
from pyspark.sql import functions as F

from freshet.functions import text, times
from freshet.operators.expectations import split_statements


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_interval_minutes(spark):
    factors = {"m": 1, "h": 60, "d": 24 * 60, "w": 7 * 24 * 60}
    cases = {f"{n}{u}": n * f for n in (0, 7, 45) for unit, f in factors.items() for u in (unit, unit.upper())}
    got = column(spark, [*cases, " 9 m", None], "string", times.interval_minutes)
    assert got == [*cases.values(), 9, None]


@pytest.mark.parametrize("bad", ["5y", " ", "weekly", "d", "0,5h", "-3h", "+3h", "3 h 2"])
def test_interval_minutes_refuses(spark, bad):
    with pytest.raises(Exception, match="Invalid interval"):
        column(spark, [bad], "string", times.interval_minutes)
    assert column(spark, [bad], "string", lambda c: times.interval_minutes(c, strict=False)) == [None]


def test_duration_text(spark):
    # On either side of each unit; a day is told in hours until it is over.
    cases = {
        None: "", 0: "0s", 59: "59s", 61: "1m 1s", 540: "9m", 7200: "2h", 7201: "2h 1s", 86399: "23h 59m 59s",
        86400: "24h", 259200: "3d", 266400: "3d 2h", 259260: "3d 0h 1m", 350701: "4d 1h 25m 1s",
    }
    assert column(spark, list(cases), "bigint", times.duration_text) == list(cases.values())


def test_minutes_text(spark):
    cases = {0: "", None: "", 59: "59s", 60: "1m", 61: "1m 1s", 7262: "121m 2s"}
    assert column(spark, list(cases), "bigint", times.minutes_text) == list(cases.values())


def test_interval_and_mean_text(spark):
    assert column(spark, [None, 59, 61, 2880], "int", times.interval_text) == ["", "59m", "1h 1m", "2d"]
    got = column(spark, [None, 59.4, 60.4, 4.5, 5.5], "double", times.mean_text)
    assert got == ["", "59s", "1m", "4s", "6s"]


def test_delta_text(spark):
    df = spark.createDataFrame([(7, 7 + 59), (5_000, 5_000 + 2 * 3600 + 61)], "a bigint, b bigint")
    got = [r[0] for r in df.select(times.delta_text(F.col("a"), F.col("b"))).collect()]
    assert sorted(got) == ["2h 1m 1s", "59s"]


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_points_in_time(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        at = [951782399, None]
        assert column(spark, at, "bigint", times.long_text) == ["Monday, February 28, 23:59:59", ""]
        assert column(spark, at, "bigint", times.clock_text) == ["23:59:59", ""]
        assert column(spark, at, "bigint", times.date_text) == ["2000-02-28T23:59:59+00:00", ""]
        got = column(spark, at, "bigint", lambda c: times.iso_text(c, "America/New_York", " "))
        assert got == ["2000-02-28 18:59:59-05:00", None]
        got = column(spark, at, "bigint", lambda c: times.iso_text(c, "Asia/Kolkata"))
        assert got == ["2000-02-29T05:29:59+05:30", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_age_text(spark):
    now = 951782399
    ages = {0: "just now", 30: "seconds ago", 60: "a minute ago", 7200: "2 hours ago", -7200: "in 2 hours",
            90000: "a day ago", 864000: "10 days ago", 40 * 86400: "a month ago", 100 * 86400: "3 months ago",
            400 * 86400: "a year ago", 1000 * 86400: "2 years ago"}
    got = column(spark, [now - a for a in ages] + [None], "bigint", lambda c: times.age_text(c, now))
    assert got == [*ages.values(), ""]


# Each way of writing a name, inside a query, and names that only look like it.
WRITTEN = ["ops.load", '"ops".load', 'ops."load"', '"ops"."load"', "db.ops.load"]
OTHERS = ["ops.loads", "xops.load", "ops_load", "ops.loa", "OPS.Load", '"ops2"."load"', "-- ops.load", "\u00fcops.load"]
USES = [(f"select n\nfrom {name} where n > 1", True) for name in WRITTEN]
USES += [(f"select n\nfrom {name}\nwhere n > 1", False) for name in OTHERS]
USES += [(f"select n -- {b}\nfrom {a} -- {b}", True) for a in WRITTEN[:2] for b in OTHERS[:2]]
USES += [(f"select n\nfrom {b}\n--from {a}", False) for a in WRITTEN[:2] for b in OTHERS[:2]]


def test_mentions(spark):
    queries = [q for q, _ in USES]
    got = column(spark, queries, "string", lambda c: text.mentions(F.lit("ops.load"), c))
    assert got == [used for _, used in USES]
    listed = column(spark, queries, "string", text.mentioned_names)
    assert ["ops.load" in names for names in listed] == [used for _, used in USES]


def test_overlapping_pairs(spark):
    assert column(spark, ["select a.b.c"], "string", text.mentioned_names) == [["a.b", "b.c"]]


def test_strip_comments(spark):
    cases = {"no comment": "no comment", "x --y": "x ", "x\n--y\nz": "x\n\nz", "\nx": "x"}
    got = column(spark, list(cases), "string", text.strip_comments)
    assert [g.split() for g in got] == [w.split() for w in cases.values()]
    assert column(spark, ["u /* v\n w */ x"], "string", lambda c: text.strip_comments(c, True)) == ["u   x"]


def test_trim_and_blank(spark):
    assert column(spark, ["select 1;\n;", "x"], "string", text.trim_statement) == ["select 1", "x"]
    assert column(spark, ["text", "", None], "string", text.blank_if_null) == ["text", "", ""]


def test_retarget():
    sql = 'select ops.load_all from ops.load join "ops"."load" where xops.load > 2'
    assert text.retarget(sql, "ops.load", "ops.new") == (
        "select ops.load_all from ops.new join ops.new where xops.load > 2"
    )


PLACES = {"ops/load": "ops.load", "ops.load": "ops.load", "ops/ops.load": "ops.load", "x/ops.load": "ops.load"}
GAPS = [" ", "-", " - ", "- ", " \u2014 ", " \u2013 "]
NAMES = {f"{place}.sql": (name, None) for place, name in PLACES.items()} | {
    f"{place}{gap}{interval}.sql": (name, interval)
    for place, name in PLACES.items()
    for gap in GAPS
    for interval in ("15m", "2w")
}


def test_file_names(spark):
    assert column(spark, list(NAMES), "string", text.file_table_name) == [n for n, _ in NAMES.values()]
    assert column(spark, list(NAMES), "string", text.file_interval) == [i for _, i in NAMES.values()]


def test_file_name_without_schema(spark):
    with pytest.raises(Exception, match="no schema"):
        column(spark, ["load.sql"], "string", text.file_table_name)


def test_statements_end_outside_quotes():
    text = """select 'a;b' = x from t; -- one; two
select "c;d" /* e; f */ from t;
;select `g;h` from 'it''s; fine'"""
    assert [x.split()[-1] for x in split_statements(text)] == ["t", "t", "fine'"]
