"""Run registered queries and their SQL, and compare; usable by hand:

python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.10g}")
    return value


def in_order(columns, rows):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in by_name) for row in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def spark_rows(df):
    return in_order(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    return in_order([d[0] for d in cursor.description], cursor.fetchall())


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from freshet.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(sf_dir), entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            got = spark_rows(query(spark, sf_dir))
            took = time.time() - started
            if name not in sql:
                print(f"--   {name:26} {took:6.2f}s {len(got[1])} rows, no SQL", flush=True)
                continue
            started = time.time()
            want = sql_rows(connection, sql[name])
            sql_took = time.time() - started
        except Exception as error:
            bad.append(name)
            print(f"ERR  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            continue
        same = got == want
        print(f"{'ok  ' if same else 'DIFF'} {name:26} {took:6.2f}s sql {sql_took:6.2f}s {len(got[1])} rows", flush=True)
        if not same:
            bad.append(name)
            print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            only = [r for r in zip(got[1], want[1]) if r[0] != r[1]][:3]
            for pair in only:
                print("   spark", str(pair[0])[:600], "\n   sql  ", str(pair[1])[:600])
    print("bad:", bad)
