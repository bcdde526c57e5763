"""Publishing by a pointer, and views over what is published."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import lineage, versions
from freshet.operators.layout import Layout
from freshet.plans.rebuild import View, rebuild


def numbers(spark, n, **columns):
    return spark.range(n).select("id", *[F.lit(v).alias(c) for c, v in columns.items()])


@pytest.mark.parametrize("stop", range(4))
def test_a_live_table_at_every_step(spark, schema, stop):
    """However many steps of the second publish are taken, readers find the first or the second table."""
    name = f"{schema}.t"
    versions.replace_table(numbers(spark, 5), name)
    begun = spark.table(name)
    steps = versions.publish_steps(numbers(spark, 7), name)
    taken = [next(steps) for _ in range(min(stop, 3))]
    steps.close()
    assert spark.table(name).count() == (7 if "pointed" in taken else 5)
    assert begun.count() == 5
    # The next publish goes through and leaves nothing of the one that stopped.
    versions.replace_table(numbers(spark, 9), name)
    assert spark.table(name).count() == 9
    assert len(versions.versions(spark, name)) == 2


def test_versions_kept_and_rolled_back(spark, schema):
    name = f"{schema}.t"
    for n in range(1, 6):
        versions.replace_table(numbers(spark, n), name, Layout("id"), keep=2)
    assert versions.versions(spark, name) == [3, 4, 5] and versions.live_version(spark, name) == 5
    assert versions.roll_back(spark, name) == 4 and spark.table(name).count() == 4
    assert versions.roll_back(spark, name) == 3
    assert versions.roll_back(spark, name) is None and spark.table(name).count() == 3
    versions.replace_table(numbers(spark, 8), name)
    assert spark.table(name).count() == 8


def test_a_table_may_be_read_by_its_next_version(spark, schema):
    name = f"{schema}.t"
    versions.replace_table(numbers(spark, 3), name)
    versions.replace_table(spark.table(name).unionAll(spark.table(name)), name)
    assert spark.table(name).count() == 6


def test_an_ordinary_table_is_adopted(spark, schema):
    name = f"{schema}.t"
    numbers(spark, 3).write.saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} RENAME TO {versions.version_name(name, versions.ADOPTED)}")
    assert versions.recover(spark, name) and spark.table(name).count() == 3
    assert not versions.recover(spark, name)
    versions.replace_table(numbers(spark, 4), name)
    numbers(spark, 5).write.saveAsTable(f"{schema}.u")
    versions.replace_table(numbers(spark, 6), f"{schema}.u")
    assert (spark.table(name).count(), spark.table(f"{schema}.u").count()) == (4, 6)


def test_names_that_begin_alike(spark, schema):
    versions.replace_table(numbers(spark, 3), f"{schema}.t")
    versions.replace_table(numbers(spark, 4), f"{schema}.t__v")
    assert versions.versions(spark, f"{schema}.t") == [1]


def test_bucketed_versions_join_without_a_shuffle(spark, schema):
    for name in ("a", "b"):
        versions.replace_table(numbers(spark, 1000, **{name: 1}), f"{schema}.{name}", Layout("id"))
    joined = spark.table(f"{schema}.a").hint("merge").join(spark.table(f"{schema}.b"), "id")
    assert joined.count() == 1000
    assert "Exchange" not in joined._jdf.queryExecution().toString()


@pytest.fixture
def chain(spark, schema):
    """A table, a view on it, a view on that, a view on both, and one beside them."""
    name = f"{schema}.t"
    rebuild(spark, View(name, "select id, id % 3 as k, 'x' as label from range(9)"))
    spark.sql(f"CREATE VIEW {schema}.low AS SELECT * FROM {name} WHERE t.id < 6")
    spark.sql(f"CREATE VIEW {schema}.upper_part AS SELECT id, k FROM {schema}.low")
    spark.sql(f"CREATE VIEW {schema}.both AS SELECT low.id, t.k FROM {schema}.low JOIN {name} ON low.id = t.id")
    spark.sql(f"CREATE VIEW {schema}.beside AS SELECT 1 AS id")
    return name


def test_dependents_in_order(spark, chain, schema):
    found = {r.table_name.split(".")[1]: r.level for r in lineage.dependent_views(spark, chain).collect()}
    assert found == {"low": 0, "both": 1, "upper_part": 1}


def test_refused_build_changes_nothing(spark, chain, schema):
    with pytest.raises(lineage.DependentsBroken) as error:
        rebuild(spark, View(chain, "select id, 'y' as label from range(5)"))
    assert [v.split(".")[1] for v in error.value.broken] == ["both", "upper_part"]
    assert spark.table(chain).count() == 9 and spark.table(f"{schema}.both").count() == 6
    assert not [s for s in spark.sql("SHOW SCHEMAS LIKE 'trial_*'").collect()]
    left = {t.name for t in spark.catalog.listTables(schema)}
    assert "t__candidate" not in left


def test_views_over_a_broken_view_are_told(spark, chain, schema):
    with pytest.raises(lineage.DependentsBroken) as error:
        rebuild(spark, View(chain, "select k, label from (select id, id % 3 as k, 'x' as label from range(9))"))
    broken = {v.split(".")[1]: why for v, why in error.value.broken.items()}
    assert "low" in broken and broken["both"] == broken["upper_part"] == f"reads {schema}.low"


@pytest.mark.parametrize("kept", [None, 1])
def test_views_follow_new_columns(spark, chain, schema, kept):
    wide = View(chain, "select id, id % 3 as k, 'x' as label, 1.5 as price from range(12)", keep_versions=kept)
    rebuild(spark, wide)
    assert spark.table(f"{schema}.low").columns == ["id", "k", "label", "price"]
    assert spark.table(f"{schema}.both").count() == 6
    rebuild(spark, wide._replace(query="select id, id % 3 as k, 2.5 as price from range(4)"))
    assert spark.table(f"{schema}.low").columns == ["id", "k", "price"]
    assert spark.table(f"{schema}.low").agg(F.max("price")).first()[0] == 2.5
