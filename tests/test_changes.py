"""Scans and plans from what has changed, against scans and plans from zero."""

import os
import random

import pytest

from freshet.plans.replan import PlanError, empty_catalog, folder_state, replan, replan_changes, update_state
from freshet.sources import definitions as folder
from freshet.sources import manifest

NOW = 1_700_000_000


def write(root, files):
    for path, text in files.items():
        place = root / path
        if text is None:
            place.unlink()
        else:
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(text)
            # Two writes within a clock tick must differ all the same.
            os.utime(place, ns=(0, random.randrange(10**18)))
    return str(root)


def texts(df):
    return {r.path: r.text for r in df.collect()}


def changes_between(spark, before, after):
    changed = [(p, t, p in before) for p, t in after.items() if before.get(p) != t]
    gone = [(p,) for p in before if p not in after]
    files = spark.createDataFrame(changed, "path string, text string, known boolean")
    return manifest.Changes(files, spark.createDataFrame(gone, "path string"), manifest.empty_manifest(spark), len(changed), len(gone))


@pytest.mark.parametrize("named_paths", [manifest.NAMED_PATHS, 1])
def test_scan_of_changes(spark, tmp_path, named_paths):
    root = write(tmp_path / "my views+1", {"a/x — 1h.sql": "select 1", "a/[b]{c}*.sql": "select 2", "a/y.sql": " two ", "a.conf": "k=v", "a/no.md": "-", "a/empty.sql": ""})
    first = manifest.scan_changes(spark, root, manifest.empty_manifest(spark), named_paths)
    assert texts(first.files) == texts(folder.scan_folder(spark, root)) and first.n_changed == 4
    assert not any(r.known for r in first.files.collect())
    known = manifest.take_changes(spark.createDataFrame([], "path string, text string"), first)

    same = manifest.scan_changes(spark, root, first.manifest, named_paths)
    assert (same.n_changed, same.n_gone, same.files.count(), same.gone.count()) == (0, 0, 0, 0)

    write(tmp_path / "my views+1", {"a/y.sql": " too ", "a/[b]{c}*.sql": "select 3", "b/z w.sql": "new", "a.conf": None, "a/x — 1h.sql": ""})
    second = manifest.scan_changes(spark, root, first.manifest, named_paths)
    assert {r.path: r.known for r in second.files.collect()} == {"a/y.sql": True, "a/[b]{c}*.sql": True, "b/z w.sql": False}
    assert {r.path for r in second.gone.collect()} == {"a.conf", "a/x — 1h.sql"}
    assert texts(manifest.take_changes(known, second)) == texts(folder.scan_folder(spark, root))


def parts_of(state):
    def rows(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)

    return {name: rows(getattr(state, name)) for name in ("files", "classified", "definitions", "mentions", "edges", "levels", "configs")}


FIRST = {
    "s/a.sql": "from s.b, s.later", "s/b.sql": "from s.c", "s/c.sql": "select 1", "t/d.sql": "from s.a",
    "t/p_select.sql": "from s.a", "s.conf": "diststyle=all",
}
STEPS = [
    # A text that reads something else, a name others have mentioned before, settings of one table
    # and of all, a select that becomes the input of a processor.
    {
        "s/b.sql": "select 1", "s/later.sql": "from s.c", "t/d.conf": "sortkey=x", "global.conf": "grant_select=ana",
        "t/p.py": "pass", "t/p 1h.sql": "create table t.p(x int)", "t/p_test.sql": "select true",
    },
    # Tables and settings go, the processor too; a cycle comes, then goes.
    {"t/p.py": None, "t/e.sql": "from t.d, t.p_select", "s.conf": None, "t.conf": "grant_select=+bo", "s/c.sql": "from t.e", "t/f.sql": "from t.f"},
    {"s/c.sql": None, "t/f.sql": None, "global.conf": None, "s/b.sql": "select 2"},
]


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_states_after_changes(spark, few_partitions):
    before, state = FIRST, folder_state(spark.createDataFrame(list(FIRST.items()), "path string, text string"))
    for step in STEPS:
        after = {p: t for p, t in {**before, **step}.items() if t is not None}
        state = update_state(state, changes_between(spark, before, after))
        whole = folder_state(spark.createDataFrame(list(after.items()), "path string, text string"))
        assert parts_of(state) == parts_of(whole) and state.cyclic == whole.cyclic
        before = after


def test_plan_from_changes(spark, tmp_path):
    root = write(tmp_path, {"s/a 1h.sql": "select x from s.b", "s/b.sql": "select x from raw.t", "s.conf": "sortkey=x\ngrant_select=ana"})
    first = manifest.scan_changes(spark, root, manifest.empty_manifest(spark))
    state = folder_state(first.files.select("path", "text"))
    plan = replan(spark, root, empty_catalog(spark), NOW)
    write(tmp_path, {"s/b.sql": "select x, 2 as y from raw.t", "s/c 2h.sql": "select x from s.a", "s/a 1h.sql": None, "s/a 3h.sql": "select x from s.b"})
    changes = manifest.scan_changes(spark, root, first.manifest)
    state, again = replan_changes(state, changes, plan.catalog, NOW + 5, strict=True)
    whole = replan(spark, root, plan.catalog, NOW + 5, strict=True)
    for one, other in zip(again, whole, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.select(*one.columns).collect()))

    write(tmp_path, {"s/d.sql": "select x from s.c"})
    with pytest.raises(PlanError, match="sources without an interval: s.d"):
        replan_changes(state, manifest.scan_changes(spark, root, changes.manifest), plan.catalog, NOW)


def test_scan_lists_in_tasks(spark, tmp_path, monkeypatch):
    """The driver takes in no listing; what Spark's readers pass over is not there."""
    some = {f"s{i % 3}/deep {i % 2}/t%20{i}ä — 1h.sql": f"select {i}" for i in range(30)}
    over = {"_old/a.sql": "-", ".git/a.sql": "-", "s1/_a.sql": "-", "s1/.a.sql": "-", "s1/a.sql.bak": "-", "s1/empty.sql": ""}
    root = write(tmp_path, {**some, **over, "x=1/_y=2.sql": "kept"})

    def refuse(*_, **__):
        raise AssertionError("the driver lists the folder")

    with monkeypatch.context() as patched:
        for reader in ("load", "text"):
            patched.setattr(type(spark.read), reader, refuse)
        first = manifest.scan_changes(spark, root, manifest.empty_manifest(spark))
        assert texts(first.files) == {**some, "x=1/_y=2.sql": "kept"} == texts(folder.scan_folder(spark, f"file://{root}/"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,py,conf,txt}").load(root)
    assert sorted((r.length, r.modified) for r in first.manifest.collect()) == sorted((r.length, r.modificationTime) for r in listed.collect())
    with pytest.raises(Exception, match="No such file"):
        manifest.scan_changes(spark, f"{root}/gone", manifest.empty_manifest(spark))
