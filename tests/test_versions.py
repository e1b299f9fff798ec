"""Versioned tables: loads together or not at all, repeated keys, conflicts, differences."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.operators import versions as V

ROW = "k long, n long, v string, day date"


def rows(spark, *values):
    return spark.createDataFrame([(k, n, v, date(2024, 1, d)) for k, n, v, d in values], ROW)


def stored(store, name="t", schema=None):
    return sorted(tuple(r) for r in store.table(name, schema).collect())


def loaded(store, change):
    load = store.load()
    change(load)
    return load.commit()


def test_repeated_keys_and_repeated_loads(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    batch = rows(spark, (1, 1, "a", 1), (1, 3, "c", 1), (1, 2, "b", 1), (2, 1, None, 2), (None, 5, "null key", 3), (None, 4, "null key", 3))
    for _ in range(2):
        store = loaded(store, lambda load: load.upsert("t", batch.where("k IS NOT NULL"), ["k"], ["n"], buckets=4))
    assert stored(store, schema=batch.schema) == [(1, 3, "c", date(2024, 1, 1)), (2, 1, None, date(2024, 1, 2))]
    more = rows(spark, (1, 9, "other", 1), (3, 1, "x", 1), (3, 2, "y", 1))
    kept = loaded(store, lambda load: load.insert_missing("t", more, ["k"], ["n"], buckets=4))
    assert [(r[0], r[2]) for r in stored(kept, schema=batch.schema)] == [(1, "c"), (2, None), (3, "y")]
    blank = batch.select("k", "v").schema
    filled = loaded(kept, lambda load: load.fill_blanks("f", rows(spark, (1, 1, "", 1), (2, 1, "b", 1)), ["k"], ["v"], ["v"]))
    filled = loaded(filled, lambda load: load.fill_blanks("f", rows(spark, (1, 1, "a", 1), (2, 1, "z", 1), (4, 1, None, 1)), ["k"], ["v"], ["v"]))
    assert stored(filled, "f", blank) == [(1, "a"), (2, "b"), (4, "")]


def test_failed_load_changes_nothing_and_two_loads_conflict(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    first, second = rows(spark, (1, 1, "a", 1), (2, 1, "b", 2)), rows(spark, (1, 2, "A", 1))
    store = loaded(store, lambda load: (load.replace_days("t", first, "day"), load.replace_days("u", first, "day")))
    load = store.load()
    load.replace_days("t", second, "day")
    with pytest.raises(Exception, match="broken"):
        load.replace_days("u", second.withColumn("v", F.raise_error(F.lit("broken")).cast("string")), "day")
    again = V.Versions(spark, store.root)
    assert again.version == 1 and stored(again, schema=first.schema) == stored(store, "u", first.schema) == sorted(map(tuple, first.collect()))
    one, two = store.load(), store.load()
    one.replace_days("t", second, "day")
    two.replace_days("t", second, "day")
    newest = one.commit()
    with pytest.raises(V.Conflict):
        two.commit()
    assert stored(newest, schema=first.schema) == [(1, 2, "A", date(2024, 1, 1)), (2, 1, "b", date(2024, 1, 2))]
    with pytest.raises(ValueError):
        load.replace_days("t", second, "day")


def test_empty_days_retention_and_tables(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    schema = rows(spark).schema
    assert stored(store, schema=schema) == []
    store = loaded(store, lambda load: load.replace_days("t", rows(spark, (1, 1, "a", 1), (2, 1, "b", 2), (3, 1, "c", 9)), "day"))
    store = loaded(store, lambda load: load.replace_days("t", rows(spark), "day", [date(2024, 1, 2)]))
    assert [r[0] for r in stored(store, schema=schema)] == [1, 3]
    store = loaded(store, lambda load: load.retain("t", 3, F.lit("2024-01-10").cast("date")))
    assert [r[0] for r in stored(store, schema=schema)] == [3]
    assert [(r.cell, r.n_rows) for r in store.coverage().collect()] == [("2024-01-09", 1)]


def test_changes_read_only_cells_that_differ(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    old = loaded(store, lambda load: load.replace_days("t", rows(spark, (1, 1, "a", 1), (2, 1, "b", 2), (3, 1, None, 2)), "day"))
    new = loaded(old, lambda load: load.replace_days("t", rows(spark, (2, 1, "B", 2), (3, 1, None, 2), (4, 1, "d", 2)), "day"))
    found = new.changes(old.version, "t", rows(spark).schema, ["k"])
    assert sorted((r.change, r.k) for r in found.collect()) == [("insert", 4), ("update", 2)]
    assert sorted((r.change, r.k) for r in V.Versions(spark, store.root, 1).changes(new.version, "t", rows(spark).schema, ["k"]).collect()) == [("delete", 4), ("update", 2)]
    assert all("2024-01-01" not in f for f in found.select("before").inputFiles())


def test_run_skips_covered_days(spark, tmp_path):
    store = V.Versions(spark, f"file://{tmp_path}/s")
    first = rows(spark, *[(i, 1, "a", 1) for i in range(40)], *[(i, 1, "a", 2) for i in range(10)], (7, 1, "a", 3))
    full = rows(spark, *[(i, 1, "b", 1) for i in range(41)], *[(i, 1, "b", 2) for i in range(20)], (7, 1, "b", 3))
    for batch in (first, full, full):
        store = V.store_run(store, {"t": batch}, {"p": batch}, "day", ["day", "k"])
    got = {(r.day.day, r.v): r["count"] for r in store.table("t", first.schema).groupBy("day", "v").count().collect()}
    assert got == {(1, "a"): 40, (2, "a"): 10, (2, "b"): 10, (3, "a"): 1} and store.version == 2
    got = {(r.day.day, r.v): r["count"] for r in store.table("p", first.schema).groupBy("day", "v").count().collect()}
    assert got == {(1, "a"): 40, (2, "b"): 20, (3, "a"): 1}
