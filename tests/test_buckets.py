"""Bucketed state: what a change touches, what a broken one leaves, what goes with a clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from jobstrata.sources.buckets import Store
from jobstrata.streaming import crawl
from test_operators import SCAN

TABLES = {"jobs": "id long, site_id long, title string", "waiting": "site_id long, n int"}


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id long, site_id long, title string")


def first(spark, root, buckets=1000):
    store = Store(spark, root, TABLES, buckets=buckets)
    everything = spark.range(3000).select("id", (F.col("id") % 500).alias("site_id"), F.lit("t").alias("title"))
    change = store.begin(1)
    change.put("jobs", everything, store.touched(everything))
    change.commit()
    return store


def test_a_change_of_one_site_writes_one_bucket_of_a_thousand(spark, tmp_path):
    store = first(spark, str(tmp_path))
    before = store.manifest()["tables"]["jobs"]
    new = rows(spark, (3, 3, "new"))
    touched = store.touched(new)
    assert len(touched) == 1
    held = store.read("jobs", touched)
    assert len(held.inputFiles()) <= len(store.read("jobs").inputFiles()) / 100  # other buckets aren't opened
    change = store.begin(2)
    change.put("jobs", held.where("site_id <> 3").union(new), touched)
    folder = next(n for n in os.listdir(tmp_path / "jobs") if n.startswith("v00000002"))
    assert len([n for n in os.listdir(tmp_path / "jobs" / folder) if n.startswith("bucket=")]) == 1
    assert store.version() == 1 and store.read("jobs").where("title = 'new'").count() == 0  # not before the commit
    change.commit()
    after = store.manifest()["tables"]["jobs"]
    assert {b for b in after if after[b] != before[b]} == {str(touched[0])} and set(after) == set(before)
    assert store.read("jobs").count() == 3000 - 6 + 1 and store.read("jobs", version=1).count() == 3000
    assert {tuple(r) for r in store.read("jobs").where("site_id = 3").collect()} == {(3, 3, "new")}


def test_a_broken_change_leaves_the_old_version(spark, tmp_path):
    store = first(spark, str(tmp_path), 8)
    broken = store.begin(2)
    everything = store.read("jobs")
    broken.put("jobs", everything.withColumn("title", F.lit("bad")), range(8))  # and no commit
    again = Store(spark, str(tmp_path), TABLES)
    assert again.buckets == 8 and again.version() == 1 and again.read("jobs").where("title = 'bad'").count() == 0
    good = again.begin(2)
    good.put("jobs", again.read("jobs").withColumn("title", F.lit("good")), range(8))
    good.commit()
    with pytest.raises(Exception, match="(?i)exist"):
        broken.commit()  # another writer was first
    with pytest.raises(ValueError, match="there already"):
        again.begin(2)
    gone = again.vacuum(keep=1)
    assert any(broken.attempt in p for p in gone) and "manifest/v00000001.json" in gone and not any(good.attempt in p for p in gone)
    assert again.read("jobs").select("title").distinct().collect() == [("good",)] and again.vacuum(keep=1) == []


def test_empty_buckets_and_null_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES, buckets=4)
    data = rows(spark, (1, None, "no site"), (2, 1, "a"))
    touched = store.touched(data)
    change = store.begin(0)
    change.put("jobs", data, touched)
    change.commit()
    assert store.read("jobs").count() == 2 and store.read("waiting").count() == 0
    change = store.begin(1)
    change.put("jobs", data.where("false"), touched)
    change.commit()
    assert store.read("jobs").count() == 0 and store.manifest()["tables"]["jobs"] == {}
    with pytest.raises(ValueError, match="weren't named"):
        store.begin(2).put("jobs", data, [])


def test_a_batch_that_breaks_off_is_run_again(spark, tmp_path, monkeypatch):
    def row(site, scan_id, pos, title):
        return (site, scan_id, False, pos, title, "Wien", f"u{pos}")

    root = str(tmp_path)
    run = crawl.reconcile_each_batch(root, lambda n: F.to_timestamp_ntz(F.lit(f"2024-01-{n + 1:02d} 00:00:00")), buckets=1000)
    batch = lambda *r: spark.createDataFrame(list(r), SCAN)
    run(batch(*[row(s, 1, 0, "Dev") for s in range(40)], *[(s, 1, True, None, None, None, None) for s in range(40)]), 0)
    store = crawl.catalog_store(spark, root)
    before = store.manifest()["tables"]["jobs"]
    assert store.read("jobs").count() == 40
    second = batch(row(7, 2, 0, "QA"), (7, 2, True, None, None, None, None))
    with monkeypatch.context() as m:
        m.setattr("jobstrata.sources.buckets.Change.commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            run(second, 1)
    assert store.version() == 0 and store.log("history", crawl.HISTORY).count() == 40
    run(second, 1)
    after = store.manifest()["tables"]["jobs"]
    assert sum(after[b] != before.get(b) for b in after) == 1 and len(after) == len(before)
    assert sorted((r.title, r.is_active) for r in store.read("jobs").where("site_id = 7").collect()) == [("Dev", False), ("QA", True)]
    events = sorted((r.event, r.site_id) for r in store.log("history", crawl.HISTORY).where("changed_at > timestamp_ntz'2024-01-01 12:00:00'").collect())
    assert events == [("added", 7), ("removed", 7)]
    assert not os.listdir(tmp_path / "_steps") if (tmp_path / "_steps").exists() else True
