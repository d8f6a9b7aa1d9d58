"""A paper fed in batches, in any order, against one dedupe of all items; and what a batch reads and writes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsprint.operators.dedupe import dedupe_items
from newsprint.plans import accumulate
from newsprint.sources import store

SCHEMA = "row_id long, feed_id string, item_id string, link string, published_at timestamp, title string"


def items(n, links, ids, days=2, seed=1, first=0):
    rng = random.Random(seed)
    return [
        (first + k, f"f{rng.randrange(4)}", f"i{rng.randrange(ids)}", f"https://L/{rng.randrange(links)}", datetime(2024, 1, 1 + rng.randrange(days)) + timedelta(minutes=rng.randrange(1400)), f"t{k}")
        for k in range(n)
    ]


def add(spark, rows, path, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("edition_date", F.to_date("published_at"))
    accumulate.add_items(df, path, ("row_id",), **more)


def whole(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("edition_date", F.to_date("published_at"))
    return {r.row_id for r in dedupe_items(df, tie=("row_id",)).collect()}


def stored(spark, path):
    got = [r.row_id for r in store.read_editions(spark, path).collect()]
    assert sorted(got) == sorted(r.row_id for r in spark.read.parquet(path).collect()) and len(got) == len(set(got))
    return set(got)


def test_any_order_of_batches(spark, tmp_path):
    """Dropped items come back when what dropped them is dropped; sparse and dense links, days in several batches."""
    rows = items(120, 70, 90) + items(60, 8, 50, seed=3, first=500)
    random.Random(5).shuffle(rows)
    path = f"{tmp_path}/p"
    for k, part in enumerate((rows[:90], rows[90:100], rows[100:])):
        add(spark, part, path, buckets=3)
        assert stored(spark, path) == whole(spark, rows[: (90, 100, 180)[k]])
    # a batch that is run again, and one without items, change nothing
    add(spark, rows[100:], path, buckets=3)
    add(spark, [], path, buckets=3)
    assert stored(spark, path) == whole(spark, rows)


def test_an_item_that_drops_what_dropped_another(spark, tmp_path):
    noon = datetime(2024, 1, 1, 12)
    old, mid, new = ((k, "f", i, link, noon + timedelta(minutes=k), "t") for k, i, link in ((1, "x", "l2"), (2, "x", "l1"), (3, "y", "L1")))
    for k, order in enumerate(((mid, old, new), (old, mid, new), (new, old, mid), (old, new, mid))):
        path = f"{tmp_path}/{k}"
        for row in order:
            add(spark, [row], path, buckets=2)
        assert stored(spark, path) == {1, 3} == whole(spark, list(order))


def test_a_batch_touches_its_own_buckets(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/p"
    rows = [(k, "f", f"i{k}", f"l{k}", datetime(2024, 1, 1, 1), "t") for k in range(600)]
    add(spark, rows, path, buckets=32)
    read, real = [], store.read_parts

    def watched(spark, path, table, wanted=None, schema=None):
        df = real(spark, path, table, wanted, schema)
        if table.startswith("_seen"):
            read.append(df.count())
        return df

    monkeypatch.setattr(store, "read_parts", watched)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("p/**/part-*")}
    add(spark, [(1000, "f", "i7", "other", datetime(2024, 1, 1, 2), "t")], path, buckets=32)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.glob("p/**/part-*")}
    assert max(read) < 200 and sum(read) < 300
    assert len(before.items() - after.items()) < 20 < len(before) and stored(spark, path) == {*range(600), 1000} - {7}


def test_a_failed_swap_leaves_the_paper(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/p", items(60, 20, 40)
    add(spark, rows[:30], path, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(store, "_swap", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            add(spark, rows[30:], path, buckets=2)
    assert {r.row_id for r in store.read_editions(spark, path).collect()} == whole(spark, rows[:30])
    add(spark, rows[30:], path, buckets=2)
    store.sweep(spark, path)
    assert stored(spark, path) == whole(spark, rows)


def test_days_stored_as_a_whole_are_taken_over(spark, tmp_path):
    path, rows = f"{tmp_path}/p", items(40, 15, 30, days=1)
    df = spark.createDataFrame(rows[:20], SCHEMA).withColumn("edition_date", F.to_date("published_at"))
    store.write_edition(dedupe_items(df, tie=("row_id",)).drop("gen"), path)
    first = stored(spark, path)
    add(spark, rows[20:], path, buckets=2)
    both = spark.createDataFrame([(*r, int(r[0] < 20)) for r in rows if r[0] in first or r[0] >= 20], SCHEMA + ", gen int").withColumn("edition_date", F.to_date("published_at"))
    assert stored(spark, path) == {r.row_id for r in dedupe_items(both, tie=("row_id",)).collect()}
    # a day that is then written as a whole forgets what it had seen, and retention drops all of a day
    store.write_edition(df.limit(3), path)
    assert len(stored(spark, path)) == 3 and not store.tables_of(spark, path).get(accumulate.ROWS)
    add(spark, rows, path, buckets=2)
    assert store.drop_pruned(spark, path, "2024-01-02", 1) == ["2024-01-01"]
    assert not list(tmp_path.glob("p/**/part-*")) and store.read_editions(spark, path).count() == 0
