"""Streams against their batch twins, over files in another order."""

import pytest
from pyspark.sql import functions as F

from newsprint.operators.dedupe import dedupe_items
from newsprint.plans.fixtures import view
from newsprint.streaming import jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landing") / "items")
    ev = view(spark, DATA, "items_ev").drop("edition_date").withColumn("published_at", F.col("published_at").cast("timestamp"))
    ev.repartition(6, F.col("row_id") % 7).write.parquet(base)
    return base, ev.schema


def stream(spark, landing):
    return spark.readStream.schema(landing[1]).option("maxFilesPerTrigger", 2).parquet(landing[0])


def finish(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_accumulate_is_batch(spark, landing, tmp_path):
    jobs.stream_accumulate(stream(spark, landing), f"{tmp_path}/editions", f"{tmp_path}/cp", ("row_id",)).awaitTermination(180)
    stored = spark.read.parquet(f"{tmp_path}/editions")
    assert stored.count() == stored.select("edition_date", F.lower("link")).distinct().count()
    whole = dedupe_items(view(spark, DATA, "items_ev"), tie=("row_id",))
    assert stored.select("edition_date").distinct().count() == whole.select("edition_date").distinct().count()
    # in one batch the stored days are just the batch's result
    one = spark.readStream.schema(landing[1]).parquet(landing[0])
    jobs.stream_accumulate(one, f"{tmp_path}/one", f"{tmp_path}/cp1", ("row_id",)).awaitTermination(180)
    assert {r.row_id for r in spark.read.parquet(f"{tmp_path}/one").collect()} == {r.row_id for r in whole.collect()}
    # retention deletes the days that have run out, and a second run has nothing to do
    for k in range(2):
        jobs.stream_retention(one, f"{tmp_path}/one", f"{tmp_path}/cp-kept{k}", "2024-01-30").awaitTermination(180)
        assert spark.read.parquet(f"{tmp_path}/one").select("edition_date").distinct().count() == 7
    assert len(list((tmp_path / "one").glob("edition_date=*"))) == 7


def test_dedupe_first_sighting(spark, landing):
    got = finish(jobs.stream_dedupe(stream(spark, landing), delay="60 days"), "seen")
    ev = view(spark, DATA, "items_ev")
    assert got.count() == ev.select("edition_date", F.lower("link")).distinct().count()


def test_day_counts(spark, landing):
    got = finish(jobs.stream_day_counts(stream(spark, landing), delay="60 days"), "days", "complete")
    want = view(spark, DATA, "items_ev").groupBy("edition_date", "feed_id").agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_late_items(spark, landing):
    got = finish(jobs.stream_late_items(stream(spark, landing), "2024-01-10"), "late").groupBy("timing").count().collect()
    want = view(spark, DATA, "items_ev").groupBy(F.expr("case when edition_date < '2024-01-10' then 'late' when edition_date > '2024-01-10' then 'early' else 'today' end")).count()
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()}


def test_feed_health_and_reads(spark, tmp_path):
    for name, job in (("fetch_log_ev", jobs.stream_feed_health), ("read_log_ev", None)):
        df = view(spark, DATA, name)
        df = df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
        df.repartition(4).write.parquet(f"{tmp_path}/{name}")
        if job:
            live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
            got = finish(job(live), name, "complete")
            assert {tuple(r) for r in got.collect()} == {tuple(r) for r in job(df).collect()}
    log = spark.createDataFrame([("r", "a", "read", 1), ("r", "b", "read", 2), ("r", None, "clear", 3), ("r", "c", "read", 4), ("r", "c", "unread", 5), ("r", "a", "read", 6)], "reader_id string, item_id string, op string, seq long")
    assert [tuple(r) for r in jobs.stream_read_state(log).collect()] == [("r", "a")]


def test_classify(spark, landing, tmp_path):
    counts = spark.createDataFrame([(t, s, 9) for t, s in (("view", "a"), ("click", "b"), ("signup", "c"))], "token string, section string, n long")
    stats = spark.createDataFrame([(s, 3, 9) for s in "abc"], "section string, docs long, total_tokens long")
    items = stream(spark, landing).withColumn("text", F.col("title")).withColumn("item_id", F.col("row_id").cast("string"))
    jobs.stream_classify(items, counts, stats, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("section").count().collect()
    want = view(spark, DATA, "items_ev").filter("section in ('view', 'click', 'signup')").groupBy(F.expr("case section when 'view' then 'a' when 'click' then 'b' else 'c' end")).count()
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()}


def test_classify_again(spark, landing, tmp_path):
    """A batch whose end was not recorded runs once more: its rows are replaced, not doubled."""
    counts = spark.createDataFrame([(t, s, 9) for t, s in (("view", "a"), ("click", "b"), ("signup", "c"))], "token string, section string, n long")
    stats = spark.createDataFrame([(s, 3, 9) for s in "abc"], "section string, docs long, total_tokens long")
    items = stream(spark, landing).withColumn("text", F.col("title")).withColumn("item_id", F.col("row_id").cast("string"))
    found = []
    for _ in range(2):
        jobs.stream_classify(items, counts, stats, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
        found.append(spark.read.parquet(f"{tmp_path}/out").count())
        last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda f: int(f.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert found[0] == found[1] > 0


@pytest.fixture
def behind(spark, tmp_path):
    """Items of the 20th of January in a first file, one of the 28th, and those of the 1st in a third, which comes late."""
    import os
    import time

    rows = [(i, f"https://s.example/{i % 40}", "f", day) for day in (20, 1) for i in range(100)]
    df = spark.createDataFrame([(i, x, f, f"2024-01-{d:02} 10:00:00") for i, x, f, d in rows], "row_id long, link string, feed_id string, at string")
    df = df.select("row_id", "link", "feed_id", F.to_timestamp("at").alias("published_at")).withColumn("day", F.dayofmonth("published_at"))
    base = f"{tmp_path}/behind"
    for k, day in enumerate((20, 22, 1)):
        part = df.filter(F.col("day") == day) if day < 22 else df.filter("day = 20 and row_id = 0").withColumn("published_at", F.to_timestamp(F.lit("2024-01-28 10:00:00")))
        part.drop("day").coalesce(1).write.mode("append").parquet(base)
        for f in (tmp_path / "behind").glob("part-*"):
            if f.stat().st_mtime > time.time() - 3600:
                os.utime(f, (time.time() - 10_000 + 100 * k,) * 2)
    return spark.readStream.schema(df.drop("day").schema).option("maxFilesPerTrigger", 1).parquet(base)


def test_rows_behind_the_watermark_are_left_out(spark, behind):
    seen = finish(jobs.stream_dedupe(behind), "behind_seen")
    assert {(str(r.edition_date), r.n) for r in seen.groupBy("edition_date").agg(F.count(F.lit(1)).alias("n")).collect()} == {("2024-01-20", 40), ("2024-01-28", 1)}
    counts = finish(jobs.stream_day_counts(behind), "behind_days")
    assert [(str(r.edition_date), r.n) for r in counts.collect()] == [("2024-01-20", 100)]
    # with a watermark that reaches back far enough they count
    seen = finish(jobs.stream_dedupe(behind, delay="40 days"), "behind_far")
    assert seen.filter("edition_date = '2024-01-01'").count() == 40
