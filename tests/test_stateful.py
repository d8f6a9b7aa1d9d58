"""Streams with state over several batches, and predictions from bounded sections, against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsprint.operators import classify, filters
from newsprint.streaming import jobs, stateful

LOG = "reader_id string, item_id string, op string, seq long"


def feed(spark, path, rows, schema, job):
    """Each list of rows lands as a batch of its own, and the job runs to its end after each."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
        job(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/cp").awaitTermination(120)
        yield k


def test_read_state_over_batches(spark, tmp_path):
    rng = random.Random(4)
    ops = ["read"] * 6 + ["unread"] * 2 + ["clear"]
    log = [(rng.choice("abc"), f"i{rng.randrange(12)}", op, seq) for seq, op in enumerate(rng.choice(ops) for _ in range(240))]
    log = [(r, None if op == "clear" else i, op, seq) for r, i, op, seq in log] + [(None, "x", "read", 300), ("d", "y", "read", 5), ("d", None, "clear", 2), ("d", "z", "read", 1)]
    late = [x for x in log if x[3] % 7 == 3]
    parts = [[x for x in log[:90] if x not in late], [x for x in log[90:] if x not in late], late]
    seen = []
    for k in feed(spark, str(tmp_path), parts, LOG, jobs.stream_read_state):
        seen += parts[k]
        want = {tuple(r) for r in filters.read_state(spark.createDataFrame(seen, LOG)).collect()}
        assert {tuple(r) for r in jobs.current_reads(spark, f"{tmp_path}/out").collect()} == want
    # a batch tells of changes alone, and the session keeps its own state store
    assert spark.read.parquet(f"{tmp_path}/out").filter("reader_id = 'd'").count() == 1
    assert stateful.PROVIDER not in spark.conf.getAll or spark.conf.get(stateful.PROVIDER) != stateful.ROCKS


ITEMS = "row_id long, at string, n long, feed_id string"


@pytest.mark.parametrize("salts", [1, 5])
def test_each_item_is_in_one_table(spark, tmp_path, salts):
    """Days that have closed, days still open behind the newest item, an open day's late rows, and undated items."""
    first = [(i, f"2024-01-{20 + i % 3} 10:00:00", 1, "f") for i in range(30)] + [(50, None, 1, "f")]
    second = [(100 + i, f"2024-01-{28 if i else 27} 23:00:00", 1, "f") for i in range(5)]
    third = [(200 + i, f"2024-01-{d} 01:00:00", 1, None) for i, d in enumerate((20, 20, 26, 27, 28, 30, 1))] + [(300, None, 1, None)]

    def job(live, out, checkpoint):
        return jobs.stream_late_table(live.withColumn("published_at", F.to_timestamp("at")), out, checkpoint, salts=salts)

    for _ in feed(spark, str(tmp_path), (first, second, third), ITEMS, job):
        pass
    rows = spark.read.parquet(f"{tmp_path}/out")
    got = rows.filter("row_id is not null")
    assert Counter(r.row_id for r in got.collect()) == Counter(r[0] for r in first + second + third)
    timing = {r.row_id: r.timing for r in got.collect()}
    # the newest item, of the 28th at 23:00, closes days up to the 26th when the third batch comes
    assert {k for k, t in timing.items() if t == "late"} == {200, 201, 202, 206} and {k for k, t in timing.items() if t == "undated"} == {50, 300}
    assert got.filter("timing = 'late'").count() == spark.read.parquet(f"{tmp_path}/out/timing=late").count() == 4
    closed = {str(r.edition_date): r.n for r in rows.filter("timing = 'closed'").groupBy("edition_date").agg(F.sum("n").alias("n")).collect()}
    # the item of the 30th at 01:00 closes the 28th, and the 30th itself is open
    assert closed == {"2024-01-20": 10, "2024-01-21": 10, "2024-01-22": 10, "2024-01-27": 2, "2024-01-28": 5}


def plain(freq, counts, stats, margin=1.0):
    size = max(1, len({t for t, _, _ in counts}))
    seen, by_item = {(t, s): n for t, s, n in counts}, defaultdict(list)
    for item, token, n in freq:
        by_item[item].append((token, n))
    out = {}
    if sum(d >= 3 for _, d, _ in stats) >= 3:
        for item, tokens in by_item.items():
            scores = sorted(((sum(n * (math.log(seen.get((t, s), 0) + 1) - math.log(total + size)) for t, n in tokens), s) for s, _, total in stats), reverse=True)
            if len(scores) == 1 or scores[0][0] - scores[1][0] >= margin:
                out[item] = (scores[0][1], round(scores[0][0] - scores[1][0], 6) if len(scores) > 1 else None)
    return out


@pytest.mark.parametrize("sections", [3, 4, 40])
def test_best_two_of_many_sections(spark, sections):
    rng = random.Random(sections)
    names = [f"s{i:02}" for i in range(sections)]
    stats = [(s, rng.choice([3, 4, 2 if sections > 5 else 9]), rng.choice([10, 10, 30, 400])) for s in names]
    counts = list({(f"t{rng.randrange(30)}", rng.choice(names)): rng.randrange(1, 40) for _ in range(60)}.items())
    counts = [(t, s, n) for (t, s), n in counts]
    freq = [(f"i{i}", f"t{t}", rng.randrange(1, 4)) for i in range(120) for t in rng.sample(range(45), rng.choice([1, 2, 6]))]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((freq, "item_id string, token string, n long"), (counts, "token string, section string, n long"), (stats, "section string, docs long, total_tokens long"))]
    for margin in (0.0, 1.0):
        got = {r.item_id: (r.section, round(r.margin, 6)) for r in classify.nb_predict(*frames, margin).collect()}
        want = plain(freq, counts, stats, margin)
        assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
        assert all(got[k][0] == want[k][0] or want[k][1] < 1e-9 for k in want)


def test_models_that_are_not_ready_and_lone_sections(spark):
    freq = spark.createDataFrame([("i", "t", 2), ("j", "u", 1)], "item_id string, token string, n long")
    counts = spark.createDataFrame([("t", "a", 3)], "token string, section string, n long")
    for stats in ([("a", 9, 3), ("b", 2, 3), ("c", 9, 3)], []):
        assert classify.nb_predict(freq, counts, spark.createDataFrame(stats, "section string, docs long, total_tokens long")).count() == 0
    stats = spark.createDataFrame([("a", 9, 3), ("b", 3, 3), ("c", 9, 3)], "section string, docs long, total_tokens long")
    assert [(r.item_id, r.section) for r in classify.nb_predict(freq, counts, stats).collect()] == [("i", "a")]
    assert classify.nb_predict(freq, counts.limit(0), stats, 0.0).count() == 2


def test_a_batch_writes_its_predictions_alone(spark, tmp_path, monkeypatch):
    counts = spark.createDataFrame([("view", "a", 9), ("click", "b", 9), ("sign", "c", 9)], "token string, section string, n long")
    stats = spark.createDataFrame([(s, 3, 9) for s in "abc"], "section string, docs long, total_tokens long")
    spark.createDataFrame([("1", "view view"), ("2", "click"), ("3", "other")], "item_id string, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    written, real = [], classify.cut
    monkeypatch.setattr(classify, "cut", lambda df: written.append(1) or real(df))
    live = spark.readStream.schema("item_id string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_classify(live, counts, stats, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert len(written) == 2  # the model's two tables, however many batches come
    assert {(r.item_id, r.section) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("1", "a"), ("2", "b")}
