"""What the classifier shuffles: texts once and only where they are labelled, tokens only where the model may know them."""

import re

import pytest
from pyspark.sql import functions as F

from newsprint.operators import classify
from newsprint.operators.sieve import may_match, sieve
from newsprint.plans import reflow
from newsprint.plans.fixtures import TABLES, view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(i, None if i % 7 == 0 else f"text {i}", ("de", "en", None)[i % 3]) for i in range(-5, 60)] + [(None, "none", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in (-5, 0, 1, 5, 5, 7, 20, 99, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_moves_shuffle_texts_once(spark, folder, no_broadcasts):
    last = classify.latest_corrections(view(spark, folder, "moves_doc"))
    exchanges = [x for x in re.findall(r"Exchange hashpartitioning\(([^,]*)", plan(last)) if not x.startswith("word")]
    assert len(exchanges) == 2  # of the documents and of the labels' ids
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(TABLES["moves_doc"])
    got = view(spark, folder, "moves_doc")
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert got.count() == want.count() == 12 and got.exceptAll(want).count() == 0


def test_sieve(spark):
    rows = spark.range(2000).select(F.when(F.col("id") != 3, F.concat(F.lit("k"), "id")).alias("k"), "id")
    out = may_match(rows, F.col("k"), sieve(rows.filter("id < 400"), "k"))
    assert out.columns == ["k", "id", "may"] and out.count() == 2000
    assert out.filter("may and id < 400").count() == 399
    assert out.filter("may and id >= 400").count() < 10
    full = sieve(rows, "k", 6)
    assert full.count() == 1 and may_match(rows, F.col("k"), full, 6).filter("not may").select("id").collect() == [(3,)]
    assert may_match(rows, F.col("k"), sieve(rows.limit(0), "k")).filter("may").count() == 0


def test_unknown_tokens_are_summed_where_they_stand(spark):
    """Of 3000 tokens that no section knows, one row an item is left before the join with the rare tokens."""
    freq = spark.range(3000).select(F.concat(F.lit("i"), F.col("id") % 3).alias("item_id"), F.concat(F.lit("u"), "id").alias("token"), F.lit(1).cast("long").alias("n"))
    freq = freq.unionByName(spark.createDataFrame([("i0", "w", 2), ("i9", "w", 1)], "item_id string, token string, n long"))
    counts = spark.createDataFrame([("w", s, n) for s, n in (("a", 9), ("b", 1))], "token string, section string, n long")
    stats = spark.createDataFrame([(s, 3, 9) for s in "abc"], "section string, docs long, total_tokens long")
    *tokens, _ = classify.nb_model(counts, stats, most=0)
    gains = classify._gains(freq, *tokens)
    rows = {(r.item_id, r.section): (r.gain and round(r.gain, 6), r.n) for r in gains.collect()}
    assert rows.keys() == {("i0", "a"), ("i0", "b"), ("i9", "a"), ("i9", "b"), *((f"i{k}", None) for k in range(3))}
    assert sum(n for _, n in rows.values()) == 3003 and rows["i0", "a"] == (4.60517, 2)
    assert "sections" in plan(gains) and tokens[2].count() == 1
    met = may_match(freq, F.col("token"), tokens[2]).filter("may")
    assert met.count() <= 4


def test_training_looks_at_a_text_once(spark):
    moves = [("a", 1, "x", "alpha beta"), ("a", 2, "y", "alpha beta alpha"), ("b", 1, "x", "the"), ("c", 3, "z", None), ("d", 4, None, "éclair x")]
    df = spark.createDataFrame(moves, "item_id string, seq long, section string, text string")
    counts, stats, pins = reflow.train(df)
    assert "regexp" not in plan(counts) + plan(stats)
    last = classify.latest_corrections(df)
    assert sorted(map(str, counts.collect())) == sorted(map(str, classify.train_token_counts(last).collect()))
    assert sorted(map(str, stats.collect())) == sorted(map(str, classify.train_section_stats(last).collect()))
    assert sorted(r.item_id for r in pins.collect()) == ["a", "b", "c", "d"]
