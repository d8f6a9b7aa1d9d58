"""Work that must not grow faster than its input: what is shuffled, and how often a long text is looked at."""

import random

import pytest
from pyspark.sql import functions as F

from newsprint.functions import text
from newsprint.operators import classify, dedupe

NAMES = ("a", "b", "c", "d")


def model(spark):
    rng = random.Random(5)
    counts = [(f"t{i}", s, rng.randrange(1, 60 // (i + 1) + 2)) for i in range(30) for s in rng.sample(NAMES, rng.randrange(1, 4))]
    stats = [(s, 3, 40 + i) for i, s in enumerate(NAMES)]
    items = [(f"i{i}", f"t{rng.randrange(45)}", 1) for i in range(90) for _ in range(rng.choice([1, 5]))]
    schemas = "item_id string, token string, n long", "token string, section string, n long", "section string, docs long, total_tokens long"
    return [spark.createDataFrame(rows, schema) for rows, schema in zip((items, counts, stats), schemas, strict=True)]


def rounded(df, value):
    return {(r.item_id, r.section): None if r[value] is None else round(r[value], 6) for r in df.collect()}


@pytest.mark.parametrize("most", [0, 12, 300_000])
def test_margins_with_tokens_in_two_parts(spark, most):
    freq, counts, stats = model(spark)
    once = freq.groupBy("item_id", "token").agg(F.sum("n").alias("n"))
    want = rounded(classify.predict_margin(classify.nb_scores(once, counts, stats)), "margin")
    assert len(want) == 90 and rounded(classify.predict_margin(classify.nb_scores(freq, counts, stats, most)), "margin") == want


def test_similarity_sorts_what_both_have(spark):
    """The time goes with a's length only as finding its tokens does: a pair of a long and a short text sorts the short one."""
    df = spark.range(1).select(F.lit("x").alias("a"), F.lit("y").alias("b"))
    plan = df.select(text.text_similarity(F.col("a"), F.col("b")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" in plan and "sort_array" in plan and "split(" not in plan
    rows = [("b a " * 3 + "é c", "c c d a b-é", 1 - 1 / 9), ("...", "a", 0.0), ("a", "...", 0.0), ("x", None, 0.0), ("K", "k", 1.0)]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string").select("i", text.text_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [round(r.s, 9) for r in got.sort("i").collect()] == [round(r[2], 9) for r in rows]


@pytest.mark.parametrize("most", [0, 300_000])
def test_predictions_with_tokens_in_two_parts(spark, most):
    freq, counts, stats = model(spark)
    once = freq.groupBy("item_id", "token").agg(F.sum("n").alias("n"))
    want = rounded(classify.nb_predict(once, counts, stats), "margin")
    assert want and rounded(classify.nb_predict(freq, counts, stats, most=most), "margin") == want


def test_dedupe_shuffles_each_value_once(spark):
    rows = [(1, None, "i", "L", None), (2, None, "i", "m", None), (3, "d", "i", "l", None), (4, "d", "j", "L", None), (4, "d", "j", "L", None)]
    items = spark.createDataFrame([(*r, "f") for r in rows], "row_id long, edition_date string, item_id string, link string, published_at timestamp, feed_id string")
    out = dedupe.dedupe_items(items, tie=("row_id",))
    assert sorted(r.row_id for r in out.collect()) == [1, 3]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex(" AS o#") < plan.index("Join LeftSemi")
