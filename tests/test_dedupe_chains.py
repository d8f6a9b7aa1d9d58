"""Chains of items that share links and ids with the next ones, against the rule applied item by item."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsprint.operators import components, dedupe

SCHEMA = "row_id long, feed_id string, item_id string, link string, published_at timestamp, edition_date string, gen int"


def plain(rows):
    """Newest first, then by the further columns of the total order; each day by itself."""
    out, links, ids = set(), set(), set()
    for i, _, item, link, _, day, _ in sorted(rows, key=lambda r: (-r[4].timestamp(), r[6], r[1], r[2], r[3], r[0])):
        if (day, link.lower()) not in links and (day, item) not in ids:
            links.add((day, link.lower()))
            ids.add((day, item))
            out.add(i)
    return out


def chain(n, day="d", first=0, step=1):
    """n items of which each shares its link with the one before and its id with the one after, or the other way round."""
    noon = datetime(2024, 1, 1)
    return [(first + k, "f", f"i{day}{(k + 1) // 2}", f"L{day}{k // 2}", noon + timedelta(minutes=step * k), day, 0) for k in range(n)]


@pytest.mark.parametrize("step", [1, -1])
def test_long_chain(spark, step):
    rows = chain(5000, step=step)
    got = dedupe.dedupe_items(spark.createDataFrame(rows, SCHEMA).repartition(3), tie=("row_id",), most_rounds=9)
    assert {r.row_id for r in got.collect()} == plain(rows)


def test_chains_of_several_days_with_a_hot_id(spark):
    rng = random.Random(2)
    rows = [r for d in range(6) for r in chain(40 + 13 * d, f"d{d}", 1000 * d, rng.choice([1, -1]))]
    rows += [(9000 + k, "g", "hot", f"https://h/{k % 60}", datetime(2023, 5, 1) + timedelta(minutes=rng.randrange(900)), "d1", k % 2) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for settings in ({"in_order_from": 1}, {"in_order_from": 2, "most_rows": 60}, {}):
        assert {r.row_id for r in dedupe.dedupe_items(df, tie=("row_id",), **settings).collect()} == want, settings


def test_too_few_rounds_for_a_component_that_is_too_large(spark):
    df = spark.createDataFrame(chain(60), SCHEMA)
    with pytest.raises(RuntimeError, match="settle"):
        dedupe.dedupe_items(df, tie=("row_id",), most_rounds=2, in_order_from=1, most_rows=5).count()


@pytest.mark.parametrize("most", [200_000, 40])
def test_components(spark, most):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000 + k, 1000) for k in range(200)] + [(5000, 5000), (7, 9), (7, 9)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    name = {}
    for a, b in edges:
        if a != b:
            sides = [name.setdefault(x, {x}) for x in (a, b)]
            if sides[0] is not sides[1]:
                sides[0] |= sides[1]
                name.update(dict.fromkeys(sides[1], sides[0]))
    hashed = spark.createDataFrame(edges, "a long, b long").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    back = {r.h: r.id for r in spark.range(6000).select("id", F.xxhash64("id").alias("h")).collect()}
    classes = {}
    for r in components.components(hashed, most).collect():
        classes.setdefault(r.root, set()).add(back[r.node])
    assert {frozenset(c) for c in classes.values()} == {frozenset(c) for c in name.values()}
    assert components.components(hashed.limit(0)).count() == 0
