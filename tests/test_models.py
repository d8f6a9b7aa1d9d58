"""Operators against short sequential versions on random input, and across partitionings."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsprint.operators import classify, dedupe, editions, registry

SCHEMA = "row_id long, feed_id string, item_id string, link string, published_at timestamp, section string, image_url string, edition_date date"


def sample(spark, seed, n=160):
    from datetime import date, datetime

    rng = random.Random(seed)
    rows = [
        (
            i, f"f{rng.randrange(7)}", f"i{rng.randrange(90)}", rng.choice(["L", "l"]) + f"{rng.randrange(90)}", datetime(2024, 1, 1, rng.randrange(5), 0, 0),
            rng.choice(["b", "A", "a"]), rng.choice([None, f"u{i}"]), date(2024, 1, 1 + rng.randrange(2)),
        )
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def in_order(rows):
    return sorted(rows, key=lambda r: (-r[4].timestamp(), r[1], r[2], r[3], r[0]))


def greedy(rows):
    out = []
    for day in {r[7] for r in rows}:
        links, ids = set(), set()
        for r in in_order(x for x in rows if x[7] == day):
            if r[3].lower() not in links and r[2] not in ids:
                links.add(r[3].lower())
                ids.add(r[2])
                out.append(r)
    return out


def laps(rows):
    feeds = defaultdict(list)
    for r in in_order(rows):
        feeds[r[1]].append(r)
    out = []
    while any(feeds.values()):
        out += [f.pop(0) for f in feeds.values() if f]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 7])
def test_dedupe_and_slots(spark, seed, parts):
    rows, df = sample(spark, seed)
    kept = dedupe.dedupe_items(df.repartition(parts), tie=("row_id",))
    assert {r.row_id for r in kept.collect()} == {r[0] for r in greedy(rows)}
    ranked = editions.round_robin(kept, tie=("row_id",)).withColumn("usable", F.col("image_url").isNotNull())
    got = {(r.row_id, r.slot, r.slot_rank, r.page_no) for r in editions.slots(ranked).collect()}
    want = set()
    for day in {r[7] for r in rows}:
        order = laps([r for r in greedy(rows) if r[7] == day])
        lead = next((r for r in order if r[6]), None)
        if lead:
            want.add((lead[0], "lead", 1, 1))
            order.remove(lead)
        want |= {(r[0], "secondary", i + 1, 1) for i, r in enumerate(order[:3])} | {(r[0], "brief", i + 1, 1) for i, r in enumerate(order[3:15])}
        names = sorted({r[5] for r in order[15:]}, key=lambda s: (s.lower(), s))
        for page, name in enumerate(names):
            want |= {(r[0], "section", i + 1, page + 2) for i, r in enumerate(x for x in order[15:] if x[5] == name)}
    assert got == want


def test_dedupe_named_cases(spark):
    def ids(*triples):
        from datetime import date, datetime

        rows = [(i, "f", item, link, datetime(2024, 1, 1, 23 - i), "s", None, date(2024, 1, 1)) for i, (link, item) in enumerate(triples)]
        return sorted(r.row_id for r in dedupe.dedupe_items(spark.createDataFrame(rows, SCHEMA)).collect())

    assert ids(("l1", "i1"), ("l2", "i1"), ("l2", "i3")) == [0, 2]
    assert ids(("l1", "i1"), ("l1", "i2"), ("l3", "i2")) == [0, 2]
    assert ids(("L1", "i1"), ("l1", "i2"), ("l1?utm=1", "i3")) == [0, 2]


def test_moves_undo(spark):
    moves = [("a", 1, "x", "alpha beta gamma"), ("a", 2, "y", "alpha beta gamma"), ("b", 1, "x", "the"), ("c", 3, "z", "delta alpha")]
    last = classify.latest_corrections(spark.createDataFrame(moves, "item_id string, seq long, section string, text string"))
    counts = {(r.token, r.section): r.n for r in classify.train_token_counts(last).collect()}
    assert counts == {("alpha", "y"): 1, ("beta", "y"): 1, ("gamma", "y"): 1, ("delta", "z"): 1, ("alpha", "z"): 1}
    stats = {r.section: (r.docs, r.total_tokens) for r in classify.train_section_stats(last).collect()}
    assert stats == {"y": (1, 3), "x": (1, 0), "z": (1, 2)}
    assert classify.classifier_ready(classify.train_section_stats(last)).first().ready is False


def test_tokens(spark):
    text = "ab abc ABCD the Éclair 12abc x" + "y" * 23 + " " + "z" * 25
    got = spark.createDataFrame([(text,)], "t string").select(classify.tokenise(F.col("t"))).first()[0]
    assert got == ["abc", "abcd", "éclair", "abc", "x" + "y" * 23]


def test_predict_abstains(spark):
    counts = spark.createDataFrame([("w", s, n) for s, n in (("a", 9), ("b", 1), ("c", 1))], "token string, section string, n long")
    freq = spark.createDataFrame([("i", "w", 1), ("j", "other", 5)], "item_id string, token string, n long")
    for docs, want in ((3, Counter(["i"])), (2, Counter())):
        stats = spark.createDataFrame([(s, docs, 9) for s in "abc"], "section string, docs long, total_tokens long")
        assert Counter(r.item_id for r in classify.nb_predict(freq, counts, stats).collect()) == want


def test_health_edges(spark):
    from datetime import datetime

    feeds = spark.createDataFrame([(f, f == "paused") for f in ("never", "ok", "new", "old", "edge", "no", "paused")], "feed_id string, is_paused boolean")
    log = [("ok", 1, False), ("ok", 2, True), ("new", 20, True), ("new", 25, False), ("old", 1, True), ("old", 25, False), ("edge", 10, True), ("edge", 25, False), ("no", 25, False), ("paused", 3, False)]
    rows = spark.createDataFrame([(f, datetime(2024, 1, d), ok) for f, d, ok in log], "feed_id string, ts timestamp, ok boolean")
    got = {r.feed_id: r.health for r in registry.feed_health(feeds, registry.fetch_state(rows), "2024-02-09 00:00:00").collect()}
    assert got == {"never": "healthy", "ok": "healthy", "new": "recent", "old": "stale", "edge": "stale", "no": "stale", "paused": None}


def test_validated_lead(spark):
    from datetime import date, datetime

    def lead(n, good):
        rows = [(i, f"f{i}", f"i{i}", f"l{i}", datetime(2024, 1, 1, 23, 59 - i), "s", f"u{i}", date(2024, 1, 1)) for i in range(n)]
        ranked = editions.round_robin(spark.createDataFrame(rows, SCHEMA), tie=("row_id",))
        checks = spark.createDataFrame([(f"u{i}", 200 if i in good else 404, 64, 64, 1.0) for i in range(n)], "url string, status int, width int, height int, elapsed_s double")
        got = ranked.join(editions.validated_lead(ranked, checks), ["edition_date", "rr"], "left_semi").collect()
        return [r.row_id for r in got]

    assert lead(3, {0, 1}) == [0] and lead(3, {1}) == [1] and lead(3, set()) == []
    assert lead(12, set()) == [8] and lead(12, {7}) == [7] and lead(12, {10}) == [8]
