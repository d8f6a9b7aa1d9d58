"""The source divergence audit against sums over all terms and pairs, and its parts at small bounds."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import divergence  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
DATA = "/root/testdata/sf0.001"


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows: list[tuple], ranks: int = 200) -> set[tuple]:
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = [w for w, k in seen.items() if k >= 3]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if seen[w] >= 3)
            counts[source] += Counter()

        def share(c: Counter, w: str, v: int = len(kept)) -> int:
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)

        whole = sum(counts.values(), Counter())
        for source, c in counts.items():
            p = {w: share(c, w) for w in kept}
            pairs = [(-sum((p[w] - share(d, w)) ** 2 // share(d, w) for w in kept), other.encode()) for other, d in counts.items() if other != source]
            terms = [(-((p[w] - share(whole, w)) ** 2 // share(whole, w)), w.encode()) for w in kept if c[w] and p[w] > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out |= {(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["Alpha", "beta", "Γάμμα", "d3lta", "épsilon", "zeta", "eta", "theta", "ΙΩΤΑ", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    out = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", "", None, "Zoë"])
        weight = rng.randrange(1, 60)
        out.append((i, " ".join(rng.choice(words[:weight]) for _ in range(rng.choice([0, 1, 5, 40]))), lang, source, "clash", 1))
    out += [(200, None, "en", "empty", None, None), (201, "1 2 3 --", "en", "numbers", None, None), (202, "only once", "xx", "a", None, None), (203, None, "xx", "b", None, None)]
    out += [out[5], out[5], (None, "Alpha beta " * 20_000, "de", "long", None, None), (None, None, None, None, None, None)]
    return out


def found(df) -> set[tuple]:
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("most,parts", [(400_000, 3), (7, 5)])
def test_divergence(spark, rows, most, parts):
    """Runs of seven postings give what one block gives."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert found(divergence.divergence(df, most=most)) == plain(rows)


def test_ranks_stop(spark, rows):
    assert found(divergence.divergence(spark.createDataFrame(rows, SCHEMA), ranks=3)) == plain(rows, 3)


def test_batches_of_a_term(spark, rows):
    """A term whose rows lie in several Arrow batches, and batches that end with a term."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(divergence.divergence(df, most=5)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(empty).count() == 0
    lone = spark.createDataFrame([(1, "a a a", "en", "s", "", 0)], SCHEMA)
    assert divergence.divergence(lone).count() == 0


def test_pairs_in_small_steps(spark):
    lists = spark.createDataFrame([("en", [f"s{i}" for i in range(40)], list(range(1, 41)), [1000 + i for i in range(40)])] * 3, "lang string, sources array<string>, counts array<long>, totals array<long>")
    sums = [{(r.source, r.item): r.value for r in divergence._together(lists, most).groupBy("source", "item").sum("value").toDF("source", "item", "value").collect()} for most in (1 << 20, 100)]
    assert sums[0] == sums[1] and len(sums[0]) == 40 * 39


def test_shares_are_exact():
    rng = random.Random(1)
    total = [rng.randrange(1, 10**15) for _ in range(500)] + [1, 2, 10**9]
    count = [rng.randrange(t) for t in total]
    want = [1 + 10**9 * (c + 1) // t for c, t in zip(count, total, strict=True)]
    assert divergence.shares(np.array(count), np.array(total)).tolist() == want


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = {tuple(r) for r in con.sql(f"select lang, source, part, item, value, rank from ({divergence.SQL})").fetchall()}
    assert found(divergence.divergence(spark.read.parquet(f"{DATA}/documents.parquet"))) == want
