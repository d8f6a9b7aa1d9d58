"""Importance resampling against plain sums, and its bit planes against products."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("newsprint.llm")

from newsprint.llm import resample  # noqa: E402

SCHEMA = "doc_id long, text string, weight string, RANK string, row_no long, lang string"
DATA = "/root/testdata/sf0.001"


def words_of(text, longest=1):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets=10_000, longest=1, percent=10):
    """Rows in order of score, then id, with nulls last."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in words_of(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc_id, text in docs:
        words, found = words_of(text, longest)
        weight = sum(math.floor(1000 * math.log((t[of(f)] + 1) * s_all / ((s[of(f)] + 1) * t_all))) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return Counter([(*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    out = [(i, " ".join(rng.choice(["Oil", "gas", "tax", "Österreich", "42", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([0, 3, 19, 20, 60, 400])))) for i in range(240)]
    out += [(900, None), (901, ""), (902, " .,;\n"), (903, "same " * 70_000), (None, out[4][1]), (None, None), (None, "gas " * 30)]
    return [*out, out[7], out[7], (7, "gas tax " * 20)]


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def test_resampling(spark, docs):
    df = spark.createDataFrame([(i, t, "x", "y", 3, "en") for i, t in docs], SCHEMA).repartition(5)
    target = spark.createDataFrame([(1, "oil and gas, gas"), (2, None), (None, "Österreich 42")], "item_id long, text string")
    texts = ["oil and gas, gas", None, "Österreich 42"]
    assert got(resample.digest(df, target)) == plain(docs, texts)
    full = resample.resampled(df, target, buckets=64, longest=2, percent=50)
    assert full.columns == ["doc_id", "text", "row_no", "lang", "n_features", "weight", "score", "rank"] and full.filter("row_no <> 3 or lang <> 'en'").isEmpty()
    assert got(full) == plain(docs, texts, 64, 2, 50)
    ranks = [r.rank for r in full.filter("rank is not null").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_nothing(spark, docs):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resample.digest(none, target).count() == 0
    some = spark.createDataFrame([(i, t, "x", "y", 3, "en") for i, t in docs], SCHEMA)
    assert got(resample.digest(some, target)) == plain(docs, [])


def test_planes_add_up_to_products():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (40, 1000)) * (rng.random((40, 1000)) < 0.2)
    counts[3, 7], counts[5] = 1 << 40, 0
    gain = rng.integers(-5000, 5000, 1000)
    plus, minus = (resample.bit_planes(np.maximum(x, 0)) for x in (gain, -gain))
    assert resample.weights_of(counts, plus, minus).tolist() == (counts @ gain).tolist()
    assert resample.bit_planes(np.zeros((2, 70), np.int64)).shape == (1, 2, 2)


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id % 50 as v", "id").repartition(7)
    out = resample.ranked(df, [F.col("v").desc(), F.col("id").asc()], ["v", "id"]).orderBy("rank").collect()
    want = sorted(((i % 50, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [(r.v, r.id) for r in out] == want and [r["rank"] for r in out] == list(range(1, 5001))


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = Counter(con.sql(f"select doc_id, n_features, weight, score, rank from ({resample.SQL})").fetchall())
    assert got(resample.digest(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark")))) == want
