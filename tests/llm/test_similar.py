"""Near-duplicate documents by shingles against a plain version; what a tighter SimHash radius misses."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

import corpus_pipeline  # noqa: E402
from newsprint.llm import similar, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def prose(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def grams(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_classes(texts: list[str | None], least: float = 0.8) -> list[int]:
    sets, group = [grams(t) for t in texts], list(range(len(texts)))
    near = [[j for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= least] for i in range(len(texts))]
    while (new := [min(group[j] for j in near[i]) for i in range(len(texts))]) != group:
        group = new
    return group


def changed(words: list[str], at: list[int]) -> str:
    return " ".join(f"x{i}y" if i in at else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(11)
    out: list[str | None] = []
    for _ in range(12):
        base = prose(rng, rng.choice([40, 120, 300]))
        out.append(" ".join(base))
        for k in (1, 2, 4, 6, 8, 12, 20, 40):
            out.append(changed(base, rng.sample(range(len(base)), min(k, len(base) // 3))))
        # a few sentences in a row: similar at 0.8 to 0.97, far beyond three bits
        for part in (0.02, 0.05, 0.08):
            start = rng.randrange(len(base) // 2)
            out.append(changed(base, list(range(start, start + max(1, int(part * len(base)))))))
    return [*out, None, "", " \n ", "one two", "One  two", "one two three", "Grüße 你好"]


def test_keep_one(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    groups = plain_classes(texts)
    kept = similar.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_stage_takes_copies_of_a_few_changes(spark):
    rng = random.Random(4)
    bases = [prose(rng, 200) for _ in range(20)]
    rows = [(i, " ".join(b), "en") for i, b in enumerate(bases)]
    rows += [(100 * k + i, changed(b, [20 * k + j for j in range(3 * k)]), "en") for i, b in enumerate(bases) for k in (1, 2, 3)]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


@pytest.mark.parametrize("shard", [2, 5])
def test_parts_lose_no_link(spark, texts, shard):
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    prints = similar.written(rows.transform(similar.shingled, 5))
    of = {r.node: r.doc_id for r in prints.collect()}
    groups, want = plain_classes(texts), Counter()
    for r in prints.select("node").distinct().collect():
        want[groups[of[r.node]]] += 1
    roots = similar.components(similar.similar_links(prints, shard=shard)).groupBy("root").count().collect()
    assert sorted(r["count"] for r in roots) == sorted(n for n in want.values() if n > 1)


def test_one_row_of_repeats(spark):
    rng = random.Random(2)
    base = prose(rng, 100)
    near, other = changed(base, [50]), " ".join(prose(rng, 30))
    rows = [(None, " ".join(base), "a"), (None, " ".join(base), "b"), (7, near, "c"), (7, near, "c"), (7, other, "d"), (None, other, "e")]
    rows += [(None, "only a null id", "f"), (None, "only a null id", "f")]
    kept = similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(7, near, "c"), (7, other, "d"), (None, "only a null id", "f")])


def test_empty(spark):
    assert similar.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_band_recall():
    """Pairs of similarity 0.8 share a band, and their fingerprints lie within the radius."""
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(500):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
        bits = (simhash.simhash_of(a) ^ simhash.simhash_of(b)).bit_count()
        found += bool((similar.band_hashes(a) == similar.band_hashes(b)).any()) and bits <= similar.RADIUS
    assert found >= 498
