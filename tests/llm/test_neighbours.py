"""The embedding near-dedup against all pairs in doubles: odd vectors, copies, thresholds, many shards, a hot group."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import neighbours  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, node string, m long"


def near(rng, base, cosine):
    """A unit vector at that cosine of base."""
    u = rng.normal(size=len(base))
    u -= (u @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def plain(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for d in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == d]
        x = np.array([np.float32(rows[i][1]) for i in own], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, line in zip(own, x @ x.T >= least, strict=True):
            for b in np.array(own)[line]:
                if a != b:
                    links[a] += 1
                    parent[root(int(b))] = root(a)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(root(i)), r[0] == low.get(root(i))) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = [x / np.linalg.norm(x) for x in rng.normal(size=(300, 24))]
    vectors = list(base)
    for cosine in (0.9505, 0.96, 0.98, 0.999):
        vectors += [near(rng, b, cosine) for b in base[:40]]
    vectors += [near(rng, b, 0.9495) for b in base[40:80]]
    vectors += [near(rng, base[99], 0.99) for _ in range(150)]
    out = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] + [1.0] * 23, [inf] * 24, [None] + [1.0] * 23, [-0.0, 1.0] + [0.0] * 22, [0.0, 1.0] + [0.0] * 22]
    odd += [[1e-40] * 24, [3e38] * 24, [1.0, 2.0], [2.0, 4.0], [7.0], [-7.0]]
    out += [(1000 + i, v) for i, v in enumerate(odd)]
    out += [(2000 + i, out[7][1]) for i in range(30)] + [out[9], out[9], (None, out[11][1]), (None, [5.0, -1.0]), (None, None), (3, out[120][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 5) for i, v in rows], SCHEMA).repartition(3)


def test_one_shard(spark, rows):
    assert got(neighbours.near_duplicates(frame(spark, rows))) == plain(rows)


def test_many_shards(spark, rows):
    """Shards that are split, some of them more than once; nothing is found that is no link."""
    want = plain(rows)
    found = got(neighbours.near_duplicates(frame(spark, rows), most=120))
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert sum(a[1] > b[1] for a, b in zip(found, want, strict=True) if a[0] == b[0]) == 0


def test_blocks_of_a_hot_group(spark):
    """A group that no split makes smaller: all of its pairs count all the same, each once."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    base /= np.linalg.norm(base)
    rows = [(i, [float(x) for x in np.float32(near(rng, base, 0.999))]) for i in range(400)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in rows], "node long, v array<double>, m long")
    homes = neighbours.homes(nodes, 100, overlap=3, margin=0.12).collect()
    sizes = {s: sum(s in r.shards for r in homes) for s in {s for r in homes for s in r.shards}}
    assert len(homes) == 400 and max(sizes.values()) <= 130
    assert got(neighbours.near_duplicates(frame(spark, rows), most=100)) == plain(rows)


def test_nothing(spark):
    assert neighbours.near_duplicates(frame(spark, [])).count() == 0
    assert got(neighbours.near_duplicates(frame(spark, [(1, None), (None, [0.0])]))) == [(1, 0, 1, True), (None, 0, None, True)]


def test_recall_is_measured_and_refused(spark, rows, monkeypatch):
    nodes = spark.createDataFrame([(i, v, 1) for i, v in rows if i is not None and i < 600 and len(v) == 24], "node long, v array<double>, m long").dropDuplicates(["node"])
    links = neighbours.linked(nodes)
    assert neighbours.audited(nodes, links, 0.95) == 1.0
    assert 0.3 < neighbours.audited(nodes, links.filter("node % 2 = 0"), 0.95) < 0.7
    monkeypatch.setattr(neighbours, "audited", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="overlap"):
        neighbours.near_duplicates(frame(spark, rows[:50]))


def test_search_reaches_over_the_graph():
    """Chains of rows, each within range of the next only, and pairs that no direct edge joins."""
    rng = np.random.default_rng(1)
    x = neighbours.unit(rng.normal(size=(900, 32)))
    for i in range(1, 60):
        x[i] = near(rng, x[i - 1], 0.953)
    edges = neighbours.pruned(x)
    assert max(map(len, edges)) <= 20 and all(i not in e for i, e in enumerate(edges))
    first, ends = neighbours._csr(np.arange(900), [np.asarray(e) for e in edges])
    hits = neighbours.search(x, first, ends, np.arange(900), 0.95)
    want = x @ x.T >= 0.95
    np.fill_diagonal(want, False)
    assert ((hits | hits.T) == want).all() and want.sum() >= 118
