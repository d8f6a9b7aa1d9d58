"""Embedding near-dedup: robust-pruned graphs over overlapping cluster shards, searched by range and verified in doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsprint.llm.common import components, written

#: Rows of a shard that a fit looks at, and rows that are dealt to its centres together.
_SAMPLE, _CHUNK = 2048, 8192
#: Centres a split may have, and the base of shard numbers.
_FAN = 256


def unit(vectors: list | np.ndarray | pd.Series) -> np.ndarray:
    """Rows as doubles of length 1; they are scaled first, so that no square overflows or vanishes."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _keyed(embeddings: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v, h1, h2): v is null for vectors that link with nothing; equal vectors share both hashes."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_usable(doubles), doubles).alias("v"))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _order() -> Column:
    return F.xxhash64(F.lit("order"), "node")


# Shards


def centres(x: np.ndarray, k: int, rounds: int = 8, apart: float = 0.8) -> np.ndarray:
    """Spherical k-means from spread first centres; a centre that loses all rows takes the row that fits worst.

    Of centres within a cosine of `apart` (twice the angle of a link) one stays: a group of near copies is not cut up.
    """
    found = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        found.append(int(near.argmin()))
        near = np.maximum(near, x @ x[found[-1]])
    c = x[found]
    for _ in range(rounds):
        score = x @ c.T
        own = score.argmax(axis=1)
        c = np.zeros_like(c)
        np.add.at(c, own, x)
        length = np.linalg.norm(c, axis=1)
        c[length < 1e-9] = x[score.max(axis=1).argmin()]
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    keep: list[int] = []
    for i, near in enumerate(c @ c.T):
        if not (near[keep] > apart).any():
            keep.append(i)
    return c[keep]


def _split(rows: DataFrame, most: int, overlap: int, margin: float) -> DataFrame | None:
    """rows (shard, node, v) with the shards of over `most` rows split into overlapping ones; None if there are none.

    Centres are fitted to a bounded sample of a shard and go to its rows in chunks, so no task holds a shard.
    """
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    sizes = written(sizes)
    if sizes.isEmpty():
        return None
    big = rows.join(sizes, "shard")
    part = F.pmod(_order(), F.lit(1 << 30)) < F.least(F.lit(1.0), 4.0 * _SAMPLE / F.col("n")) * (1 << 30)
    best = Window.partitionBy("shard").orderBy(_order())
    sample = big.filter(part).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= _SAMPLE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(min(_FAN, max(2, -(-3 * int(pdf["n"].iloc[0]) // most))))
        c = centres(unit(pdf["v"]), k)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "c": [list(x) for x in c]})

    fitted = written(sample.select("shard", "n", "v").groupBy("shard").applyInPandas(fit, "shard long, c array<double>"))
    chunks = F.ceil(F.col("n") / _CHUNK).cast("long")
    dealt = big.select("shard", "node", "v", F.pmod(F.xxhash64(F.lit("chunk"), "node"), chunks).alias("chunk"))
    told = fitted.join(sizes, "shard").select("shard", "c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))

    def place(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"shard": [], "node": [], "v": []})
        score = unit(left["v"]) @ np.array(sorted(map(list, right["c"]))).T
        keep = min(overlap, score.shape[1])
        at = np.argsort(-score, axis=1)[:, :keep]
        good = np.take_along_axis(score, at, axis=1)
        row, col = np.nonzero(good >= good[:, :1] - margin)
        return pd.DataFrame({"shard": int(key[0]) * (_FAN + 1) + 1 + at[row, col], "node": left["node"].to_numpy()[row], "v": left["v"].to_numpy()[row]})

    out = dealt.groupBy("shard", "chunk").cogroup(told.groupBy("shard", "chunk")).applyInPandas(place, "shard long, node long, v array<double>")
    return written(rows.join(sizes, "shard", "left_anti").select("shard", "node", "v").unionByName(out))


def homes(nodes: DataFrame, most: int = 4096, overlap: int = 3, margin: float = 0.12, levels: int = 3) -> DataFrame:
    """(node, shards): the shards of `most` rows at most in which a node is compared with others.

    A node goes to the `overlap` nearest centres that are not further off than the nearest by `margin` of cosine; shards
    that are still too large are split again. What splitting can't make smaller, a group of very many near copies, is
    dealt into blocks: each two blocks are a shard, so that every pair of the group meets.
    """
    rows = nodes.select(F.size("v").cast("long").alias("shard"), "node", "v")
    for _ in range(levels):
        split = _split(rows, most, overlap, margin)
        if split is None:
            break
        rows = split
    sizes = written(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
    blocks = F.greatest(F.lit(2), F.ceil(2.2 * F.col("n") / most)).cast("long")
    large = rows.select("shard", "node").join(sizes.filter(F.col("n") > most), "shard")
    large = large.select("shard", "node", blocks.alias("b"), F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).alias("own"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1))).filter("own <> other")
    large = large.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "node")
    small = rows.select("shard", "node").join(sizes.filter(F.col("n") <= most), "shard").select("shard", "node")
    return small.unionByName(large).groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))


# Graphs


def pruned(x: np.ndarray, candidates: int = 40, degree: int = 20, alpha: float = 1.2, block: int = 256) -> list[np.ndarray]:
    """Out-neighbours of every row: the nearest rows and some far ones, but for those that a chosen one stands for.

    Robust pruning: candidates are taken from near to far; one goes if it lies `alpha` times closer to a chosen one than
    to the row itself. The rows of a shard are few, so candidates are its exact nearest.
    """
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    k, rng = min(candidates, n - 1), np.random.default_rng(n)
    far = rng.integers(0, n, (n, 8))
    out: list[np.ndarray] = []
    for lo in range(0, n, block):
        own = np.arange(lo, min(n, lo + block))
        score = x[own] @ x.T
        score[own - lo, own] = -2
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        cand = np.concatenate([near, far[own]], axis=1)
        mine = np.take_along_axis(score, cand, axis=1)
        order = np.argsort(-mine, axis=1, kind="stable")
        cand, mine = np.take_along_axis(cand, order, axis=1), np.take_along_axis(mine, order, axis=1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * mine))
        v = x[cand]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        alive, taken = mine > -2, np.zeros_like(mine, bool)
        for t in range(cand.shape[1]):
            now = alive[:, t] & (taken.sum(axis=1) < degree)
            taken[:, t] = now
            alive &= ~(now[:, None] & (alpha * apart[:, t] <= dist))
        out += [np.unique(cand[i][taken[i]]) for i in range(len(own))]
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"node": node, "near": [node[i] for i in pruned(unit(pdf["v"]))]})


def _csr(node: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside a shard in both directions, as starts and ends."""
    size = np.array([0 if x is None else len(x) for x in near])
    ends = np.concatenate([np.asarray(x, np.int64) for x in near if x is not None and len(x)] or [np.zeros(0, np.int64)])
    starts = np.repeat(np.arange(len(node)), size)
    at = np.minimum(np.searchsorted(node, ends), len(node) - 1)
    here = node[at] == ends
    pairs = np.unique(np.concatenate([starts[here] * len(node) + at[here], at[here] * len(node) + starts[here]]))
    return np.searchsorted(pairs // len(node), np.arange(len(node) + 1)), pairs % len(node)


def search(x: np.ndarray, first: np.ndarray, ends: np.ndarray, queries: np.ndarray, least: float, slack: float = 0.06, hops: int = 16) -> np.ndarray:
    """Which rows each query (a row itself) finds at a cosine of `least` or more, over the graph.

    Greedy search walks from the medoid, `hops` steps of the best row not yet expanded. Then the range expands: all rows
    found within least - slack, the query's own place among them, are expanded until no new one turns up.
    """
    n, q = len(x), x[queries]
    seen = np.full((len(queries), n), -2.0)
    done = np.zeros((len(queries), n), bool)
    rows = np.arange(len(queries))

    def look(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of places that a query has not looked at yet."""
        size = first[at + 1] - first[at]
        row = np.repeat(row, size)
        at = ends[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        pair = np.unique((row * n + at)[seen[row, at] == -2.0])
        row, at = pair // n, pair % n
        seen[row, at] = np.einsum("ij,ij->i", q[row], x[at])
        return row, at

    medoid = int((x @ x.sum(axis=0)).argmax())
    seen[:, medoid] = q @ x[medoid]
    for _ in range(hops):
        best = np.where(done, -3.0, seen).argmax(axis=1)
        live = ~done[rows, best] & (seen[rows, best] > -2.0)
        done[rows[live], best[live]] = True
        look(rows[live], best[live])
    seen[rows, queries] = 1.0
    row, at = np.nonzero((seen >= least - slack) & ~done)
    while len(row):
        found = []
        for lo in range(0, len(row), 20_000):
            done[row[lo : lo + 20_000], at[lo : lo + 20_000]] = True
            found.append(look(row[lo : lo + 20_000], at[lo : lo + 20_000]))
        row, at = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        near = seen[row, at] >= least - slack
        row, at = row[near], at[near]
    hits = seen >= least
    hits[rows, queries] = False
    return hits


def _roots(n: int, hits: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    a, b = np.nonzero(hits)
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, weight = pdf["node"].to_numpy(), pdf["m"].to_numpy()
        x, shard = unit(pdf["v"]), int(pdf["shard"].iloc[0])
        first, ends = _csr(node, list(pdf["near"]))
        hits = np.concatenate([search(x, first, ends, np.arange(lo, min(len(node), lo + 256)), least) for lo in range(0, len(node), 256)])
        hits |= hits.T
        some = np.flatnonzero(hits.any(axis=1))
        root = _roots(len(node), hits)
        # A pair counts in the first of the shards that both its rows are in.
        homes = [[s for s in pdf["shards"].iloc[i] if s < shard] for i in some]
        known = {s: i for i, s in enumerate(sorted({s for h in homes for s in h}))}
        before = np.zeros((len(some), max(1, len(known))), np.float32)
        for i, h in enumerate(homes):
            before[i, [known[s] for s in h]] = 1
        links = np.zeros(len(some), np.int64)
        for lo in range(0, len(some), 256):
            own = hits[np.ix_(some[lo : lo + 256], some)] & (before[lo : lo + 256] @ before.T == 0)
            links[lo : lo + 256] = own @ weight[some]
        return pd.DataFrame({"node": node[some], "links": links, "root": node[root[some]]})

    return run


def linked(nodes: DataFrame, least: float = 0.95, most: int = 4096, overlap: int = 3, margin: float = 0.12) -> DataFrame:
    """(node, links, root), a row for each node and shard with links: links counts rows of other nodes, each pair once
    over all shards, and root is a node that is linked with it, directly or not."""
    found = written(homes(nodes, most, overlap, margin))
    placed = written(nodes.join(found, "node").select("node", "v", "m", "shards", F.explode("shards").alias("shard")))
    graph = placed.select("shard", "node", "v").groupBy("shard").applyInPandas(_build, "node long, near array<long>")
    union = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    told = placed.join(union, "node")
    return written(told.groupBy("shard").applyInPandas(_links(least), "node long, links long, root long"))


def audited(nodes: DataFrame, links: DataFrame, least: float, queries: int = 1024) -> float:
    """Share of the links of `queries` nodes (those of least hash of their number) that links has, by brute force.

    The queries are bounded, so they go to every task; each node is compared with all of them, and sums come back.
    """
    asked = nodes.orderBy(_order()).limit(queries).select("node", "v", "m").toPandas()
    if asked.empty:
        return 1.0
    sides = {d: (g["node"].to_numpy(), unit(g["v"])) for d, g in asked.groupby(asked["v"].map(len))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true: dict[int, int] = {}
        for batch in batches:
            rows = batch.to_pandas()
            for d, g in rows.groupby(rows["v"].map(len)):
                if d in sides:
                    for lo in range(0, len(g), 2048):
                        some = g.iloc[lo : lo + 2048]
                        near = sides[d][1] @ unit(some["v"]).T >= least
                        near &= sides[d][0][:, None] != some["node"].to_numpy()[None]
                        for node, n in zip(sides[d][0].tolist(), (near @ some["m"].to_numpy()).tolist(), strict=True):
                            if n:
                                true[node] = true.get(node, 0) + n
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(true), pa.int64()), "true": pa.array(list(true.values()), pa.int64())})

    true = nodes.select("node", "v", "m").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = links.groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(got, "node", "left").agg(F.sum("true"), F.sum(F.least(F.col("true"), F.coalesce("links", F.lit(0))))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def near_duplicates(
    embeddings: DataFrame, least: float = 0.95, most: int = 4096, overlap: int = 3, margin: float = 0.12, wanted: float = 0.98, refuse: float = 0.9, vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector: links of a cosine of `least` or more, and their classes.

    Different vectors are nodes, whatever the number of their copies. Nodes are dealt to overlapping shards around
    centres; in each shard every node gets neighbours by robust pruning; the lists of a node from all of its shards are
    united; each node then searches the graph of its shards by range, and what it finds is a link if the cosine of the
    vectors, in doubles, says so. Shards send a row for each linked node: its links, which count in one shard of a pair
    only, and the least node that it reaches. So no pair leaves a task.

    The search may miss links where shards do not overlap. Its recall is measured on 1024 nodes against all others: under
    `wanted` the shards are made to overlap twice as much and searched anew, once; under `refuse` it raises.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of different
    lengths don't link. component_id is the smallest vec_id reachable, and kept tells whether it is the vector's own; a
    null vec_id is none, so a class of null ids alone has a null component_id, and is kept. Rows alike in vec_id and vector
    are vectors by themselves. Only vec_id and the vector are read; an empty table gives an empty result.
    """
    keyed = written(_keyed(embeddings, vector))
    pair = ["h1", "h2"]
    nodes = keyed.filter("v is not null").groupBy(*pair).agg(F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    plain = nodes.select("node", "v", "m")
    links = linked(plain, least, most, overlap, margin)
    recall = audited(plain, links, least)
    if recall < wanted:
        links = linked(plain, least, most, 2 * overlap, 2 * margin)
        recall = audited(plain, links, least)
    if recall < refuse:
        raise RuntimeError(f"the graph finds {recall:.3f} of the links; let shards overlap more")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = written(nodes.drop("v").join(sums, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    told = known.join(written(lowest), "root").select(*pair, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    near = keyed.filter("v is not null").select("vec_id", *pair).join(written(told), pair)
    alone = keyed.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = near.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
