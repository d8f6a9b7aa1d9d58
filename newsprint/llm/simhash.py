"""Near-duplicate documents by 64-bit SimHash fingerprints, searched with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.llm.common import components, docs_of, map_arrow, one_row_each, salted_count, written

_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle: words between ASCII white space, A-Z lower-cased; fewer words are one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, max(1, len(words) - shingle + 1))


def simhash_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes; zero if there are none."""
    count = len(hashes)
    ones = np.zeros((8, 256), np.int64)
    for at in range(0, count, 1 << 16):
        lanes = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (ones @ _BITS) > count).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text's shingles; zero for a text without a word."""
    return simhash_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, rid, fp): fp is the fingerprint as a signed long, rid the hash of the text."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        fps = np.array([fingerprint(t, shingle) for t in cols["text"]], np.uint64)
        return {"doc_id": cols["doc_id"], "rid": cols["rid"], "fp": fps.view(np.int64)}

    return map_arrow(docs_of(docs).withColumn("rid", F.xxhash64("text")), "doc_id long, rid long, fp long", rows)


class BKTree:
    """A Burkhard-Keller tree over 64-bit fingerprints, held as arrays.

    A node's children are keyed by their integer Hamming distance to it. Building and searching go level by level for
    all fingerprints at once, so that the work inside a level is numpy's.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.points = points
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        # Points fall from node to node; of those that meet at an empty edge the first becomes the child.
        waiting, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        kids: list[tuple[np.ndarray, np.ndarray]] = []
        while len(waiting):
            key = at * 65 + np.bitwise_count(points[waiting] ^ points[at]).astype(np.int64)
            uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = at[first], uniq % 65
            kids.append((uniq, child))
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            at, waiting = child[back][rest], waiting[rest]
        keys = np.concatenate([k for k, _ in kids]) if kids else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.kids = (np.concatenate([c for _, c in kids]) if kids else np.zeros(0, np.int64))[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of a query, index of a point) at most radius apart, block of queries by block."""
        for block in range(0, len(queries), 256):
            q = np.arange(block, min(block + 256, len(queries)))
            at = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.points[at]).astype(np.int64)
                if (hit := d <= radius).any():
                    yield q[hit], at[hit]
                # Only edges within the radius of the distance can lead to a hit.
                lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                q = np.repeat(q, n)
                at = self.kids[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, head of its group) that connect just what links within the radius connect."""
    head = np.arange(len(points))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for q, p in BKTree(points).within(points, radius):
        roots_q, roots_p = head[q], head[p]
        for a, b in set(zip(roots_q[roots_q != roots_p].tolist(), roots_p[roots_q != roots_p].tolist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                head[max(a, b)] = min(a, b)
        head = head[head[head]]
    while (head != head[head]).any():
        head = head[head]
    out = np.flatnonzero(head != np.arange(len(points)))
    return points[out], points[head[out]]


def band_keys(fp: Column, bands: int, shared: int) -> Column:
    """One key for every choice of `shared` of the bands: fingerprints under bands - shared + 1 bits apart share one."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(bands)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in pick]) for k, pick in enumerate(combinations(range(bands), shared))])


def rest_masks(bands: int, shared: int, parts: int) -> list[list[int]]:
    """For every choice of bands (see band_keys) the bits outside of it, dealt into parts, as masks of signed longs."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    out = []
    for pick in combinations(range(bands), shared):
        rest = [bit for i in range(bands) if i not in pick for bit in range(cuts[i], cuts[i + 1])]
        out.append([int(np.array(sum(1 << bit for bit in rest[j::parts]), np.uint64).view(np.int64)) for j in range(parts)])
    return out


def links(fps: DataFrame, radius: int = 3, bands: int = 5, shard: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the same components as all links within the radius.

    Fingerprints within the radius agree wholly in at least bands - radius of the bands, so every link lies inside a
    bucket of equal band choices. A bucket is a shard with a BK-tree of its own, built where the shuffle brings it. In a
    bucket of more than `shard` fingerprints the other bits are dealt into radius + 1 parts, of which two fingerprints
    within the radius have one in common, and each part's value is a bucket of its own. What is still larger (fingerprints
    that agree in a dozen bits more) is cut into pieces, and a task gets two of them: the tree is bounded and no pair is
    left out. Trees go nowhere by broadcast, as their number grows with the corpus.
    """
    keyed = fps.select("fp", F.posexplode(band_keys(F.col("fp"), bands, bands - radius)).alias("pick", "key"))
    hot = written(salted_count(keyed, ["key"]).filter(F.col("n") > shard).select("key"))
    masks = F.array(*[F.array(*map(F.lit, m)) for m in rest_masks(bands, bands - radius, radius + 1)])
    finer = keyed.join(hot, "key").select("fp", "key", F.posexplode(F.get(masks, F.col("pick"))).alias("part", "mask"))
    finer = finer.select("fp", F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    large = written(salted_count(finer, ["key"]).filter(F.col("n") > shard).select("key", F.ceil(F.col("n") / shard).alias("parts")))
    part = F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts"))
    pieces = finer.join(large, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = pieces.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    small = keyed.join(hot, "key", "left_anti").select("fp", "key").unionByName(finer.join(large, "key", "left_anti"))
    dealt = small.withColumnRenamed("key", "cell").unionByName(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(points: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _forest(np.unique(points), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            cell, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = fp.astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
            for lo, hi in zip(starts, [*starts[1:], len(cell)], strict=True):
                if cell[lo] != last:
                    if sum(map(len, held)) > 1:
                        yield from emit(np.concatenate(held))
                    held, last = [], cell[lo]
                held.append(fp[lo:hi])
        if sum(map(len, held)) > 1:
            yield from emit(np.concatenate(held))

    return dealt.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, head, n_copies): the least linked fingerprint, the least doc_id and the rows of each fingerprint."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n_copies")))
    roots = components(links(groups.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    return groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies): classes of documents whose fingerprints link within the radius.

    component_id is the smallest doc_id reachable. n_copies counts rows of the same fingerprint. Copies meet in a
    group-by of fingerprints before any search. A null text is empty; texts without a word have fingerprint zero and are
    linked like any other. Repeated rows stay repeated. A null doc_id keeps its row and never names a component
    unless all of its members are null. An empty table gives an empty result; further columns are ignored.
    """
    prints = written(fingerprints(docs, shingle))
    named = _classes(prints, radius)
    # Both sides are written, so that the join starts from two plain shuffles, of which Spark can split a large component.
    named = written(named)
    least = written(named.groupBy("root").agg(F.min("head").alias("component_id")))
    classes = named.join(least, "root").select("fp", "component_id", "n_copies")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of every class of near_duplicates, with its columns: the least by (doc_id, nulls last, hash of the text)."""
    prints = written(fingerprints(docs, shingle))
    rows = prints.join(_classes(prints, radius).select("fp", "root"), "fp")
    return one_row_each(docs, rows.select("doc_id", "rid", "root"))
