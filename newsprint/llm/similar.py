"""Near-duplicate documents by the Jaccard similarity of their shingles; SimHash and BK-trees choose what is compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.llm.common import components, docs_of, give_back, map_arrow, one_row_each, scratch, sieved, written
from newsprint.llm.simhash import BKTree, shingle_hashes, simhash_of

#: Least hashes of BANDS times ROWS orders route a document; a pair at similarity 0.8 shares a band with 0.9996.
BANDS, ROWS = 20, 5
#: At similarity 0.8 about 10 bits differ, give or take 3.
RADIUS = 24
_ORDERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """One key for every band of ROWS least hashes; none for a text without a word."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _ORDERS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def shingled(docs: DataFrame, shingle: int, grams: bool = True) -> DataFrame:
    """(doc_id, rid, node, fp, grams, keys): node stands for the set of shingle hashes, grams holds it in order, if asked for."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        import xxhash

        sets = [np.unique(shingle_hashes(t, shingle)) for t in cols["text"]]
        held = [s.tobytes() for s in sets]
        out = {
            "doc_id": cols["doc_id"],
            "rid": cols["rid"],
            "node": np.array([xxhash.xxh64_intdigest(g) for g in held], np.uint64).view(np.int64),
            "fp": np.array([simhash_of(s) for s in sets], np.uint64).view(np.int64),
            "keys": [band_hashes(s) for s in sets],
        }
        return out | {"grams": held} if grams else out

    keyed = docs_of(docs).withColumn("rid", F.xxhash64("text"))
    return map_arrow(keyed, f"doc_id long, rid long, node long, fp long, {'grams binary, ' if grams else ''}keys array<long>", rows)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets (in order, without repeats) is that at least."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _links(nodes: np.ndarray, points: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect just what all pairs alike, and within the radius, connect."""
    # Nodes of one fingerprint follow the point that stands for it: a BK-tree holds distinct points.
    distinct, first, back = np.unique(points, return_index=True, return_inverse=True)
    order = np.argsort(back, kind="stable")
    starts = np.searchsorted(back[order], np.arange(len(distinct) + 1))
    head = list(range(len(nodes)))
    a, b = [], []

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for q, p in BKTree(distinct).within(distinct, radius):
        for i, j in zip(q[q <= p].tolist(), p[q <= p].tolist(), strict=True):
            for s in order[starts[i] : starts[i + 1]].tolist():
                for t in order[starts[j] : starts[j + 1]].tolist():
                    x, y = find(s), find(t)
                    if x != y and alike(sets[s], sets[t], similarity):
                        head[max(x, y)] = min(x, y)
                        a.append(int(nodes[s]))
                        b.append(int(nodes[t]))
    return a, b


def _compared(dealt: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): links inside the cells of (cell, node, fp, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                points = np.array([fp for fp, _ in held.values()], np.int64).view(np.uint64)
                sets = [np.frombuffer(g, np.uint64) for _, g in held.values()]
                a, b = _links(np.array(list(held), np.int64), points, sets, similarity, radius)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: dict[int, tuple[int, bytes]] = {}
        last = None
        for batch in batches:
            for cell, node, fp, grams in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if cell != last:
                    yield from emit(held)
                    held, last = {}, cell
                held[node] = (fp, grams)
        yield from emit(held)
        give_back()

    return dealt.select("cell", "node", "fp", "grams").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def prefix_cells(nodes: DataFrame, sets: DataFrame, similarity: float = 0.8, shard: int = 256) -> DataFrame:
    """(cell, node): every pair of nodes (node, root) of two roots, similar enough, meets in a cell. Ids alone, no sets.

    Shingles are put in one order, the rarest among these nodes first. Of two similar sets the smaller has one of its first
    n - ceil(2s / (1 + s) * n) + 1 shingles among the first n - ceil(s * n) + 1 of the larger. Documents of one template
    that are not similar begin with shingles of their own, so they meet nowhere, however many they are. A shingle counts if
    nodes of two roots have it and one has it early; shingles of the same nodes count once. A cell of over `shard` nodes is
    dealt into parts, of which those with early nodes meet all.
    """

    def exploded(cols: dict[str, list]) -> dict[str, object]:
        held = [np.frombuffer(g, np.int64) for g in cols["grams"]]
        sizes = np.array([len(h) for h in held], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *held])
        return {"node": np.repeat(np.array(cols["node"], np.int64), sizes), "size": np.repeat(sizes, sizes), "gram": flat}

    grams = map_arrow(sets.join(nodes, "node").select("node", "grams"), "node long, size long, gram long", exploded)
    counts = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    # A group is the shingles of one text that another has too; those of its own alone come before them.
    mine = grams.join(counts, "gram").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("x"))

    def first(share: float) -> Column:
        return F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1 - (F.col("size") - F.size("x"))

    mine = mine.select("node", "x", first(similarity).cast("int").alias("late"), first(2 * similarity / (1 + similarity)).alias("early")).filter("late > 0")
    places = mine.select("node", "early", F.posexplode(F.slice("x", F.lit(1), F.col("late"))).alias("at", "x"))
    places = written(places.select("node", F.col("x.gram").alias("gram"), (F.col("at") < F.col("early")).alias("early")).join(nodes, "node"))
    live = places.groupBy("gram").agg(
        F.count(F.lit(1)).alias("m"), F.count_if("early").alias("k"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node", "early")).alias("sum")
    )
    live = written(live.filter("k > 0 and low <> high").groupBy("m", "k", "sum").agg(F.min("gram").alias("gram")))
    cells = places.join(live, "gram").withColumns({"parts": F.ceil(F.col("m") / shard), "heads": F.ceil(F.col("k") / shard)})
    small = cells.filter("parts = 1").select(F.xxhash64("gram", F.lit(0).cast("long"), F.lit(0).cast("long")).alias("cell"), "node")
    large = cells.filter("parts > 1")

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    hashed = F.xxhash64(F.lit("part"), "node")
    heads = large.filter("early").select("gram", "node", F.pmod(hashed, F.col("heads")).alias("i"), numbers("parts").alias("j"))
    all_ = large.select("gram", "node", F.pmod(hashed, F.col("parts")).alias("j"), numbers("heads").alias("i")).select("gram", "node", "i", "j")
    return small.unionByName(heads.unionByName(all_).select(F.xxhash64("gram", "i", "j").alias("cell"), "node")).distinct()


def _sets_of(prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, fp, grams) of prints with grams, for the nodes wanted and some others; repeats stay."""
    return sieved(prints.select(F.col("node").alias("lid"), "fp", "grams"), wanted.select(F.col("node").alias("lid"))).withColumnRenamed("lid", "node")


def similar_links(
    prints: DataFrame, similarity: float = 0.8, radius: int = RADIUS, shard: int = 256, first: int = 4, sets_of: Callable[[DataFrame, DataFrame], DataFrame] = _sets_of
) -> DataFrame:
    """Edges (a, b) between nodes of prints (see shingled) with the same components as all similar pairs of a bucket.

    Nodes that share a band are a bucket; buckets of the same nodes count once. The first few bands link most of what is
    similar; of the others, only buckets whose nodes are not yet one component are looked at, so a set is not sent once for
    every band. A bucket of over `shard` nodes is dealt into parts, other parts for every band. What lies in large buckets
    and is in different components after that goes by prefix_cells, which lose no pair and need no square of a bucket.
    """
    members = written(prints.select("node", F.posexplode("keys").alias("band", "key")).distinct())
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("sum"), F.min("band").alias("band")).filter("n > 1")
    buckets = written(buckets.groupBy("n", "sum").agg(F.min(F.struct("band", "key")).alias("x")).select("x.key", "x.band", "n"))
    shared = written(members.select("node", "key").join(buckets, "key"))
    wanted = written(shared.select("node").distinct())
    sets = sets_of(prints, wanted).groupBy("node").agg(F.first("fp").alias("fp"), F.first("grams").alias("grams"))
    sets = written(sets.join(wanted, "node"))

    def met(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / shard))))
        return written(_compared(dealt.select("cell", "node").join(sets, "node"), similarity, radius))

    def unsettled(links: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows, with their roots, of buckets that hold two components of links."""
        rooted = written(rows.join(written(components(links)), "node", "left").withColumn("root", F.coalesce("root", "node")))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        return rooted.join(written(mixed.select("key")), "key")

    near = met(shared.filter(F.col("band") < first))
    near = near.unionByName(met(unsettled(near, shared.filter(F.col("band") >= first))))
    large = shared.filter(F.col("n") > shard)
    if large.isEmpty():
        return near
    nodes = written(unsettled(near, large).select("node", "root").distinct())
    if nodes.isEmpty():
        return near
    cells = written(prefix_cells(nodes, sets, similarity, shard))
    return near.unionByName(written(_compared(cells.join(sets, "node"), similarity, radius)))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every class of documents, with its columns: the least by (doc_id, nulls last, hash of the text).

    Documents that share `similarity` of their shingles of `shingle` words are linked, and a class is what links connect.
    A null text is empty; texts without a word are one class; a text of fewer words is one shingle. Sets of shingles are
    not kept for all documents: those of documents that share a band with others are worked out a second time.
    """
    with scratch(docs.sparkSession):
        prints = written(shingled(docs, shingle, grams=False))

        def sets_of(_: DataFrame, wanted: DataFrame) -> DataFrame:
            texts = prints.join(wanted, "node").groupBy("node").agg(F.min("rid").alias("lid"))
            some = sieved(docs_of(docs).withColumn("lid", F.xxhash64("text")), texts)
            return shingled(some.select("doc_id", "text"), shingle).select("node", "fp", "grams")

        roots = components(similar_links(prints, similarity, sets_of=sets_of))
        rows = prints.select("doc_id", "rid", "node").join(roots, "node", "left")
        return one_row_each(docs, rows.select("doc_id", "rid", F.coalesce("root", "node").alias("root")))
