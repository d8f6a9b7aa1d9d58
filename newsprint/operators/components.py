"""Connected components of edges between numbered nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint.session import cut


def components(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); nodes that reach one another share a root.

    While there are more than `most` different edges, a round gives every node the name of its smallest neighbour, so
    that the graph shrinks by a share of its nodes, and what each name stood for is written down. The rest, which is
    bounded, is united in one task, and the names are followed back.
    """
    edges, names = edges.select("a", "b"), []
    while True:
        edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.count() <= most:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        named = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("name")))
        names.append(named)
        for end in ("a", "b"):
            edges = edges.join(named.withColumnsRenamed({"node": end, "name": f"{end}_"}), end).drop(end).withColumnRenamed(f"{end}_", end)
    found = cut(edges.coalesce(1).mapInArrow(_united, "node long, root long"))
    for named in reversed(names):
        up = named.join(found.withColumnRenamed("node", "name"), "name", "left")
        found = cut(up.select("node", F.coalesce("root", "name").alias("root")))
    return found


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array([top(x) for x in nodes], pa.int64())})
