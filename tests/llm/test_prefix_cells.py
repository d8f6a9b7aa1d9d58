"""Cells of rare shingles: similar sets of two roots meet, unlike sets of one template do not."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import similar  # noqa: E402


def tables(spark, sets: list[np.ndarray], roots: list[int]):
    rows = [(i, 0, np.unique(s).tobytes()) for i, s in enumerate(sets)]
    return spark.createDataFrame(list(enumerate(roots)), "node long, root long"), spark.createDataFrame(rows, "node long, fp long, grams binary")


@pytest.mark.parametrize("shard", [3, 256])
def test_similar_sets_meet(spark, shard):
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 4, 9, 40, 41, 60):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for lost in range(0, max(1, size // 4)):
            sets.append(np.concatenate([base[lost // 2 :], rng.integers(0, 1 << 63, lost, dtype=np.uint64)]))
    sets += [np.zeros(0, np.uint64)] * 2
    nodes, held = tables(spark, sets, [i // 2 for i in range(len(sets))])
    cells = defaultdict(set)
    for r in similar.prefix_cells(nodes, held, 0.8, shard).collect():
        cells[r.cell].add(r.node)
    met = {p for c in cells.values() for p in combinations(sorted(c), 2)}
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if i // 2 != j // 2 and len(sets[i]) and similar.alike(np.unique(sets[i]), np.unique(sets[j]), 0.8)}
    assert want and want <= met


def test_a_template_costs_no_square(spark):
    """Sets that share 0.82 of their shingles with all others are similar at 0.7: none of them meets another."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 82, dtype=np.uint64)
    count = {}
    for n in (200, 400):
        family = [np.concatenate([common, rng.integers(0, 1 << 63, 18, dtype=np.uint64)]) for _ in range(n)]
        near = [np.concatenate([f[:-2], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for f in family[:20]]
        nodes, held = tables(spark, family + near, list(range(n + 20)))
        cells = similar.prefix_cells(nodes, held, 0.8, 16).collect()
        groups = defaultdict(set)
        for r in cells:
            groups[r.cell].add(r.node)
        assert all(any({i, n + i} <= g for g in groups.values()) for i in range(20))
        count[n] = len(cells)
    assert count[400] <= 2 * count[200] + 20
