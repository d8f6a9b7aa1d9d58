"""Sharding where a third of all rows is one row, and where ids are null."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import sharding  # noqa: E402

SCHEMA = "doc_id long, text string"


def test_ranges_by_all_parts_of_a_key():
    rng = np.random.default_rng(2)
    splitters = np.array(sorted(map(tuple, rng.integers(0, 4, (40, 3)).tolist())), np.int64)
    keys = rng.integers(-1, 5, (300, 3))
    got = sharding._range_of(list(splitters.T), list(keys.T))
    assert got.tolist() == [sum(tuple(s) <= tuple(k) for s in splitters.tolist()) for k in keys.tolist()]


def test_repeated_rows_are_cut(spark):
    rows = [(7, "the same row")] * 900 + [(None, "no id at all")] * 900 + [(i, f"text {i} " + "x" * (i % 50)) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = sharding.shards(docs, ranges=64).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    crc = {zlib.crc32(t.encode()): len(t) + 1 for _, t in rows}
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        assert crc[r.text_crc32] == r.size
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(crc.values())


def test_a_repeated_row_gets_several_ranges(spark):
    rows = spark.createDataFrame([(7, 5, 100, i * 7919 % 1000) for i in range(1000)], "doc_id long, thash long, size long, salt long")
    splitters = sharding._splitters(rows, 100_000, 32, 8)
    placed = sharding._range_of(splitters, [np.full(1000, 5), np.full(1000, 7), np.arange(1000) * 7919 % 1000])
    assert len(set(placed.tolist())) > 16 and max(Counter(placed.tolist()).values()) < 200
