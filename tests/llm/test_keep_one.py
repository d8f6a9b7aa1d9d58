"""One row of each SimHash class, where ids are null or repeat."""

from __future__ import annotations

from collections import Counter

import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import similar, simhash  # noqa: E402

TEXT = " ".join(f"word{i % 37}x{i}" for i in range(80))


def test_one_row_stays(spark):
    other, alone = TEXT.replace("word", "term"), TEXT.replace("word", "item")
    rows = [(None, TEXT, "a"), (None, TEXT, "b"), (7, TEXT, "c"), (7, TEXT, "c"), (7, other, "d"), (None, other, "e"), (None, alone, "f"), (None, alone, "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(7, TEXT, "c"), (7, other, "d"), (None, alone, "f")])


@pytest.mark.parametrize("keep_one", [simhash.keep_one, similar.keep_one])
def test_clashing_names_and_empty_tables(spark, keep_one):
    """Columns named like internal ones keep their values; so do repeated rows that differ in them alone."""
    names = ["key", "_key", "n", "whole", "rid", "root", "fp", "node", "grams", "_row", "_n"]
    rows = [(1, TEXT, *("a" + c for c in names)), (1, TEXT, *("b" + c for c in names)), (2, "other words here", *("c" + c for c in names)), (3, TEXT, *("d" + c for c in names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = keep_one(docs)
    assert kept.dtypes == docs.dtypes
    got = {tuple(r) for r in kept.collect()}
    assert got in ({rows[0], rows[2]}, {rows[1], rows[2]})
    assert keep_one(docs.limit(0)).collect() == []
