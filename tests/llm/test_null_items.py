"""Benchmark rows without an id, and repeated ones."""

from __future__ import annotations

import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import decontaminate  # noqa: E402

PASSAGE = " ".join(f"word{i}" for i in range(14))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(1, f"a b {PASSAGE} c"), (2, "clean text of no item"), (3, f"{PASSAGE.replace('word', 'term')} d")], "doc_id long, text string")
    bench = [(None, PASSAGE), (5, PASSAGE.replace("word", "term"))] * 20 + [(None, None), (None, "...")]
    return docs, spark.createDataFrame(bench, "item_id long, text string")


def test_items_without_id(tables):
    found = decontaminate.contamination(*tables).collect()
    got = {r.doc_id: ([(x.s, x.e) for x in r.runs], r["items"]) for r in found}
    assert got == {1: ([(2, 16)], []), 2: ([], []), 3: ([(0, 14)], ["5"])}
    assert [r.doc_id for r in decontaminate.drop_contaminated(*tables).collect()] == [2]


def test_repeated_rows_count_once(tables):
    """Each of the two passages of 14 words has five windows, whatever the number of rows; and the table is small."""
    windows = decontaminate.benchmark_windows(tables[1])
    assert windows.count() == 10
    lengths, table = decontaminate._sieve(windows, 27)
    assert set(lengths) == {10} and len(table) == 64


def test_clashing_names(spark, tables):
    """Columns of documents named like internal or new ones keep their values."""
    names = ["rid", "did", "_rid", "word", "mask", "_mask", "runs", "items", "n_words", "_runs", "_items", "_n_words", "new"]
    docs = tables[0].selectExpr("*", *(f"'mine {c}' as {c}" for c in names))
    kept = decontaminate.drop_contaminated(docs, tables[1])
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(2, "clean text of no item", *(f"mine {c}" for c in names))]
    found = decontaminate.contamination(docs, tables[1]).filter("doc_id = 1").first()
    assert found["_runs"] == "mine _runs" and found["rid"] == "mine rid" and [(x.s, x.e) for x in found["runs"]] == [(2, 16)]


def test_long_words_and_batches(spark):
    """Words and texts of any length, and texts that follow one another in a batch without a window across."""
    half = PASSAGE.split()
    rows = [(1, " ".join(half[:7])), (2, " ".join(half[7:])), (3, "x" * 3_000_000), (4, ("y" * 2000 + " ") * 700 + PASSAGE), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, PASSAGE), (2, "x" * 3_000_000)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.digest(docs, bench).collect()}
    assert got == {1: (7, 0, 0), 2: (7, 0, 0), 3: (1, 1, 1), 4: (714, 14, 1), 5: (0, 0, 0), 6: (0, 0, 0)}
