"""Tables of a scope go with it, those that are kept stay; shuffle files go with the write that made them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsprint.llm import lines, packing, similar
from newsprint.llm.common import scratch, shared_dir, written

DOCS = [(i, f"the same line of text in each of the documents here\nand line number {i} of them with {i * i} at its end") for i in range(20)]


def _tables(spark) -> set[str]:
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir() and len(p.name) == 32}


def test_a_scope_deletes_its_tables_but_those_kept(spark):
    before = _tables(spark)
    with scratch(spark):
        outer = written(spark.range(3))
        with scratch(spark):
            inner = written(outer.withColumn("x", F.col("id") + 1))
            kept = written(inner, keep=True)
            assert len(_tables(spark) - before) == 3
        assert len(_tables(spark) - before) == 2
        assert sorted(r.x for r in kept.collect()) == [1, 2, 3]
    assert _tables(spark) == before
    last = written(spark.range(2), keep=True)
    assert last.count() == 2 and len(_tables(spark) - before) == 1


def test_a_scope_that_fails_deletes_its_tables(spark):
    before = _tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(spark.range(3))
        raise ZeroDivisionError
    assert _tables(spark) == before


@pytest.mark.parametrize("stage", [similar.keep_one, lines.keep_first_lines, packing.pack])
def test_stages_leave_one_table_and_their_result_can_be_read_twice(spark, stage):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    before = _tables(spark)
    out = stage(docs)
    assert len(_tables(spark) - before) == 1
    first = sorted(map(str, out.collect()))
    assert first and sorted(map(str, out.collect())) == first


def test_the_setting_for_shuffle_files_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    assert spark.conf.get(name, None) == before
