"""From raw documents to packed training sequences, in five stages that are each written before the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsprint.llm import decontaminate, lines, packing, quality, similar
from newsprint.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every class of equal or nearly equal lines stays once; documents without a line left go."""
    return lines.keep_first_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of texts that share 0.8 of their five-word shingles stays."""
    return similar.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: Models, edit distances and tokens are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
