"""A bit table of keys, as large at most as its number of bits, however many keys there are: it goes to every task and
tells which rows can have a match, so that no other row is shuffled to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25


def _place(key: Column, bits: int) -> Column:
    return F.when(key.isNotNull(), F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1)))


def sieve(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(word, set): the bits of all keys in words of 64, which are 2 ** (bits - 6) rows at most."""
    place = _place(F.col(key), bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return keys.filter(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))


def may_match(df: DataFrame, key: Column, table: DataFrame, bits: int = BITS) -> DataFrame:
    """df with `may`: true for every key in the table (of the same type and number of bits), seldom for another, never for null."""
    place = _place(key, bits)
    met = df.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(table), "word", "left")
    return met.withColumn("may", F.coalesce(F.getbit("set", place.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))).drop("word", "set")
