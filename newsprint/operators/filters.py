"""A reader's filters: semi and anti joins on feeds, hosts and read items, and the section an item goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint.functions.urls import normalized_host


def drop_paused(items: DataFrame, feeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by: columns, such as reader_id, that both tables have, if every reader has feeds of their own (likewise below)."""
    return items.join(feeds.filter("is_paused").select(*by, "feed_id"), [*by, "feed_id"], "left_anti")


def drop_removed_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items whose feed still exists, paused or not."""
    return items.join(feeds.select("feed_id"), "feed_id", "left_semi")


def drop_excluded_hosts(items: DataFrame, hosts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Items of a host that is not excluded; items without a host stay."""
    out = items.withColumn("host", normalized_host(F.col("link")))
    return out.join(hosts.select(*by, "host").distinct(), [*by, "host"], "left_anti").drop("host")


def hide_read(items: DataFrame, read: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    return items.join(read.select(*keys).distinct(), list(keys), "left_anti")


def read_flag(items: DataFrame, read: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    known = read.select(*keys).distinct().withColumn("is_read", F.lit(True))
    return items.join(known, list(keys), "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))


def read_state(log: DataFrame) -> DataFrame:
    """(reader_id, item_id) read at the end of a log (reader_id, item_id, op, seq) of read, unread and clear."""
    cleared = log.filter("op = 'clear'").groupBy("reader_id").agg(F.max("seq").alias("cleared"))
    last = log.filter("op <> 'clear'").groupBy("reader_id", "item_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    out = last.join(cleared, "reader_id", "left").filter((F.col("op") == "read") & (F.col("seq") > F.coalesce("cleared", F.lit(-1))))
    return out.select("reader_id", "item_id")


def resolve_section(items: DataFrame, pins: DataFrame, predicted: DataFrame, feeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """section: the pin, else a confident prediction, else the feed's section now, else the item's own."""
    out = items.join(pins.select(*by, "item_id", F.col("section").alias("pin")), [*by, "item_id"], "left")
    out = out.join(predicted.select(*by, "item_id", F.col("section").alias("guess")), [*by, "item_id"], "left")
    out = out.join(feeds.select(*by, "feed_id", F.col("section").alias("feed_section")), [*by, "feed_id"], "left")
    return out.withColumn("section", F.coalesce("pin", "guess", "feed_section", "section")).drop("pin", "guess", "feed_section")
