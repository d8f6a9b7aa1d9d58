"""From raw feed entries to items: which entries count, and what their columns hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.functions.dates import parse_pub_date
from newsprint.functions.text import clean_summary, decode_entities, html_to_plain, strip
from newsprint.functions.urls import is_web_link, pick_best_image, resolve_aggregator_link


def source_title(stored: Column, channel: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), channel)


def choose_body(content: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), description)


def item_id(guid: Column, link: Column) -> Column:
    return F.coalesce(F.nullif(guid, F.lit("")), link)


def valid_items(items: DataFrame) -> DataFrame:
    """Entries with a title and a link whose scheme starts with http."""
    return items.filter((F.col("title") != "") & is_web_link(F.col("link")))


def normalise_items(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items from parsed entries and the registry: one scan, one join with the (small) registry, expressions otherwise."""
    stored = feeds.select("feed_id", F.col("title").alias("feed_title"), "section")
    entries = raw.filter("pos >= 0").withColumns({"title": strip(decode_entities(F.col("title"))), "link": strip(F.col("link"))})
    body = choose_body(F.col("content"), F.col("description"))
    out = valid_items(entries).join(stored, "feed_id").withColumn("body", body)
    out = out.withColumn("link", resolve_aggregator_link(F.col("link"), F.col("body")))
    return out.select(
        "feed_id",
        item_id(F.col("guid"), F.col("link")).alias("item_id"),
        "title",
        "link",
        clean_summary(html_to_plain(F.col("body"))).alias("summary"),
        pick_best_image(F.col("images"), F.col("body")).alias("image_url"),
        parse_pub_date(F.col("published"), F.col("updated"), F.col("pub_date")).alias("published_at"),
        "section",
        source_title(F.col("feed_title"), F.col("channel_title")).alias("source_title"),
    )


def with_edition_date(items: DataFrame) -> DataFrame:
    """Items of their local day; undated ones belong to none."""
    return items.withColumn("edition_date", F.to_date("published_at")).filter(F.col("edition_date").isNotNull())


def today_filter(items: DataFrame, day: str) -> DataFrame:
    """Items published from the start of a local day to the start of the next: a range that a scan can push down."""
    start = F.lit(day).cast("date").cast("timestamp")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")
    return items.filter((F.col("published_at") >= start) & (F.col("published_at") < end))
