"""The subscription registry: edits, imports, fetch state, health, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprint.functions.urls import feed_url_key, host


def active_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~F.col("is_paused"))


def fetch_state(log: DataFrame) -> DataFrame:
    """(feed_id, last_success_at, last_failure_at): a failure counts only if it is later than the last success."""
    both = log.groupBy("feed_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("won"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("lost"))
    later = F.col("won").isNull() | (F.col("lost") > F.col("won"))
    return both.select("feed_id", F.col("won").alias("last_success_at"), F.when(later, F.col("lost")).alias("last_failure_at"))


def feed_health(feeds: DataFrame, state: DataFrame, now: str, days: int = 30) -> DataFrame:
    """(feed_id, health): healthy, recent (failing, last success within `days`), stale; null for paused feeds."""
    known = feeds.join(state, "feed_id", "left")
    recent = F.col("last_success_at") > F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    status = F.when(F.col("last_failure_at").isNull(), "healthy").when(recent, "recent").otherwise("stale")
    return known.select("feed_id", F.when(~F.col("is_paused"), status).alias("health"))


def update_feed_titles(feeds: DataFrame, fetched: DataFrame) -> DataFrame:
    """A fetched title (feed_id, channel_title) replaces the stored one if it is not empty."""
    out = feeds.join(fetched.select("feed_id", "channel_title"), "feed_id", "left")
    return out.withColumn("title", F.coalesce(F.nullif("channel_title", F.lit("")), "title")).drop("channel_title")


def registry_edits(feeds: DataFrame, edits: DataFrame) -> DataFrame:
    """feeds after edits (feed_id, seq, op, value): the last pause and the last section of a feed count, removals end it.

    A section is trimmed, and a blank one is ignored.
    """
    section = F.trim(F.col("value"))
    last = edits.groupBy("feed_id").agg(
        F.max_by(F.when(F.col("op") == "pause", F.col("value")), F.when(F.col("op") == "pause", F.col("seq"))).alias("paused"),
        F.max_by(F.when(F.col("op") == "section", section), F.when((F.col("op") == "section") & (section != ""), F.col("seq"))).alias("moved"),
        F.max(F.col("op") == "remove").alias("removed"),
    )
    out = feeds.join(last, "feed_id", "left").filter(~F.coalesce("removed", F.lit(False)))
    out = out.withColumns({"is_paused": F.coalesce(F.col("paused") == "true", "is_paused"), "section": F.coalesce("moved", "section")})
    return out.drop("paused", "moved", "removed")


def import_feeds(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (pos, url, ...) whose URL key is neither registered nor earlier in the batch."""
    first = Window.partitionBy("key").orderBy("pos")
    new = candidates.withColumn("key", feed_url_key(F.col("url"))).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return new.join(registry.select(feed_url_key(F.col("url")).alias("key")).distinct(), "key", "left_anti").drop("key")


def import_summary(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """(added, skipped)."""
    added = import_feeds(registry, candidates).agg(F.count(F.lit(1)).alias("added"))
    total = candidates.agg(F.count(F.lit(1)).alias("total"))
    return added.crossJoin(total).select("added", (F.col("total") - F.col("added")).alias("skipped"))


def add_discovered_feed(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Requests (request, url, title) with already_added and label, the stored title of the feed if it is there.

    This compares lower-cased URLs as they are; the insert compares keys without the last slash. So a variant with a
    slash is reported as new and yet not inserted.
    """
    known = registry.select(F.lower("url").alias("lower_url"), F.coalesce("title", host(F.col("url"))).alias("label")).dropDuplicates(["lower_url"])
    keys = registry.select(feed_url_key(F.col("url")).alias("key")).distinct().withColumn("there", F.lit(True))
    out = found.withColumns({"lower_url": F.lower("url"), "key": feed_url_key(F.col("url"))}).join(known, "lower_url", "left").join(keys, "key", "left")
    return out.select("request", "url", F.col("label").isNotNull().alias("already_added"), "label", F.col("there").isNull().alias("inserted"))


def heal_feed_urls(feeds: DataFrame, failed: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Registry URLs after healing. failed: feed_id of unparsable documents; found: (feed_id, url) as discovered; docs:
    (url, parsed). Another URL whose document parses replaces the stored one."""
    good = docs.filter("parsed").select(F.col("url").alias("healed")).distinct()
    tried = failed.select("feed_id").distinct().join(found.select("feed_id", F.col("url").alias("healed")), "feed_id").join(good, "healed")
    out = feeds.join(tried.groupBy("feed_id").agg(F.min("healed").alias("healed")), "feed_id", "left")
    return out.withColumn("url", F.coalesce("healed", "url")).drop("healed")


def feed_search(feeds: DataFrame, term: str) -> DataFrame:
    """Feeds with a term in title, URL or section, in any case; all for a blank term."""
    term = term.strip().lower()
    if not term:
        return feeds
    hit = [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in ("title", "url", "section")]
    return feeds.filter(hit[0] | hit[1] | hit[2])


def feed_directory(feeds: DataFrame, term: str = "") -> DataFrame:
    """(section, shown, total, feeds): sections in case-insensitive order (section_rank), feeds by title."""
    shown = feed_search(feeds, term).withColumn("hit", F.lit(1)).select("feed_id", "hit")
    name = F.coalesce("title", "url")
    rows = feeds.join(shown, "feed_id", "left")
    entry = F.when(F.col("hit") == 1, F.struct(F.lower(name).alias("by"), name.alias("name"), F.col("feed_id")))
    return rows.groupBy("section").agg(
        F.count("hit").alias("shown"), F.count(F.lit(1)).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"]), "|").alias("feeds")
    )


def refresh_report(attempts: DataFrame) -> DataFrame:
    """(run, n_items, n_failures, messages, error): errors are raised to the reader only if nothing at all arrived."""
    line = F.concat(host(F.col("url")), F.lit(": "), F.col("error"))
    out = attempts.groupBy("run").agg(
        F.sum("n_items").alias("n_items"), F.count("error").alias("n_failures"), F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("messages")
    )
    return out.withColumn("error", F.when((F.col("n_items") == 0) & (F.col("n_failures") > 0), F.col("messages")))


def all_sections(feeds: DataFrame, trained: DataFrame) -> DataFrame:
    """Sections of feeds and those trained on, in case-insensitive order."""
    return feeds.select("section").union(trained.select("section")).distinct().orderBy(F.lower("section"), "section")
