"""The refresh: feed documents to a published edition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint.operators import editions, pages
from newsprint.operators.dedupe import KEYS, carry_over, dedupe_items
from newsprint.operators.items import normalise_items, with_edition_date
from newsprint.operators.registry import active_feeds
from newsprint.session import cut
from newsprint.sources.feeds import parse_feed_documents


def enrich_images(items: DataFrame, crawl: DataFrame, k: int = 24, run_keys: tuple[str, ...] = (), tie: tuple[str, ...] = ("feed_id", "item_id", "link")) -> DataFrame:
    """Of the k newest items of a refresh (before any choice of day), those without an image get their page's.

    The pages table meets only the links of these items: at most k rows a run stand on the small side.
    """
    newest = cut(editions.top_k_newest(items, k, run_keys, tie).select(*dict.fromkeys(("link", "image_url", *run_keys, *tie))))
    chosen = newest.filter("image_url is null").select("link").distinct()
    named = crawl.select(F.col("url").alias("link"), "html").join(chosen, "link").groupBy("link").agg(F.min("html").alias("html"))
    found = named.select("link", pages.og_image(F.col("html"), F.col("link")).alias("og"))
    top = newest.select(*run_keys, *tie).distinct().withColumn("in_budget", F.lit(True))
    out = items.join(top, [*run_keys, *tie], "left").join(found, "link", "left")
    return out.withColumn("image_url", F.when(F.col("in_budget"), F.coalesce("image_url", "og")).otherwise(F.col("image_url"))).drop("og", "in_budget")


def place(items: DataFrame, checks: DataFrame | None = None, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = (), validate: bool = False) -> DataFrame:
    """Deduped, interleaved items in their slots. `usable` says whether an image may lead. Undated items are in no edition."""
    kept = dedupe_items(items.dropna(subset=list(keys)), keys, tie)
    ranked = editions.round_robin(kept, keys, tie)
    if checks is None:
        ranked = ranked.withColumn("usable", F.col("image_url").isNotNull())
    else:
        ranked = editions.usable_image(ranked, checks)
    ranked = cut(ranked)
    leads = editions.validated_lead(ranked, checks, keys) if validate and checks is not None else None
    return editions.slots(ranked, keys, leads)


def refresh(feeds: DataFrame, docs: DataFrame, prior: DataFrame, crawl: DataFrame, checks: DataFrame) -> DataFrame:
    """Feed documents (feed_id, body) of one run to placed items of every day they touch."""
    live = docs.join(active_feeds(feeds).select("feed_id"), "feed_id", "left_semi")
    fresh = normalise_items(parse_feed_documents(live), feeds)
    merged = enrich_images(carry_over(fresh, prior, feeds), crawl)
    return place(with_edition_date(merged), checks, validate=True)
