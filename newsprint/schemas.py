"""Explicit schemas of the tables that the jobs read."""

from __future__ import annotations

FEEDS = (
    "feed_id string, url string, section string, title string, last_seen_item_ids array<string>, is_paused boolean, "
    "last_success_at timestamp, last_failure_at timestamp"
)
FEED_DOCS = (
    "feed_id string, url string, final_url string, fetched_at timestamp, status int, content_type string, body binary, error string"
)
RAW_ITEMS = (
    "feed_id string, title string, link string, guid string, description string, content string, pub_date string, updated string, "
    "published string, images array<struct<url: string, width: int>>, channel_title string, pos int, status string"
)
ITEMS = (
    "feed_id string, item_id string, title string, link string, summary string, image_url string, published_at timestamp, "
    "section string, source_title string"
)
OPML_ENTRIES = "reader_id string, pos int, url string, title string, section string"
CLASSIFIER_STATE = (
    "tokenCounts map<string, map<string, int>>, sectionTotalTokens map<string, int>, sectionDocs map<string, int>, "
    "vocabulary array<string>, pins map<string, string>"
)
