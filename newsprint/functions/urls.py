"""URL columns: hosts, keys, kinds of links, targets behind aggregators."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

#: Hosts whose links lead to discussions, not to articles.
AGGREGATORS = (
    "news.ycombinator.com", "hn.algolia.com", "hnrss.org", "lobste.rs", "reddit.com", "www.reddit.com", "old.reddit.com",
    "slashdot.org",
)
VIDEO_EXTENSIONS = ("mp4", "m4v", "mov", "webm")


def host(url: Column) -> Column:
    """Lower-cased host; empty if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def normalized_host(url: Column) -> Column:
    """Host without one leading www.; null if there is none."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def feed_url_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/$", "")


def is_web_link(link: Column) -> Column:
    """Whether the scheme starts with http, in lower case."""
    return link.rlike("^http[A-Za-z0-9+.-]*:")


def normalise_user_url(typed: Column) -> Column:
    """What a reader typed as a URL; null if it is none."""
    text = F.trim(typed)
    url = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(url.rlike(r"^https?://[^/?#\s:]+[^\s]*$"), url)


def _parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")


def youtube_id(url: Column) -> Column:
    parts = _parts(url)
    query = F.regexp_extract(F.regexp_extract(url, _QUERY, 1), "(?:^|&)v=([^&]*)", 1)
    place = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(parts, F.lit(k)), F.lit(0)) for k in ("embed", "shorts", "v")])))
    after = F.when(place.isNotNull(), F.get(parts, place.cast("int")))
    short = F.get(parts, F.lit(0))
    return F.when(host(url).endswith("youtu.be"), short).otherwise(F.coalesce(F.nullif(F.try_url_decode(query), F.lit("")), after))


def vimeo_id(url: Column) -> Column:
    numbers = F.filter(_parts(url), lambda p: p.rlike("^[0-9]+$"))
    return F.try_element_at(numbers, F.lit(-1))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(url, _PATH, 1), r"\.([^./]+)$", 1))


def link_kind(url: Column) -> Column:
    """pdf, video or article."""
    at = host(url)
    tube = (at.contains("youtube.com") | (at == "youtu.be") | at.endswith(".youtu.be")) & youtube_id(url).isNotNull()
    vimeo = at.contains("vimeo.com") & vimeo_id(url).isNotNull()
    kind = extension(url)
    return F.when(kind == "pdf", "pdf").when(kind.isin(*VIDEO_EXTENSIONS) | tube | vimeo, "video").otherwise("article")


def is_aggregator(at: Column) -> Column:
    return at.isin(*AGGREGATORS) | at.endswith(".reddit.com")


def resolve_aggregator_link(link: Column, body: Column) -> Column:
    """For a discussion's link the first external link of the body, if it has one."""
    hrefs = F.regexp_extract_all(body, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    outside = F.filter(hrefs, lambda h: h.rlike("^https?:") & (host(h) != "") & ~is_aggregator(host(h)))
    return F.when(is_aggregator(host(link)), F.coalesce(F.get(outside, F.lit(0)), link)).otherwise(link)


def first_image(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))


def pick_best_image(candidates: Column, body: Column) -> Column:
    """The widest candidate (the first of several) if its width is unknown or 400 at least; else the body's first image."""
    widest = F.array_max(F.transform(candidates, lambda c: c["width"]))
    best = F.get(F.filter(candidates, lambda c: c["width"] == widest), F.lit(0))
    good = (widest == 0) | (widest >= 400)
    return F.coalesce(F.when(good, best["url"]), first_image(body))


def _resolve(base: pd.Series, url: pd.Series) -> pd.Series:
    def one(b: str | None, u: str | None) -> str | None:
        try:
            return None if u is None else urljoin(b or "", u)
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, url, strict=True)], dtype=object)


def url_join(base: Column, url: Column) -> Column:
    """A reference resolved against its page. Only references without a scheme pass through Python."""
    absolute = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute, url).otherwise(F.pandas_udf(_resolve, "string")(base, F.when(~absolute, url)))
