"""Crawled pages: feed discovery, lead images, titles and metadata, by expressions over the markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprint.functions.text import inner_text, squeeze, strip, text_similarity
from newsprint.functions.urls import url_join

#: Paths tried in this order on sites that name no feed.
FALLBACK_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml", "/feeds/posts/default")

#: Patterns of lead images in order, and the group that holds the URL.
IMAGE_PATTERNS = (
    (r"""(?i)<meta[^>]+property=["']og:image(?::secure_url|:url)?["'][^>]+content=["']([^"']+)["']""", 1),
    (r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image(?::secure_url|:url)?["']""", 1),
    (r"""(?i)<meta[^>]+name=["']twitter:image(?::src)?["'][^>]+content=["']([^"']+)["']""", 1),
    (r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']twitter:image(?::src)?["']""", 1),
    (r"""(?i)<link[^>]+rel=["']image_src["'][^>]+href=["']([^"']+)["']""", 1),
)

#: Names of meta values for each field, the first that is there counts.
META_FIELDS = {
    "title": ("dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title", "parsely-title"),
    "byline": ("dc:creator", "dcterm:creator", "author", "parsely-author"),
    "excerpt": (
        "dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description",
        "twitter:description",
    ),
    "site_name": ("og:site_name",),
    "published_time": ("article:published_time", "parsely-pub-date"),
}
_PROPERTY = r"(?i)\s*(article|dc|dcterm|og|twitter)\s*:\s*(author|creator|description|published_time|title|site_name)\s*"
_NAME = r"(?i)^\s*(?:(dc|dcterm|og|twitter|parsely|weibo:(article|webpage))\s*[-\.:]\s*)?(author|creator|pub-date|description|title|site_name)\s*$"
#: Schema.org types that are articles (the pattern as it stands: only its ends are anchored).
ARTICLE_TYPES = (
    "^Article|AdvertiserContentArticle|NewsArticle|AnalysisNewsArticle|AskPublicNewsArticle|BackgroundNewsArticle|OpinionNewsArticle"
    "|ReportageNewsArticle|ReviewNewsArticle|Report|SatiricalArticle|ScholarlyArticle|MedicalScholarlyArticle|SocialMediaPosting|BlogPosting"
    "|LiveBlogPosting|DiscussionForumPosting|TechArticle|APIReference$"
)


def head_of(html: Column) -> Column:
    """What stands before </head>; all of it if there is none."""
    at = F.instr(F.lower(html), "</head>")
    return F.when(at > 0, F.substring(html, F.lit(1), at - 1)).otherwise(html)


def sniff_feed(body: Column) -> Column:
    start = F.lower(F.substring(body, 1, 2048))
    return start.contains("<rss") | start.contains("<feed")


def feed_title_sniff(body: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(F.substring(body, 1, 8192), "(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value: double-quoted, else single-quoted, else bare; null if it is absent."""
    forms = (f'(?i){name}\\s*=\\s*"([^"]*)"', f"(?i){name}\\s*=\\s*'([^']*)'", f"(?i){name}\\s*=\\s*([^\\s>]+)")
    return F.coalesce(*[F.when(tag.rlike(p), F.regexp_extract(tag, p, 1)) for p in forms])


def discover_feeds(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, ord, url, title) of the feeds a page's head links to, each once and in order."""
    tags = F.regexp_extract_all(head_of(F.col("html")), F.lit(r"(?is)<link\s+([^>]*?)/?>"), F.lit(1))
    links = pages.select(page, F.col("url").alias("base"), F.posexplode(tags).alias("ord", "tag"))
    low = F.lower("tag")
    links = links.filter(low.contains("alternate") & (low.contains("application/rss+xml") | low.contains("application/atom+xml")))
    links = links.withColumns({"href": attribute(F.col("tag"), "href"), "title": attribute(F.col("tag"), "title")}).filter("href is not null")
    found = links.withColumn("url", url_join(F.col("base"), F.col("href"))).filter("url is not null")
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy(page, "url").orderBy("ord"))).filter("rn = 1")
    return first.select(page, "ord", "url", "title")


def discover_fallback(pages: DataFrame, crawl: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, ord, url, title): the first fallback path whose crawled body is a feed. crawl: (url, body).

    Only bodies that are feeds take part in the join; the eight probes of a page meet them by URL.
    """
    feeds = crawl.filter(sniff_feed(F.col("body"))).select("url", feed_title_sniff(F.col("body")).alias("title"))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    paths = F.posexplode(F.array(*map(F.lit, FALLBACK_PATHS))).alias("ord", "path")
    probes = pages.select(page, root.alias("root"), paths).select(page, "ord", F.concat("root", "path").alias("url"))
    hits = probes.join(feeds, "url").groupBy(page).agg(F.min_by(F.struct("ord", "url", "title"), "ord").alias("m"))
    return hits.select(page, "m.ord", "m.url", "m.title")


def discovery_result(pages: DataFrame, crawl: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, ord, url, title): a page that is a feed is the result itself; else its links; else the fallback."""
    own = pages.filter(sniff_feed(F.col("html"))).select(page, F.lit(0).alias("ord"), "url", feed_title_sniff(F.col("html")).alias("title"))
    others = pages.filter(~sniff_feed(F.col("html")))
    links = discover_feeds(others, page)
    rest = discover_fallback(others.join(links.select(page).distinct(), page, "left_anti"), crawl, page)
    return own.unionByName(links).unionByName(rest)


def og_image(html: Column, base: Column, bytes_: int = 32_768) -> Column:
    """The lead image that the head names, as an http(s) URL."""
    head = head_of(F.substring(html, 1, bytes_))
    found = []
    for pattern, group in IMAGE_PATTERNS:
        raw = F.trim(F.regexp_extract(head, pattern, group))
        url = url_join(base, F.when((raw != "") & ~raw.startswith(":"), raw))
        found.append(F.when(url.rlike("^https?:"), url))
    return F.coalesce(*found)


def unescape(text: Column) -> Column:
    """Five named entities; the numeric ones of one byte are left to the parser."""
    out = text
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def meta_values(html: Column) -> Column:
    """A map from names to contents of a page's meta tags; of a repeated name the last counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))

    def entry(tag: Column) -> Column:
        prop, name = attribute(tag, r"\bproperty"), attribute(tag, r"\bname")
        by_property = F.regexp_replace(F.lower(F.regexp_extract(prop, _PROPERTY, 0)), r"\s", "")
        by_name = F.replace(F.regexp_replace(F.lower(name), r"\s", ""), F.lit("."), F.lit(":"))
        key = F.when(prop.rlike(_PROPERTY), by_property).when(name.rlike(_NAME), by_name)
        return F.struct(key.alias("k"), F.trim(attribute(tag, r"\bcontent")).alias("v"))

    good = F.filter(F.transform(tags, entry), lambda e: e["k"].isNotNull() & (e["v"] != ""))
    # The last value of a name wins, whatever the session's policy for repeated keys is.
    last = F.aggregate(
        good,
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, e: F.concat(F.filter(acc, lambda x: x["k"] != e["k"]), F.array(e)),
    )
    return F.map_from_entries(last)


def page_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


_SEP = r"\|\-–—\\/>»"


def _words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def article_title(html: Column) -> Column:
    """The page's title without the site's name, by separators, colons and headings."""
    whole = page_title(html)
    seps = rf"\s[{_SEP}]\s"
    headings = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[12]\b[^>]*>(.*?)</h[12]>"), F.lit(1)), inner_text)
    ones = F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), F.lit(1))
    cut = F.regexp_extract(whole, rf"(?s)^(.*)\s[{_SEP}]\s", 1)
    cut = F.when(_words(cut) < 3, F.regexp_replace(whole, rf"^[^{_SEP}]*[{_SEP}]", "")).otherwise(cut)
    after_last = F.regexp_extract(whole, r"(?s)^.*:(.*)$", 1)
    after_first = F.regexp_extract(whole, r"(?s)^[^:]*:(.*)$", 1)
    before = F.regexp_extract(whole, r"(?s)^([^:]*):", 1)
    colon = F.when(_words(after_last) < 3, after_first).when(_words(before) > 5, whole).otherwise(after_last)
    has_sep = whole.rlike(seps)
    title = (
        F.when(has_sep, cut)
        .when(whole.contains(": "), F.when(F.array_contains(headings, whole), whole).otherwise(colon))
        .when(((F.length(whole) > 150) | (F.length(whole) < 15)) & (F.size(ones) == 1), inner_text(F.get(ones, F.lit(0))))
        .otherwise(whole)
    )
    title = F.regexp_replace(strip(title), r"\s{2,}", " ")
    deep = has_sep & whole.rlike(r"\s[\\/>»]\s")
    fewer = _words(title) != _words(F.regexp_replace(whole, seps, "")) - 1
    return F.when((_words(title) <= 4) & (~deep | fewer), whole).otherwise(title)


def json_ld_metadata(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, title, byline, excerpt, site_name, date_published) of the first article in a page's schema.org scripts."""
    scripts = F.regexp_extract_all(F.col("html"), F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    clean = F.regexp_replace(F.regexp_replace(F.col("script"), r"^\s*<!\[CDATA\[", ""), r"\]\]>\s*$", "")
    rows = pages.select(page, article_title(F.col("html")).alias("page_title"), F.posexplode(scripts).alias("ord", "script"))
    rows = rows.withColumn("v", F.try_parse_json(clean)).filter("v is not null")
    text = lambda v, path: F.when(F.expr(f"schema_of_variant(variant_get({v}, '{path}')) = 'STRING'"), F.expr(f"try_variant_get({v}, '{path}', 'string')"))
    items = F.expr("try_variant_get(v, '$', 'array<variant>')")
    graph = F.expr("try_variant_get(v, '$[\"@graph\"]', 'array<variant>')")
    is_article = lambda x: F.coalesce(F.try_variant_get(x, '$["@type"]', "string").rlike(ARTICLE_TYPES), F.lit(False))
    context = F.coalesce(text("v", '$["@context"]'), text("v", '$["@context"]["@vocab"]'))
    inner = F.get(F.filter(items, is_article), F.lit(0))
    rows = rows.withColumn("v", F.when(items.isNotNull(), inner).otherwise(F.col("v"))).filter("v is not null")
    rows = rows.filter(context.rlike(r"^https?://schema\.org/?$"))
    from_graph = F.get(F.filter(graph, is_article), F.lit(0))
    rows = rows.withColumn("v", F.when(F.expr("try_variant_get(v, '$[\"@type\"]', 'string')").isNull() & graph.isNotNull(), from_graph).otherwise(F.col("v")))
    rows = rows.filter(is_article(F.col("v")))
    name, headline = text("v", "$.name"), text("v", "$.headline")
    near = lambda c: text_similarity(c, F.col("page_title")) > 0.75
    title = F.when(name.isNotNull() & headline.isNotNull() & (name != headline), F.when(near(headline) & ~near(name), headline).otherwise(name)).otherwise(F.trim(F.coalesce(name, headline)))
    authors = F.expr("try_variant_get(v, '$.author', 'array<variant>')")
    names = F.array_compact(F.transform(authors, lambda a: F.trim(F.try_variant_get(a, "$.name", "string"))))
    byline = F.coalesce(F.trim(text("v", "$.author.name")), F.when(F.size(names) > 0, F.array_join(names, ", ")))
    out = rows.select(
        page, "ord", title.alias("title"), byline.alias("byline"), F.trim(text("v", "$.description")).alias("excerpt"),
        F.trim(text("v", "$.publisher.name")).alias("site_name"), F.trim(text("v", "$.datePublished")).alias("date_published"),
    )
    first = out.groupBy(page).agg(F.min_by(F.struct("title", "byline", "excerpt", "site_name", "date_published"), "ord").alias("m"))
    return first.select(page, "m.*")


def page_metadata(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, title, byline, excerpt, site_name, published_time): schema.org scripts first, then meta tags, then the title.

    Only pages with a schema.org script take part in the join on the page's id.
    """
    scripted = pages.filter(F.col("html").rlike(r"(?i)application/ld\+json"))
    ld = json_ld_metadata(scripted, page).withColumnsRenamed({c: f"ld_{c}" for c in ("title", "byline", "excerpt", "site_name", "date_published")})
    out = pages.select(page, meta_values(F.col("html")).alias("m"), article_title(F.col("html")).alias("own")).join(ld, page, "left")
    value = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    pick = {f: [value(k) for k in names] for f, names in META_FIELDS.items()}
    author = value("article:author")
    pick["byline"].append(F.when(~author.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), author))
    pick["title"].append(F.col("own"))
    ld_name = {f: "ld_date_published" if f == "published_time" else f"ld_{f}" for f in META_FIELDS}
    return out.select(page, *[unescape(F.coalesce(F.nullif(F.col(ld_name[f]), F.lit("")), *pick[f])).alias(f) for f in META_FIELDS])


def paragraphs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), inner_text)


def excerpt_fallback(excerpt: Column, html: Column) -> Column:
    """The metadata's excerpt, else the text of the first paragraph."""
    return F.coalesce(F.nullif(excerpt, F.lit("")), squeeze(F.get(paragraphs(html), F.lit(0))))


def article_gate(text: Column, is_pdf: Column, least: int = 500) -> Column:
    """pdf, no_article, too_short or ok."""
    return F.when(is_pdf, "pdf").when(F.coalesce(text, F.lit("")) == "", "no_article").when(F.length(text) < least, "too_short").otherwise("ok")
