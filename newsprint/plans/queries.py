"""Registered queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsprint.functions import dates, text, urls
from newsprint.operators import article, classify, dedupe, editions, filters, items, pages, registry
from newsprint.plans import publish, reflow
from newsprint.plans.fixtures import VIEWS, view, with_views
from newsprint.session import cut, shared_dir
from newsprint.sources import feeds as feed_docs
from newsprint.sources import opml, store
from newsprint.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TIE = ("row_id",)
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "items_ev")


# Scalars over texts and pages


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def _nested(expr: str, pairs: tuple) -> str:
    for a, b in pairs:
        expr = "replace({}, '{}', '{}')".format(expr, a.replace("'", "''"), b.replace("'", "''"))
    return expr


_MARKED = "coalesce(text, '') || ' &amp;lt; &lt; &nbsp;&#39;&#8220;' || cast(doc_id as varchar)"
_PLAIN = f"trim(regexp_replace({_nested("regexp_replace(html, '<[^>]+>', ' ', 'g')", text.ENTITIES)}, '\\s+', ' ', 'g'))"


@query(f"select doc_id, md5({_nested(_MARKED, text.ENTITIES)}) as digest from documents")
def decode_entities(spark, sf):
    marked = F.concat("text", F.lit(" &amp;lt; &lt; &nbsp;&#39;&#8220;"), F.col("doc_id").cast("string"))
    return _documents(spark, sf).select("doc_id", F.md5(text.decode_entities(marked)).alias("digest"))


@query(f"select page_id, length({_PLAIN}) as n, md5({_PLAIN}) as digest from pages")
def html_to_plain(spark, sf):
    plain = text.html_to_plain(F.col("html"))
    return _pages(spark, sf).select("page_id", F.length(plain).cast("long").alias("n"), F.md5(plain).alias("digest"))


@query(f"select doc_id, md5({_nested("coalesce(text, '')", text.ESCAPES)}) as digest from documents")
def html_escape(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(text.html_escape(F.col("text"))).alias("digest"))


_STARTS = ("Article URL: ", "Submitted by ", "LINK: ", "link:", "see ", "the url: ", "URL: ", "")
_BEGUN = "[" + ", ".join(f"'{x}'" for x in _STARTS) + "][doc_id % 8 + 1] || coalesce(text, '')"


@query(f"select doc_id, case when regexp_matches(lower({_BEGUN}), '^({'|'.join(text.BOILERPLATE)})') then '' else md5({_BEGUN}) end as summary from documents")
def clean_summary(spark, sf):
    begun = F.concat(F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("doc_id") % 8 + 1).cast("int")), F.col("text"))
    df = _documents(spark, sf).withColumns({"begun": begun, "clean": text.clean_summary(begun)})
    return df.select("doc_id", F.when((F.col("clean") == "") & (F.col("begun") != ""), "").otherwise(F.md5("clean")).alias("summary"))


@query(
    with_views(
        """select row_id, case when row_id % 9 in (0, 1, 2, 4, 6) and event_type <> 'view' then title || ' [VIDEO]' else title end as shown
        from (select row_id, title, section as event_type from items_ev) t""",
        "items_ev",
    )
)
def display_title(spark, sf):
    """Titles of links of all kinds (see link_kind), some of which tell of a video themselves."""
    ev = events(spark, sf).drop("link").join(_case_links(spark, sf), "row_id")
    told = F.when(F.col("section") == "view", F.lit("Watch this")).otherwise(F.col("summary"))
    shown = text.display_title(F.col("title"), told, urls.link_kind(F.col("link")) == "video")
    return ev.select("row_id", shown.alias("shown"))


_TOK = "list_filter(regexp_split_to_array(lower({}), '[^A-Za-z0-9_]+'), lambda x: x <> '')"


@query(
    f"""with p as (select d.doc_id, {_TOK.format("coalesce(d.text, '')")} as a, {_TOK.format("b.text")} as b, item_id
            from documents d cross join (select count(*) as m from benchmark) c join benchmark b on d.doc_id % c.m = b.item_id % c.m)
    select doc_id, item_id, round(case when len(a) = 0 or len(b) = 0 then 0.0
        else 1 - length(array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ' ')) / length(array_to_string(b, ' ')) end, 6) as similarity from p"""
)
def text_similarity(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("b"))
    m = bench.count()
    both = _documents(spark, sf).withColumn("k", F.col("doc_id") % m).join(bench.withColumn("k", F.col("item_id") % m), "k")
    return both.select("doc_id", "item_id", F.round(text.text_similarity(F.col("text"), F.col("b")), 6).alias("similarity"))


_INNER = "regexp_replace(trim(regexp_replace({}, '<[^>]*>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)), '\\s{{2,}}', ' ', 'g')"


@query(f"select page_id, length({_INNER.format('html')}) as n, len(regexp_extract_all({_INNER.format('html')}, '{text.COMMAS}')) as commas from pages")
def inner_text_len(spark, sf):
    inner = text.inner_text(F.col("html"))
    return _pages(spark, sf).select("page_id", F.length(inner).cast("long").alias("n"), F.regexp_count(inner, F.lit(text.COMMAS)).cast("long").alias("commas"))


_PS = "regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)"


@query(
    f"""with p as (select page_id, {_INNER.format("x")} as t from (select page_id, unnest({_PS}) as x from pages) u)
    select page_id, count(*) as n, sum(1 + len(regexp_extract_all(t, '{text.COMMAS}')) + 1 + least(floor(length(t) / 100), 3))::bigint as points
    from p where length(t) >= 25 group by 1"""
)
def paragraph_score(spark, sf):
    rows = _pages(spark, sf).select("page_id", F.explode(pages.paragraphs(F.col("html"))).alias("t"))
    points = rows.select("page_id", text.paragraph_score(F.col("t")).alias("p")).filter("p is not null")
    return points.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("points"))


@query(
    f"""select page_id, round(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>'),
        lambda x: length({_INNER.format("x")}) * case when regexp_matches(x, '(?i)^<a\\b[^>]*href=["'']#[^"'']+["'']') then 0.3 else 1.0 end)) / length({_INNER.format("html")}), 6) as density
    from pages"""
)
def link_density(spark, sf):
    return _pages(spark, sf).select("page_id", F.round(text.link_density(F.col("html")), 6).alias("density"))


# URLs and dates

_HOST_SQL = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_NORM_SQL = f"nullif(regexp_replace({_HOST_SQL}, '^www\\.', ''), '')"


@query(with_views(f"select row_id, {_NORM_SQL.format('link')} as host from items_ev union all select -1 - page_id as row_id, {_NORM_SQL.format('url')} as host from pages", "items_ev"))
def normalized_host(spark, sf):
    ev = events(spark, sf).select("row_id", urls.normalized_host(F.col("link")).alias("host"))
    return ev.unionByName(_pages(spark, sf).select((-1 - F.col("page_id")).alias("row_id"), urls.normalized_host(F.col("url")).alias("host")))


@query(with_views("select feed_id, regexp_replace(lower(url), '/$', '') as key from feeds_ev", "feeds_ev"))
def feed_url_key(spark, sf):
    return view(spark, sf, "feeds_ev").select("feed_id", urls.feed_url_key(F.col("url")).alias("key"))


@query(
    """select page_id, case page_id % 4 when 0 then url when 1 then 'https://' || regexp_replace(url, '^https?://', '') when 2 then null else 'https://example.org' end as url
    from pages"""
)
def normalise_user_url(spark, sf):
    typed = F.element_at(
        F.array(F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.regexp_replace("url", "^https?://", ""), F.lit("   "), F.lit(" example.org ")),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    return _pages(spark, sf).select("page_id", urls.normalise_user_url(typed).alias("url"))


_LINKS = (
    "https://www.youtube.com/watch?v=ab%20c{}&t=1", "https://youtu.be/x{}", "https://www.youtube.com/shorts/s{}", "https://m.youtube.com/channel",
    "https://player.vimeo.com/video/{}", "https://vimeo.com/about", "https://site.example/a.b/{}.MP4?x=1", "https://site.example/doc{}.pdf", "https://site.example/{}/",
)
_LINK_SQL = "case event_id % 9 " + " ".join(f"when {i} then replace('{x}', '{{}}', cast(event_id as varchar))" for i, x in enumerate(_LINKS)) + " end"
_ID = "cast(event_id as varchar)"


@query(
    f"""select event_id as row_id, {_LINK_SQL} as link, case event_id % 9 when 3 then 'article' when 5 then 'article' when 7 then 'pdf' when 8 then 'article' else 'video' end as kind,
    case event_id % 9 when 0 then 'ab c' || {_ID} when 1 then 'x' || {_ID} when 2 then 's' || {_ID} end as youtube,
    case event_id % 9 when 4 then {_ID} when 8 then {_ID} end as vimeo from events"""
)
def link_kind(spark, sf):
    ev = events(spark, sf)
    link = F.replace(F.element_at(F.array(*map(F.lit, _LINKS)), (F.col("row_id") % 9 + 1).cast("int")), F.lit("{}"), F.col("row_id").cast("string"))
    ev = ev.select("row_id", link.alias("link"))
    return ev.select("row_id", "link", urls.link_kind(F.col("link")).alias("kind"), urls.youtube_id(F.col("link")).alias("youtube"), urls.vimeo_id(F.col("link")).alias("vimeo"))


@query(
    f"""select event_id as row_id, case event_id % 4 when 0 then 'https://news.site' || {_ID} || '.example/a' when 1 then 'https://x.reddit.com/r/' || {_ID}
    when 2 then 'http://lobste.rs/s/' || {_ID} else 'https://plain.example/' || {_ID} end as link from events"""
)
def resolve_aggregator_link(spark, sf):
    n, number = F.col("row_id") % 4, F.col("row_id").cast("string")
    link = F.when(n == 0, F.concat(F.lit("https://news.ycombinator.com/item?id="), number)).when(n == 1, F.concat(F.lit("https://x.reddit.com/r/"), number))
    link = link.when(n == 2, F.concat(F.lit("http://lobste.rs/s/"), number)).otherwise(F.concat(F.lit("https://plain.example/"), number))
    outside = F.concat(F.lit("""<a href="/rel">r</a><a HREF='https://old.reddit.com/x'>o</a><a href="https://news.site"""), number, F.lit(""".example/a">n</a>"""))
    body = F.when(n == 1, F.lit('<a href="https://hnrss.org/y">')).when(n == 2, F.lit("none")).otherwise(outside)
    return events(spark, sf).select("row_id", urls.resolve_aggregator_link(link, body).alias("link"))


@query(
    f"""select event_id as row_id, case event_id % 4 when 0 then 'w700-' || {_ID} when 1 then 'body-' || {_ID} when 2 then 'first' else null end as image from events"""
)
def pick_best_image(spark, sf):
    n, number = F.col("row_id") % 4, F.col("row_id").cast("string")

    def image(name, width):
        return F.struct(name.alias("url"), F.lit(width).alias("width"))

    sizes = F.array(image(F.lit("w140"), 140), image(F.concat(F.lit("w700-"), number), 700), image(F.lit("w460"), 460))
    unknown = F.array(image(F.lit("first"), 0), image(F.lit("second"), 0))
    images = F.when(n == 0, sizes).when(n == 2, unknown).otherwise(F.array(image(F.lit("w140"), 140)))
    body = F.when(n == 3, F.lit("<p>no image")).otherwise(F.concat(F.lit("<p><img class='x' src='body-"), number, F.lit("'>")))
    return events(spark, sf).select("row_id", urls.pick_best_image(images, body).alias("image"))


_FORMS = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'", "EEE, d MMM yyyy HH:mm 'GMT'", "yyyy-MM-dd HH:mm:ss '+0000'", "yyyy-MM-dd", "'soon'")


@query(
    """select event_id as row_id, case event_id % 8 when 7 then null when 6 then epoch(date_trunc('day', ts)) when 4 then epoch(date_trunc('minute', ts)) else floor(epoch(ts)) end::bigint as at from events"""
)
def parse_pub_date(spark, sf):
    ev = events(spark, sf).withColumn("ts", F.col("published_at").cast("timestamp"))
    form = [F.date_format("ts", f) for f in _FORMS]
    raw = F.element_at(F.array(*form), (F.col("row_id") % 8 + 1).cast("int"))
    at = dates.parse_pub_date(F.when(F.col("row_id") % 3 == 0, raw).otherwise(F.lit("")), F.lit("never"), raw)
    return ev.select("row_id", F.unix_seconds(at).alias("at"))


@query("select event_id as row_id, cast(ts as date) as edition_date from events where ts >= '2024-01-05' and ts < '2024-01-06'")
def today_filter(spark, sf):
    return items.today_filter(events(spark, sf), "2024-01-05").select("row_id", "edition_date")


@query(with_views("select row_id, case when row_id % 5 = 0 then 'Channel' else source_title end as source_title, case when row_id % 2 = 0 then 'c' else 'd' end as body, case when row_id % 3 = 0 then item_id else link end as item_id from items_ev", "items_ev"))
def source_body_and_id(spark, sf):
    ev, i = events(spark, sf), F.col("row_id")
    return ev.select(
        "row_id",
        items.source_title(F.when(i % 5 == 0, "").otherwise(F.col("source_title")), F.lit("Channel")).alias("source_title"),
        items.choose_body(F.when(i % 2 == 0, "c").otherwise(""), F.lit("d")).alias("body"),
        items.item_id(F.when(i % 3 == 0, F.col("item_id")).otherwise(""), F.col("link")).alias("item_id"),
    )


@query("select event_id as row_id from events where event_id % 4 in (0, 1)")
def valid_items(spark, sf):
    n = F.col("row_id") % 4
    link = F.when(n == 2, "mailto:x").when(n == 1, F.col("link")).when(n == 3, "HTTP://upper.example").otherwise(F.col("link"))
    return items.valid_items(events(spark, sf).withColumn("link", link)).select("row_id")


# Feed documents, OPML, registry


def _rss(docs: DataFrame) -> DataFrame:
    """A feed document for each document: an entry with its text and one with a link only."""
    body = F.concat(
        F.lit("<?xml version='1.0'?><rss><channel><title>"), text.html_escape(F.col("source")), F.lit("</title><item><title>Doc "), F.col("doc_id").cast("string"),
        F.lit("</title><link>https://docs.example/"), F.col("doc_id").cast("string"), F.lit("</link><description>"), text.html_escape(F.col("text")),
        F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><enclosure url='https://img.example/a.png' type='image/png'/></item><item><title>second</title></item></channel>"),
        F.when(F.col("doc_id") % 10 == 9, "").otherwise("</rss>"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("feed_id"), F.encode(F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), "utf-8").alias("body"))


_TRIMMED = "trim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(10) || chr(9))"


@query(
    f"""select cast(doc_id as varchar) as feed_id, -1 as pos, case when doc_id % 10 = 9 then 'malformed' else 'ok' end as status,
        case when doc_id % 10 = 9 then null else source end as channel_title, null as title, null as link, null as digest, null as n_images from documents
    union all select cast(doc_id as varchar), 0, 'ok', source, 'Doc ' || cast(doc_id as varchar), 'https://docs.example/' || cast(doc_id as varchar), md5({_TRIMMED}), 1 from documents where doc_id % 10 <> 9
    union all select cast(doc_id as varchar), 1, 'ok', source, 'second', '', md5(''), 0 from documents where doc_id % 10 <> 9"""
)
def parse_feed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    out = feed_docs.parse_feed_documents(_rss(docs))
    return out.select("feed_id", "pos", "status", "channel_title", "title", "link", F.md5("description").alias("digest"), F.when(F.col("pos") >= 0, F.size("images")).alias("n_images"))


@query(
    """select cast(doc_id as varchar) as item_id, 'https://docs.example/' || cast(doc_id as varchar) as link, source as source_title, epoch(timestamp '2024-01-01 10:00:00')::bigint as at,
        'https://img.example/a.png' as image_url from documents where doc_id % 10 <> 9"""
)
def normalise_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    registry_ = docs.select(F.col("doc_id").cast("string").alias("feed_id"), F.lit("").alias("title"), F.lit("News").alias("section"))
    out = items.normalise_items(feed_docs.parse_feed_documents(_rss(docs)), registry_)
    return out.select(F.col("feed_id").alias("item_id"), "link", "source_title", F.unix_seconds("published_at").alias("at"), "image_url")


@query("select page_id, case when page_id % 3 = 0 then null else md5(html) end as digest, page_id % 3 = 0 as is_pdf from pages")
def read_crawl_pages(spark, sf):
    n = F.col("page_id") % 3
    latin = F.encode(F.translate("html", "…–—’‘“”€œ", ""), "ISO-8859-1")
    df = _pages(spark, sf).withColumn("html", F.regexp_replace("html", "[^\\x00-\\xFF]", ""))
    body = F.when(n == 0, F.encode(F.concat(F.lit("%PDF"), F.col("html")), "UTF-8")).when(n == 1, F.encode("html", "UTF-8")).otherwise(latin)
    out = feed_docs.read_crawl_pages(df.withColumns({"body": body, "content_type": F.lit("text/html"), "original": F.col("html")}))
    same = F.when(F.col("html").isNotNull() & (F.col("html") != F.col("original")), F.lit("differs")).otherwise(F.md5("original"))
    return out.select("page_id", F.when(~F.col("is_pdf"), same).alias("digest"), "is_pdf")


SQL["read_crawl_pages"] = "select page_id, case when page_id % 3 = 0 then null else md5(regexp_replace(html, '[^\\x00-\\xFF]', '', 'g')) end as digest, page_id % 3 = 0 as is_pdf from pages"

_LABEL = "coalesce(title, nullif(lower(regexp_extract(url, '://([^/]*)', 1)), ''), url)"


@query(
    with_views(
        """select reader_id, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<opml version="2.0">' || chr(10) || '  <head>' || chr(10) || '    <title>Subscriptions</title>' || chr(10)
        || '    <dateCreated>2024-01-31T00:00:00Z</dateCreated>' || chr(10) || '  </head>' || chr(10) || '  <body>' || chr(10) || string_agg(block, '' order by lower(section), section) || '  </body>' || chr(10) || '</opml>' || chr(10)) as digest
        from b group by 1""",
        "feeds_ev",
        ctes=(
            f"""b as (select cast(user_id % 5 as varchar) as reader_id, section, '    <outline text="' || section || '" title="' || section || '">' || chr(10)
            || string_agg('      <outline type="rss" text="' || {_LABEL} || '" title="' || {_LABEL} || '" xmlUrl="' || url || '"/>' || chr(10), '' order by lower(coalesce(title, url)), url) || '    </outline>' || chr(10) as block
            from feeds_ev group by 1, 2)""",
        ),
    )
)
def export_opml(spark, sf):
    feeds = view(spark, sf, "feeds_ev").withColumn("reader_id", (F.col("user_id") % 5).cast("string"))
    return opml.export_opml(feeds, "2024-01-31T00:00:00Z").select("reader_id", F.md5("body").alias("digest"))


@query(with_views(f"select cast(user_id % 5 as varchar) as reader_id, url, {_LABEL} as title, section from feeds_ev", "feeds_ev"))
def import_opml(spark, sf):
    feeds = view(spark, sf, "feeds_ev").withColumn("reader_id", (F.col("user_id") % 5).cast("string"))
    return opml.import_opml(opml.export_opml(feeds, "2024-01-31T00:00:00Z")).select("reader_id", "url", "title", "section")


@query(with_views("select feed_id from feeds_ev where not is_paused", "feeds_ev"))
def active_feeds(spark, sf):
    return registry.active_feeds(view(spark, sf, "feeds_ev")).select("feed_id")


_STATE = "st as (select feed_id, max(case when ok then ts end) as won, max(case when not ok then ts end) as lost from fetch_log_ev group by 1)"


@query(with_views("select feed_id, epoch_us(won) as success, case when won is null or lost > won then epoch_us(lost) end as failure from st", "fetch_log_ev", ctes=(_STATE,)))
def fetch_state(spark, sf):
    out = registry.fetch_state(view(spark, sf, "fetch_log_ev"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("feed_id", micros("last_success_at").alias("success"), micros("last_failure_at").alias("failure"))


@query(
    with_views(
        """select f.feed_id, case when f.is_paused then null when st.feed_id is null or not (won is null or lost > won) or lost is null then 'healthy'
        when won > timestamp '2024-02-28 12:00:00' - interval 30 days then 'recent' else 'stale' end as health from feeds_ev f left join st on f.feed_id = st.feed_id""",
        "feeds_ev", "fetch_log_ev", ctes=(_STATE,),
    )
)
def feed_health(spark, sf):
    state = registry.fetch_state(view(spark, sf, "fetch_log_ev"))
    return registry.feed_health(view(spark, sf, "feeds_ev"), state, "2024-02-28 12:00:00")


@query(with_views("select feed_id, case when user_id % 4 = 0 then 'New ' || feed_id when user_id % 9 <> 0 then title end as title from feeds_ev", "feeds_ev"))
def update_feed_titles(spark, sf):
    feeds = view(spark, sf, "feeds_ev")
    fetched = feeds.filter("user_id % 4 < 2").select("feed_id", F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("New "), F.col("feed_id"))).otherwise(F.lit("")).alias("channel_title"))
    return registry.update_feed_titles(feeds, fetched).select("feed_id", "title")


@query(
    with_views(
        """select f.feed_id, case when e.p is not null then e.p = 'true' else is_paused end as is_paused, coalesce(e.s, section) as section from feeds_ev f
        join (select cast(user_id as varchar) as feed_id, arg_max(case when event_type = 'view' then 'true' else 'false' end, case when event_type in ('view', 'click') then event_id end) as p,
              arg_max('moved ' || floor(value)::bigint, case when event_type = 'signup' and event_id % 2 = 0 then event_id end) as s, bool_or(event_type = 'error' and value > 60) as gone
              from events group by 1) e on f.feed_id = e.feed_id where not gone""",
        "feeds_ev",
    )
)
def registry_edits(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "pause").when(kind == "signup", "section").when((kind == "error") & (F.col("value") > 60), "remove").otherwise("none")
    moved = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" moved "), F.floor("value").cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    value = F.when(kind == "signup", moved).when(kind == "view", "true").otherwise("false")
    edits = ev.select(F.col("user_id").cast("string").alias("feed_id"), F.col("event_id").alias("seq"), op.alias("op"), value.alias("value"))
    return registry.registry_edits(view(spark, sf, "feeds_ev"), edits).select("feed_id", "is_paused", "section")


_CAND = "cand as (select event_id as pos, 'https://site' || cast(user_id % 7 as varchar) || '.example/feed/' || cast(floor(value)::bigint % 200 as varchar) || case when event_id % 3 = 0 then '/' else '' end as url from events)"
_NEW = "fresh as (select c.* from (select *, row_number() over (partition by regexp_replace(lower(url), '/$', '') order by pos) as rn from cand) c where rn = 1 and regexp_replace(lower(url), '/$', '') not in (select regexp_replace(lower(url), '/$', '') from feeds_ev))"


def _candidates(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    slash = F.when(F.col("event_id") % 3 == 0, "/").otherwise("")
    url = F.concat(F.lit("https://site"), (F.col("user_id") % 7).cast("string"), F.lit(".example/feed/"), (F.floor("value") % 200).cast("string"), slash)
    return ev.select(F.col("event_id").alias("pos"), url.alias("url"))


@query(with_views("select pos, url from fresh", "feeds_ev", ctes=(_CAND, _NEW)))
def import_feeds(spark, sf):
    return registry.import_feeds(view(spark, sf, "feeds_ev"), _candidates(spark, sf)).select("pos", "url")


@query(with_views("select (select count(*) from fresh) as added, (select count(*) from cand) - (select count(*) from fresh) as skipped", "feeds_ev", ctes=(_CAND, _NEW)))
def import_summary(spark, sf):
    return registry.import_summary(view(spark, sf, "feeds_ev"), _candidates(spark, sf))


@query(
    with_views(
        """select pos as request, c.url, k.l is not null as already_added, k.l as label, s.key is null as inserted from cand c
        left join (select distinct lower(url) as u, coalesce(title, lower(regexp_extract(url, '://([^/]*)', 1))) as l from feeds_ev) k on lower(c.url) = k.u
        left join (select distinct regexp_replace(lower(url), '/$', '') as key from feeds_ev) s on regexp_replace(lower(c.url), '/$', '') = s.key""",
        "feeds_ev", ctes=(_CAND,),
    )
)
def add_discovered_feed(spark, sf):
    return registry.add_discovered_feed(view(spark, sf, "feeds_ev"), _candidates(spark, sf).withColumnRenamed("pos", "request"))


@query(with_views("select feed_id, case when user_id % 6 = 0 then 'https://new.example/' || feed_id else url end as url from feeds_ev", "feeds_ev"))
def heal_feed_urls(spark, sf):
    feeds = view(spark, sf, "feeds_ev")
    new = F.concat(F.lit("https://new.example/"), F.col("feed_id"))
    docs = feeds.select(new.alias("url"), (F.col("user_id") % 2 == 0).alias("parsed"))
    return registry.heal_feed_urls(feeds, feeds.filter("user_id % 3 = 0"), feeds.select("feed_id", new.alias("url")), docs).select("feed_id", "url")


@query(with_views("select feed_id from feeds_ev where contains(lower(coalesce(title, '')), 'd 1') or contains(lower(url), 'd 1') or contains(lower(section), 'd 1') or contains(lower(url), '/11')", "feeds_ev"))
def feed_search(spark, sf):
    feeds = view(spark, sf, "feeds_ev")
    return registry.feed_search(feeds, " D 1 ").select("feed_id").union(registry.feed_search(feeds, "/11").select("feed_id")).distinct()


@query(
    with_views(
        """select section, count(*) filter (hit) as shown, count(*) as total, string_agg(coalesce(title, url), '|' order by lower(coalesce(title, url)), coalesce(title, url), feed_id) filter (hit) as feeds
        from (select *, contains(lower(coalesce(title, '')), 'feed') as hit0, contains(lower(coalesce(title, '')), 'feed') or contains(lower(url), 'feed') as hit from feeds_ev) t group by 1""",
        "feeds_ev",
    )
)
def feed_directory(spark, sf):
    return registry.feed_directory(view(spark, sf, "feeds_ev"), "feed")


@query(
    with_views(
        """select strftime(run, '%Y-%m-%d') as run, sum(n) as n_items, count(err) as n_failures, md5(coalesce(string_agg(err, '; ' order by err), '')) as messages
        from (select cast(ts as date) as run, case when event_type <> 'error' then 3 else 0 end as n, case when event_type = 'error' then 'site' || cast(user_id % 7 as varchar) || '.example: HTTP ' || cast(500 + event_id % 5 as varchar) end as err from events) t group by 1"""
    )
)
def refresh_report(spark, sf):
    log = view(spark, sf, "fetch_log_ev").withColumn("n_items", F.when(F.col("ok"), 3).otherwise(0))
    site = F.concat(F.lit("https://Site"), (F.col("feed_id").cast("long") % 7).cast("string"), F.lit(".example/f"))
    log = log.withColumns({"url": site, "error": F.when(~F.col("ok"), F.concat(F.lit("HTTP "), (500 + F.col("seq") % 5).cast("string")))})
    out = registry.refresh_report(log.withColumn("run", F.date_format("run", "yyyy-MM-dd")))
    return out.select("run", "n_items", "n_failures", F.md5("messages").alias("messages"))


@query(with_views("select distinct section from (select section from feeds_ev union all select lang as section from documents) t", "feeds_ev"))
def all_sections(spark, sf):
    return registry.all_sections(view(spark, sf, "feeds_ev"), view(spark, sf, "items_doc").select("section"))


# Page mining


@query("select page_id, page_id % 2 = 0 as is_feed, case when page_id % 2 = 0 then 'T ' || cast(page_id as varchar) end as title from pages")
def sniff_feed(spark, sf):
    feed = F.concat(F.lit("<?xml?><RSS><channel><title >  T "), F.col("page_id").cast("string"), F.lit("\n</title>"), F.col("html"))
    body = F.when(F.col("page_id") % 2 == 0, feed).otherwise(F.regexp_replace("html", "(?is)<title>.*?</title>", "<title></title>"))
    df = _pages(spark, sf).withColumn("body", body)
    return df.select("page_id", pages.sniff_feed(F.col("body")).alias("is_feed"), pages.feed_title_sniff(F.col("body")).alias("title"))


@query(
    with_views(
        """select page_id, 'https://feeds.example/' || cast(page_id as varchar) as url, 'Feed ' || cast(page_id as varchar) as title from pages where page_id % 4 = 0
        union all select page_id, 'https://feeds.example/atom' as url, null as title from pages where page_id % 4 = 0"""
    )
)
def discover_feeds(spark, sf):
    return pages.discover_feeds(view(spark, sf, "pages_x")).select("page_id", "url", "title")


_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_FALL = f"""fb as (select page_id, arg_min(struct_pack(o := o, url := u, title := t), o) as m from (
    select p.page_id, f.o, c.url as u, trim(regexp_extract(c.body, '(?i)<title[^>]*>([^<]+)</title>', 1)) as t
    from pages p, (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(pages.FALLBACK_PATHS))}) f(o, path), crawl_x c
    where c.url = {_ROOT.replace("url", "p.url")} || f.path and contains(lower(c.body), '<rss')) h group by 1)"""


@query(with_views("select page_id, m.o as ord, m.url as url, m.title as title from fb", "crawl_x", ctes=(_FALL,)))
def discover_fallback(spark, sf):
    return pages.discover_fallback(_pages(spark, sf), view(spark, sf, "crawl_x"))


@query(
    with_views(
        """select page_id, 'https://feeds.example/' || cast(page_id as varchar) as url from pages where page_id % 4 = 0 and page_id % 6 <> 0
        union all select page_id, 'https://feeds.example/atom' as url from pages where page_id % 4 = 0 and page_id % 6 <> 0
        union all select page_id, url from pages where page_id % 6 = 0
        union all select page_id, m.url as url from fb where page_id % 4 <> 0 and page_id % 6 <> 0""",
        "crawl_x", ctes=(_FALL,),
    )
)
def discovery_result(spark, sf):
    own = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("<feed><title>x</title>"), F.col("html"))).otherwise(F.col("html"))
    return pages.discovery_result(view(spark, sf, "pages_x").withColumn("html", own), view(spark, sf, "crawl_x")).select("page_id", "url")


@query("select page_id, case page_id % 5 when 0 then 'https://img.example/' || page_id || '.png' when 1 then 'https://img.example/' || page_id || '.jpg' when 2 then 'https://img.example/' || page_id || '.gif' end as image from pages")
def og_image(spark, sf):
    return view(spark, sf, "pages_x").select("page_id", pages.og_image(F.col("html"), F.col("url")).alias("image"))


_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ' || chr(10) || chr(9) || chr(13))"
_SEPS = r"\|\-–—\\/>»"
_AT = f"""tt as (select page_id, html, t, regexp_matches(t, '\\s[{_SEPS}]\\s') as sep, regexp_extract(t, '(?s)^(.*)\\s[{_SEPS}]\\s', 1) as cut, regexp_extract(t, '(?s)^.*:(.*)$', 1) as al,
    regexp_extract(t, '(?s)^[^:]*:(.*)$', 1) as af, regexp_extract(t, '(?s)^([^:]*):', 1) as be, list_transform(regexp_extract_all(html, '(?is)<h[12]\\b[^>]*>(.*?)</h[12]>', 1), lambda x: {_INNER.format("x")}) as hs,
    regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) as h1 from (select page_id, html, {_TITLE} as t from {{src}}) q),
  u as (select *, case when sep then case when len(regexp_split_to_array(cut, '\\s+')) < 3 then regexp_replace(t, '^[^{_SEPS}]*[{_SEPS}]', '') else cut end
    when contains(t, ': ') then case when list_contains(hs, t) then t when len(regexp_split_to_array(al, '\\s+')) < 3 then af when len(regexp_split_to_array(be, '\\s+')) > 5 then t else al end
    when (length(t) > 150 or length(t) < 15) and len(h1) = 1 then {_INNER.format("h1[1]")} else t end as c0 from tt),
  w as (select *, regexp_replace(trim(c0), '\\s{{{{2,}}}}', ' ', 'g') as c from u),
  at_ as (select page_id, case when len(regexp_split_to_array(c, '\\s+')) <= 4 and (not (sep and regexp_matches(t, '\\s[\\\\/>»]\\s'))
    or len(regexp_split_to_array(c, '\\s+')) <> len(regexp_split_to_array(regexp_replace(t, '\\s[{_SEPS}]\\s', '', 'g'), '\\s+')) - 1) then t else c end as title from w)"""
_AT = _AT.replace("{{{{2,}}}}", "{2,}").replace("{{2,}}", "{2,}")
_TITLED = "titled as (select page_id, replace(html, '</title>', case page_id % 5 when 0 then ' | The Site Name</title>' when 1 then ' / News » Site</title>' when 2 then ': more words to read here</title>' when 3 then ' - X</title>' else '</title>' end) as html from pages)"


@query(with_views("select page_id, title from at_", ctes=(_TITLED, _AT.replace("{src}", "titled"))))
def article_title(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" | The Site Name", " / News » Site", ": more words to read here", " - X", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    html = F.replace(F.col("html"), F.lit("</title>"), F.concat(tail, F.lit("</title>")))
    return _pages(spark, sf).select("page_id", pages.article_title(html).alias("title"))


@query(
    with_views(
        """select p.page_id, case when p.page_id % 3 = 0 then 'Title & ' || p.page_id else replace(replace(replace(replace(replace(a.title, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') end as title,
        case when p.page_id % 3 = 0 then 'A. Writer' end as byline, case when p.page_id % 3 = 1 then 'about ' || p.page_id end as excerpt, case when p.page_id % 3 = 1 then 'Site' end as site_name
        from pages p join at_ a on p.page_id = a.page_id""",
        ctes=(_AT.replace("{src}", "pages"),),
    )
)
def page_metadata(spark, sf):
    return pages.page_metadata(view(spark, sf, "pages_x")).select("page_id", "title", "byline", "excerpt", "site_name")


@query(
    """select page_id, 'Story ' || page_id as title, case when page_id % 4 = 0 then 'Ann' when page_id % 4 = 1 then 'Bo, Cy' end as byline, 'x' || page_id as excerpt, 'Pub' as site_name, '2024-01-01' as date_published
    from pages where page_id % 4 < 3"""
)
def json_ld_metadata(spark, sf):
    number = F.col("page_id").cast("string")
    n = F.col("page_id") % 4
    author = F.when(n == 0, ',"author":{"name":" Ann "}').when(n == 1, ',"author":[{"name":"Bo"},{"x":1},{"name":"Cy"}]').otherwise("")
    kind = F.when(n == 3, "Recipe").otherwise("NewsArticle")
    fields = F.concat(F.lit('"@type":"'), kind, F.lit('","headline":" Story '), number, F.lit('"'), author, F.lit(',"description":"x'), number, F.lit('","publisher":{"name":"Pub"},"datePublished":"2024-01-01"'))
    graph = F.concat(F.lit('{"@context":{"@vocab":"http://schema.org/"},"@graph":[{"@type":"Person"},{'), fields, F.lit("}]}"))
    plain = F.concat(F.lit('[{"@type":"Person"},{"@context":"https://schema.org",'), fields, F.lit("}]"))
    single = F.concat(F.lit('{"@context":"https://schema.org",'), fields, F.lit("}"))
    data = F.when(n == 2, graph).when(n == 1, plain).otherwise(single)
    script = F.concat(F.lit('<script type="application/ld+json">not json</script><script type="application/ld+json">'), data, F.lit("</script>"), F.col("html"))
    return pages.json_ld_metadata(_pages(spark, sf).withColumn("html", script))


@query()
def extract_article(spark, sf):
    df = _pages(spark, sf).withColumn("title", pages.article_title(F.col("html")))
    out = article.extract_article(df, title="title")
    return out.select("page_id", "lang", "byline", "length", "status", F.md5("text").alias("digest"))


@query("select page_id, case when page_id % 4 = 0 then 'pdf' when page_id % 4 = 1 then 'no_article' when length(html) < 3000 then 'too_short' else 'ok' end as status from pages")
def article_gate(spark, sf):
    n = F.col("page_id") % 4
    body = F.when(n == 1, F.lit(None).cast("string")).otherwise(F.col("html"))
    return _pages(spark, sf).select("page_id", pages.article_gate(body, n == 0, 3000).alias("status"))


@query(f"select page_id, case when page_id % 2 = 0 then 'given' else trim(regexp_replace({_INNER.format(_PS + '[1]')}, '\\s+', ' ', 'g')) end as excerpt from pages")
def excerpt_fallback(spark, sf):
    given = F.when(F.col("page_id") % 2 == 0, "given").otherwise("")
    return _pages(spark, sf).select("page_id", pages.excerpt_fallback(given, F.col("html")).alias("excerpt"))


# Filters and joins


@query(with_views("select row_id from items_ev where feed_id not in (select feed_id from feeds_ev where is_paused)", "items_ev", "feeds_ev"))
def drop_paused(spark, sf):
    return filters.drop_paused(events(spark, sf), view(spark, sf, "feeds_ev")).select("row_id")


@query(with_views("select row_id from items_ev where feed_id in (select feed_id from feeds_ev where user_id % 3 = 0)", "items_ev", "feeds_ev"))
def drop_removed_feeds(spark, sf):
    return filters.drop_removed_feeds(events(spark, sf), view(spark, sf, "feeds_ev").filter("user_id % 3 = 0")).select("row_id")


@query(with_views(f"select row_id from items_ev where row_id % 11 = 0 or {_NORM_SQL.format('link')} not in ('site1.example', 'site4.example')", "items_ev"))
def drop_excluded_hosts(spark, sf):
    ev = events(spark, sf).withColumn("link", F.when(F.col("row_id") % 11 == 0, "mailto:x").otherwise(F.col("link")))
    hosts = spark.createDataFrame([("site1.example",), ("site4.example",)], "host string")
    return filters.drop_excluded_hosts(ev, hosts).select("row_id")


@query(with_views("select row_id from items_ev where item_id not in (select item_id from reads_ev)", "items_ev", "reads_ev"))
def hide_read(spark, sf):
    return filters.hide_read(events(spark, sf), view(spark, sf, "reads_ev")).select("row_id")


@query(with_views("select row_id, item_id in (select item_id from reads_ev) as is_read from items_ev", "items_ev", "reads_ev"))
def read_flag(spark, sf):
    return filters.read_flag(events(spark, sf), view(spark, sf, "reads_ev")).select("row_id", "is_read")


@query(
    with_views(
        """select l.reader_id, l.item_id from (select reader_id, item_id, arg_max(op, seq) as op, max(seq) as seq from read_log_ev where op <> 'clear' group by 1, 2) l
        left join (select reader_id, max(seq) as c from read_log_ev where op = 'clear' group by 1) c on l.reader_id = c.reader_id where l.op = 'read' and l.seq > coalesce(c.c, -1)""",
        "read_log_ev",
    )
)
def read_state(spark, sf):
    return filters.read_state(view(spark, sf, "read_log_ev"))


@query(with_views("select row_id, case when row_id % 13 = 0 then 'pinned' when row_id % 7 = 0 then 'guessed' when user_id % 2 = 0 then f.section else i.section end as section from items_ev i join feeds_ev f on i.feed_id = f.feed_id", "items_ev", "feeds_ev"))
def resolve_section(spark, sf):
    ev = events(spark, sf).withColumn("item_id", F.col("row_id").cast("string"))
    pins = ev.filter("row_id % 13 = 0").select("item_id", F.lit("pinned").alias("section"))
    guessed = ev.filter("row_id % 7 = 0").select("item_id", F.lit("guessed").alias("section"))
    feeds = view(spark, sf, "feeds_ev").filter("user_id % 2 = 0")
    return filters.resolve_section(ev, pins, guessed, feeds).select("row_id", "section")


# Dedupe, interleaving, slots

_ORDER = "published_at desc, feed_id, item_id, link, row_id"
_KEPT = (
    f"o as (select *, row_number() over (partition by edition_date order by {_ORDER}) as n from items_ev)",
    """s(edition_date, n, row_id, kept, links, ids) as (
        select distinct edition_date, cast(0 as bigint), cast(-1 as bigint), false, cast([] as varchar[]), cast([] as varchar[]) from o
        union all
        select o.edition_date, o.n, o.row_id, not (list_contains(s.links, lower(o.link)) or list_contains(s.ids, o.item_id)),
            case when list_contains(s.links, lower(o.link)) or list_contains(s.ids, o.item_id) then s.links else list_append(s.links, lower(o.link)) end,
            case when list_contains(s.links, lower(o.link)) or list_contains(s.ids, o.item_id) then s.ids else list_append(s.ids, o.item_id) end
        from s join o on s.edition_date = o.edition_date and o.n = s.n + 1)""",
    "kept as (select o.* from o join s on o.row_id = s.row_id where s.kept)",
)
_RR = (
    *_KEPT,
    "laps as (select *, row_number() over (partition by edition_date, feed_id order by n) as lap, min(n) over (partition by edition_date, feed_id) as head from kept)",
    "rr as (select *, row_number() over (partition by edition_date order by lap, head) as r, image_url is not null as usable from laps)",
)
_SLOTS = (
    *_RR,
    "leads as (select edition_date, min(r) as r from rr where usable group by 1)",
    "rest as (select rr.*, row_number() over (partition by rr.edition_date order by rr.r) as k from rr left join leads l on rr.edition_date = l.edition_date and rr.r = l.r where l.r is null)",
    "later as (select *, row_number() over (partition by edition_date, section order by r) as sr, dense_rank() over (partition by edition_date order by lower(section), section) + 1 as pg from rest where k > 15)",
    """placed as (select rr.row_id, rr.edition_date, rr.section, 'lead' as slot, 1 as slot_rank, 1 as page_no from rr join leads l on rr.edition_date = l.edition_date and rr.r = l.r
        union all select row_id, edition_date, section, case when k <= 3 then 'secondary' else 'brief' end, case when k <= 3 then k else k - 3 end, 1 from rest where k <= 15
        union all select row_id, edition_date, section, 'section', sr, pg from later)""",
)


@query(with_views("select row_id from kept", "items_ev", ctes=_KEPT))
def dedupe_items(spark, sf):
    return dedupe.dedupe_items(events(spark, sf), tie=TIE).select("row_id")


@query(with_views("select 0 as gen, row_id from items_ev where row_id % 2 = 0 union all select 1, row_id from items_ev where row_id % 2 = 1 and feed_id in (select feed_id from feeds_ev where user_id % 5 > 0)", "items_ev", "feeds_ev"))
def carry_over(spark, sf):
    ev = events(spark, sf)
    return dedupe.carry_over(ev.filter("row_id % 2 = 0"), ev.filter("row_id % 2 = 1"), view(spark, sf, "feeds_ev").filter("user_id % 5 > 0")).select("gen", "row_id")


def _ranked(spark: SparkSession, sf: str, checks: bool = False) -> DataFrame:
    out = editions.round_robin(dedupe.dedupe_items(events(spark, sf), tie=TIE), tie=TIE)
    return editions.usable_image(out, view(spark, sf, "image_checks_ev")) if checks else out.withColumn("usable", F.col("image_url").isNotNull())


def _number(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("r", F.row_number().over(Window.partitionBy("edition_date").orderBy("rr")).cast("long"))


@query(with_views("select row_id, r from rr", "items_ev", ctes=_RR))
def round_robin(spark, sf):
    return _number(_ranked(spark, sf)).select("row_id", "r")


_CHECKED = "ok as (select url, status between 200 and 299 and width >= 48 and height >= 48 and elapsed_s <= 12 as good from image_checks_ev)"


@query(with_views("select i.row_id, i.image_url is not null and coalesce(ok.good, true) as usable from items_ev i left join ok on i.image_url = ok.url", "items_ev", "image_checks_ev", ctes=(_CHECKED,)))
def usable_image(spark, sf):
    return editions.usable_image(events(spark, sf), view(spark, sf, "image_checks_ev")).select("row_id", "usable")


@query(
    with_views(
        "select rr.edition_date, arg_min(rr.row_id, r) as row_id from rr left join ok on rr.image_url = ok.url where rr.image_url is not null and coalesce(ok.good, true) group by 1",
        "items_ev", "image_checks_ev", ctes=(_CHECKED, *_RR),
    )
)
def lead_pick(spark, sf):
    ranked = _ranked(spark, sf, checks=True)
    return ranked.join(editions.lead_pick(ranked), ["edition_date", "rr"], "left_semi").select("edition_date", "row_id")


@query(
    with_views(
        """select edition_date, arg_min(row_id, t) as row_id from (select rr.*, row_number() over (partition by edition_date order by r) as t, coalesce(ok.good, true) and rr.row_id % 5 = 0 as good
        from rr left join ok on rr.image_url = ok.url where image_url is not null) q where t <= 9 and (good or t = 9) group by 1""",
        "items_ev", "image_checks_ev", ctes=(_CHECKED, *_RR),
    )
)
def validated_lead(spark, sf):
    # checks by item, so that four in five fail and the ninth candidate is reached
    ranked = _ranked(spark, sf).withColumn("image_url", F.when(F.col("image_url").isNotNull(), F.concat("image_url", F.lit("#"), F.col("row_id").cast("string"))))
    number = F.regexp_extract("image_url", "#([0-9]+)$", 1).cast("long")
    plain = view(spark, sf, "image_checks_ev").withColumnRenamed("url", "plain")
    checks = ranked.filter("image_url is not null").select(F.col("image_url").alias("url"), number.alias("i"), F.regexp_replace("image_url", "#.*", "").alias("plain")).join(plain, "plain")
    checks = checks.withColumn("status", F.when(F.col("i") % 5 == 0, F.col("status")).otherwise(F.lit(500)))
    leads = editions.validated_lead(ranked, checks)
    return ranked.join(leads, ["edition_date", "rr"], "left_semi").select("edition_date", "row_id")


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return publish.place(events(spark, sf), tie=TIE)


@query(with_views("select row_id, slot, slot_rank, page_no from placed", "items_ev", ctes=_SLOTS))
def slots(spark, sf):
    return _placed(spark, sf).select("row_id", "slot", "slot_rank", "page_no")


@query(with_views("select distinct edition_date, section, page_no from placed where slot = 'section'", "items_ev", ctes=_SLOTS))
def section_page_no(spark, sf):
    return _placed(spark, sf).filter("slot = 'section'").select("edition_date", "section", "page_no").distinct()


@query(with_views("select edition_date, section, page_no, count(*) as n, string_agg(cast(row_id as varchar), ',' order by slot_rank) as items from placed where slot = 'section' group by 1, 2, 3", "items_ev", ctes=_SLOTS))
def section_pages(spark, sf):
    out = editions.section_pages(_placed(spark, sf), dedupe.KEYS, "row_id")
    ids = F.array_join(F.transform("items", lambda i: i["row_id"].cast("string")), ",")
    return out.select("edition_date", "section", "page_no", F.size("items").cast("long").alias("n"), ids.alias("items"))


@query(with_views("select row_id, slot, slot_rank from placed where slot <> 'section'", "items_ev", ctes=_SLOTS))
def front_page(spark, sf):
    return editions.front_page(_ranked(spark, sf)).select("row_id", "slot", "slot_rank")


@query(
    with_views(
        """select edition_date, count(*) as n_items, max(case when slot = 'lead' then 1 else 0 end) as has_lead, count(distinct case when slot = 'section' then section end) as n_sections,
        greatest(1, 1 + count(distinct case when slot = 'section' then section end)) as total_pages, count(*) = 0 as is_empty from placed group by 1""",
        "items_ev", ctes=_SLOTS,
    )
)
def edition_summary(spark, sf):
    return editions.edition_summary(_placed(spark, sf))


@query(with_views("select distinct edition_date, 1 as page_no, 'Front Page' as title from placed union all select distinct edition_date, page_no, section from placed where slot = 'section'", "items_ev", ctes=_SLOTS))
def page_titles(spark, sf):
    return editions.page_titles(_placed(spark, sf))


@query(with_views("select edition_date, row_id, slot, slot_rank, page_no from placed", "items_ev", ctes=_SLOTS))
def edition_flatten(spark, sf):
    nested = editions.edition_nest(_placed(spark, sf), ["row_id", "title"])
    return editions.edition_flatten(nested).select("edition_date", "row_id", "slot", "slot_rank", "page_no")


@query(
    with_views(
        """select edition_date, max(case when slot = 'lead' then row_id end) as lead, count(*) filter (slot = 'secondary') as n_secondaries, count(*) filter (slot = 'brief') as n_briefs,
        string_agg(cast(row_id as varchar), ',' order by slot_rank) filter (slot = 'brief') as briefs, count(distinct section) filter (slot = 'section') as n_pages from placed group by 1""",
        "items_ev", ctes=_SLOTS,
    )
)
def edition_nest(spark, sf):
    out = editions.edition_nest(_placed(spark, sf), ["row_id", "title"])
    briefs = F.array_join(F.transform("briefs", lambda b: b["row_id"].cast("string")), ",")
    return out.select(
        "edition_date", F.col("lead.row_id").alias("lead"), F.size("secondaries").alias("n_secondaries"), F.size("briefs").alias("n_briefs"), briefs.alias("briefs"),
        F.coalesce(F.size("sections"), F.lit(0)).alias("n_pages"),
    )


@query(with_views("select row_id from items_ev order by published_at desc, feed_id, item_id, link, row_id limit 24", "items_ev"))
def top_k_newest(spark, sf):
    return editions.top_k_newest(events(spark, sf), tie=("feed_id", "item_id", "link", "row_id")).select("row_id")


@query(with_views("select edition_date, row_id, row_number() over (partition by edition_date order by published_at desc, row_id) as place from items_ev", "items_ev"))
def newest_first(spark, sf):
    place = F.row_number().over(Window.partitionBy("edition_date").orderBy(F.col("published_at").desc_nulls_last(), "row_id"))
    ordered = editions.newest_first(events(spark, sf).select("edition_date", "row_id", "published_at"), "row_id")
    return ordered.withColumn("place", place).drop("published_at")


@query(with_views("select distinct section, dense_rank() over (order by lower(section), section) as place from items_ev", "items_ev"))
def case_insensitive_order(spark, sf):
    names = events(spark, sf).select("section").distinct()
    return names.withColumn("place", F.dense_rank().over(Window.orderBy(F.lower("section"), "section")))


@query(
    with_views(
        """select i.row_id, case when i.image_url is not null then i.image_url when t.row_id is not null then 'https://og.example/' || i.row_id end as image_url from items_ev i
        left join (select row_id, row_number() over (partition by edition_date order by published_at desc, row_id) as k from items_ev) t on i.row_id = t.row_id and t.k <= 24""",
        "items_ev",
    )
)
def enrich_images(spark, sf):
    ev = events(spark, sf).withColumn("link", F.concat("link", F.lit("?"), F.col("row_id").cast("string")))
    page = F.concat(F.lit('<head><meta property="og:image" content="https://og.example/'), F.col("row_id").cast("string"), F.lit('"></head>'))
    return publish.enrich_images(ev, ev.select(F.col("link").alias("url"), page.alias("html")), 24, ("edition_date",), TIE).select("row_id", "image_url")


@query(
    with_views(
        "select row_id, edition_date from items_ev where row_id % 2 = 0 and edition_date not in (select edition_date from items_ev where row_id % 2 = 1 and cast(strftime(edition_date, '%d') as int) % 3 = 0) union all select row_id, edition_date from items_ev where row_id % 2 = 1 and cast(strftime(edition_date, '%d') as int) % 3 = 0",
        "items_ev",
    )
)
def publish_guard(spark, sf):
    ev = events(spark, sf).select("row_id", "edition_date")
    return store.publish_guard(ev.filter("row_id % 2 = 0"), ev.filter((F.col("row_id") % 2 == 1) & (F.dayofmonth("edition_date") % 3 == 0)))


@query(with_views("select row_id from items_ev where edition_date >= date '2024-01-14'", "items_ev"))
def prune_editions(spark, sf):
    return store.prune_editions(events(spark, sf), "2024-01-20").select("row_id")


@query(with_views("select edition_date, feed_id, count(*) as n from items_ev group by 1, 2", "items_ev"))
def day_counts(spark, sf):
    return events(spark, sf).groupBy("edition_date", "feed_id").agg(F.count(F.lit(1)).alias("n"))


# Classifier

_STOP = ", ".join(f"'{w}'" for w in classify.STOPWORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}]+'), lambda x: length(x) between 3 and 24 and x not in ({}))"
_LAST = "last as (select item_id, arg_max(section, seq) as section, arg_max(text, seq) as text from moves_doc group by 1)"
_MODEL = (
    _LAST,
    f"tok as (select section, unnest({_TOKENS.format('text', _STOP)}) as token from last)",
    "counts as (select token, section, count(*) as n from tok group by 1, 2)",
    f"stats as (select section, count(*) as docs, sum(len({_TOKENS.format('text', _STOP)})) as total from last group by 1)",
    "vocab as (select greatest(1, count(distinct token)) as v from counts)",
)
_FREQ = f"freq as (select item_id, token, count(*) as c from (select item_id, unnest({_TOKENS.format('text', _STOP)}) as token from items_doc) t group by 1, 2)"
_SCORE = (
    *_MODEL, _FREQ,
    "hit as (select f.item_id, k.section, sum(f.c * ln(k.n + 1)) as gain from freq f join counts k on f.token = k.token group by 1, 2)",
    """score as (select l.item_id, st.section, coalesce(h.gain, 0) - l.n * ln(st.total + v) as score from (select item_id, sum(c) as n from freq group by 1) l, stats st, vocab
        left join hit h on h.item_id = l.item_id and h.section = st.section)""",
    "best as (select item_id, section, score, row_number() over (partition by item_id order by score desc, section desc) as r, score - lead(score) over (partition by item_id order by score desc, section desc) as margin from score)",
)


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts, stats, _ = reflow.train(view(spark, sf, "moves_doc"))
    return counts, stats


@query(with_views(f"select row_id, len({_TOKENS.format('text', _STOP)}) as n, md5(array_to_string({_TOKENS.format('text', _STOP)}, ' ')) as digest from items_doc", "items_doc"))
def tokenise(spark, sf):
    tokens = classify.tokenise(F.col("text"))
    return view(spark, sf, "items_doc").select("row_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query(with_views("select token, count(*) as items, sum(c)::bigint as n from freq group by 1", "items_doc", ctes=(_FREQ,)))
def token_frequencies(spark, sf):
    freq = classify.token_frequencies(view(spark, sf, "items_doc"))
    return freq.groupBy("token").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("n"))


@query(with_views("select item_id, section, md5(text) as digest from last", "moves_doc", ctes=(_LAST,)))
def latest_corrections(spark, sf):
    return classify.latest_corrections(view(spark, sf, "moves_doc")).select("item_id", "section", F.md5("text").alias("digest"))


@query(with_views("select item_id, section from last", "moves_doc", ctes=(_LAST,)))
def pin_section(spark, sf):
    return classify.pin_section(view(spark, sf, "moves_doc"))


@query(with_views("select token, section, n from counts", "moves_doc", ctes=_MODEL))
def train_token_counts(spark, sf):
    return _model(spark, sf)[0]


@query(with_views("select section, docs, total::bigint as total_tokens from stats", "moves_doc", ctes=_MODEL))
def train_section_stats(spark, sf):
    return _model(spark, sf)[1]


@query(with_views("select v as vocabulary from vocab", "moves_doc", ctes=_MODEL))
def vocabulary_size(spark, sf):
    return classify.vocabulary_size(_model(spark, sf)[0])


@query(with_views("select count(*) filter (docs >= 3) >= 3 as ready from stats", "moves_doc", ctes=_MODEL))
def classifier_ready(spark, sf):
    return classify.classifier_ready(_model(spark, sf)[1])


@query(with_views("select item_id, section, round(score, 4) as score from score", "moves_doc", "items_doc", ctes=_SCORE))
def nb_scores(spark, sf):
    scores = classify.nb_scores(classify.occurrences(view(spark, sf, "items_doc")), *_model(spark, sf))
    return scores.select("item_id", "section", F.round("score", 4).alias("score"))


@query(with_views("select item_id, section, round(margin, 4) as margin from best where r = 1", "moves_doc", "items_doc", ctes=_SCORE))
def predict_margin(spark, sf):
    scores = classify.nb_scores(classify.occurrences(view(spark, sf, "items_doc")), *_model(spark, sf))
    return classify.predict_margin(scores).select("item_id", "section", F.round("margin", 4).alias("margin"))


@query(with_views("select item_id, section from best where r = 1 and margin >= 1", "moves_doc", "items_doc", ctes=_SCORE))
def nb_predict(spark, sf):
    return classify.nb_predict(classify.occurrences(view(spark, sf, "items_doc")), *_model(spark, sf)).select("item_id", "section")


@query(with_views("select token, section, n from counts union all select '#', section, docs from stats union all select '##', section, total::bigint from stats", "moves_doc", ctes=_MODEL))
def state_explode(spark, sf):
    counts, stats = classify.state_explode(classify.state_pack(*_model(spark, sf)))
    long = counts.select("token", "section", F.col("n").cast("long").alias("n"))
    long = long.unionByName(stats.select(F.lit("#").alias("token"), "section", F.col("docs").cast("long").alias("n")))
    return long.unionByName(stats.select(F.lit("##").alias("token"), "section", F.col("total_tokens").cast("long").alias("n")))


# Whole workloads


@query(
    with_views(
        f"""select row_id, edition_date from items_ev where feed_id not in (select feed_id from feeds_ev where is_paused) and {_NORM_SQL.format("link")} <> 'site2.example'
        and item_id not in (select item_id from reads_ev) and row_id in (select row_id from kept_)""",
        "items_ev", "feeds_ev", "reads_ev",
        ctes=(
            f"f as (select * from items_ev where feed_id not in (select feed_id from feeds_ev where is_paused) and {_NORM_SQL.format('link')} <> 'site2.example' and item_id not in (select item_id from reads_ev))",
            _KEPT[0].replace("from items_ev", "from f"), _KEPT[1], _KEPT[2].replace("kept as", "kept_ as"),
        ),
    )
)
def reflow_edition(spark, sf):
    ev = events(spark, sf)
    empty = ev.select("item_id", "section").limit(0)
    hosts = spark.createDataFrame([("site2.example",)], "host string")
    out = reflow.reflow(ev, view(spark, sf, "feeds_ev"), hosts, view(spark, sf, "reads_ev"), empty, empty, tie=TIE)
    return out.select("row_id", "edition_date")


@query(
    with_views(
        "select row_id, edition_date from kept_", "items_ev", "feeds_ev", "reads_ev",
        ctes=(
            f"""f as (select * replace (reader_id || ' ' || cast(edition_date as varchar) as edition_date, row_id * 2 + cast(reader_id as int) as row_id) from items_ev, (values ('0'), ('1')) r(reader_id)
            where (reader_id, feed_id) not in (select cast(user_id // 10 % 2 as varchar), feed_id from feeds_ev where is_paused)
            and {_NORM_SQL.format('link')} <> 'site' || cast(2 + cast(reader_id as int) as varchar) || '.example'
            and (reader_id, item_id) not in (select cast(cast(reader_id as int) % 2 as varchar), item_id from reads_ev))""",
            _KEPT[0].replace("from items_ev", "from f"), _KEPT[1], _KEPT[2].replace("kept as", "kept_ as"),
        ),
    )
)
def reflow_readers(spark, sf):
    """Two readers over the same items, each with feeds paused, a host excluded and items read of their own."""
    readers = F.explode(F.array(F.lit("0"), F.lit("1"))).alias("reader_id")
    ev = events(spark, sf).select("*", readers).withColumn("row_id", F.col("row_id") * 2 + F.col("reader_id").cast("long"))
    feeds = view(spark, sf, "feeds_ev").select("*", readers)
    feeds = feeds.withColumn("is_paused", F.col("is_paused") & (F.floor(F.col("user_id") / 10) % 2 == F.col("reader_id").cast("long")))
    reads = view(spark, sf, "reads_ev").withColumn("reader_id", (F.col("reader_id").cast("long") % 2).cast("string"))
    hosts = spark.createDataFrame([("0", "site2.example"), ("1", "site3.example")], "reader_id string, host string")
    empty = ev.select("reader_id", "item_id", "section").limit(0)
    out = reflow.reflow(ev, feeds, hosts, reads, empty, empty, keys=("reader_id", "edition_date"), tie=TIE)
    return out.select("row_id", F.concat_ws(" ", "reader_id", F.col("edition_date").cast("string")).alias("edition_date"))


# Single columns and flavours, registered under names of their own


def _case_links(spark: SparkSession, sf: str) -> DataFrame:
    link = F.replace(F.element_at(F.array(*map(F.lit, _LINKS)), (F.col("row_id") % 9 + 1).cast("int")), F.lit("{}"), F.col("row_id").cast("string"))
    return events(spark, sf).select("row_id", link.alias("link"))


@query(f"select event_id as row_id, case event_id % 9 when 0 then 'ab c' || {_ID} when 1 then 'x' || {_ID} when 2 then 's' || {_ID} end as id from events")
def youtube_id(spark, sf):
    return _case_links(spark, sf).select("row_id", urls.youtube_id(F.col("link")).alias("id"))


@query(f"select event_id as row_id, case event_id % 9 when 4 then {_ID} when 8 then {_ID} end as id from events")
def vimeo_id(spark, sf):
    return _case_links(spark, sf).select("row_id", urls.vimeo_id(F.col("link")).alias("id"))


@query(with_views("select row_id, case when row_id % 5 = 0 then 'Channel' else source_title end as title from items_ev", "items_ev"))
def source_title(spark, sf):
    stored = F.when(F.col("row_id") % 10 == 0, "").when(F.col("row_id") % 5 > 0, F.col("source_title"))
    return events(spark, sf).select("row_id", items.source_title(stored, F.lit("Channel")).alias("title"))


@query("select doc_id, md5(case when doc_id % 2 = 0 and coalesce(text, '') <> '' then text else 'd' end) as digest from documents")
def choose_body(spark, sf):
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    return _documents(spark, sf).select("doc_id", F.md5(items.choose_body(content, F.lit("d"))).alias("digest"))


@query(with_views("select row_id, case when row_id % 3 = 0 then item_id else link end as item_id from items_ev", "items_ev"))
def item_id(spark, sf):
    return events(spark, sf).select("row_id", items.item_id(F.when(F.col("row_id") % 3 == 0, F.col("item_id")).otherwise(""), F.col("link")).alias("item_id"))


@query("select page_id, case when page_id % 2 = 0 then 'T ' || cast(page_id as varchar) end as title from pages")
def feed_title_sniff(spark, sf):
    head = F.concat(F.lit("<feed><TITLE type='text'> T "), F.col("page_id").cast("string"), F.lit(" </TITLE>"))
    body = F.when(F.col("page_id") % 2 == 0, head).otherwise("<feed><title> </title>")
    return _pages(spark, sf).select("page_id", pages.feed_title_sniff(body).alias("title"))


@query("select doc_id % 3 as kind, count(*) as docs, sum(case when doc_id % 3 < 2 then 1 else 0 end)::bigint as links, sum(case when doc_id % 3 < 2 then 1 else 0 end)::bigint as titles from documents group by 1")
def feed_flavour(spark, sf):
    """RSS, Atom and RDF documents: the link is text, an attribute, or (as the root is unknown) nothing."""
    link = F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"))
    rss = F.concat(F.lit("<rss><channel><title>C</title><item><title>t</title><title>late</title><link>"), link, F.lit("</link><link>late</link></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><title>C</title><entry><title>t</title><link rel='self' href='self'/><link href='"), link, F.lit("'/><link href='late'/></entry></feed>"))
    rdf = F.concat(F.lit("<RDF><item><title>t</title><link>"), link, F.lit("</link></item></RDF>"))
    body = F.when(F.col("doc_id") % 3 == 0, rss).when(F.col("doc_id") % 3 == 1, atom).otherwise(rdf)
    docs = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("feed_id"), F.encode(body, "utf-8").alias("body"), link.alias("want"))
    out = feed_docs.parse_feed_documents(docs).filter("pos = 0").join(docs.select("feed_id", "want"), "feed_id")
    kind = (F.col("feed_id").cast("long") % 3).alias("kind")
    return out.groupBy(kind).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("link") == F.col("want")).alias("links"), F.count_if(F.col("channel_title") == "C").alias("titles"))


@query("select cast(doc_id as varchar) as feed_id, source as channel_title from documents")
def channel_title(spark, sf):
    """The first title of a channel or feed outside its entries; an entry's title, or a later one, is none of it."""
    source = text.html_escape(F.col("source"))
    entry = F.lit("<item><title>entry</title><link>https://d.example/</link></item>")
    rss = F.concat(F.lit("<rss><title>outside</title><channel>"), F.when(F.col("doc_id") % 4 == 0, entry).otherwise(""), F.lit("<title> "), source, F.lit(" </title><title>late</title></channel></rss>"))
    atom = F.concat(F.lit("<feed><title>"), source, F.lit("</title><entry><title>entry</title></entry><title>late</title></feed>"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("feed_id"), F.encode(F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom), "utf-8").alias("body"))
    return feed_docs.parse_feed_documents(docs).filter("pos = -1").select("feed_id", "channel_title")


@query(
    f"""select cast(doc_id as varchar) as feed_id, lang as title, source as guid, md5(case when {_TRIMMED} = '' then 'late' else {_TRIMMED} end) as description,
        case when doc_id % 2 = 0 then 'https://d.example/' else 'https://d.example/atom' end || cast(doc_id as varchar) as link, 'day ' || cast(doc_id as varchar) as pub_date from documents"""
)
def feed_field_rules(spark, sf):
    """Which of several values of a field counts: the first that is not empty, but of dates the last."""

    def tags(name: str, *values):
        return F.concat(*[F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>")) for v in values])

    late, number = F.lit("late"), F.col("doc_id").cast("string")
    clean = F.regexp_replace(text.html_escape(F.col("text")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    fields = F.concat(tags("title", F.lit(" "), text.html_escape(F.col("lang")), late), tags("guid", text.html_escape(F.col("source")), late), tags("description", clean, late))
    fields = F.concat(fields, tags("pubDate", late, F.concat(F.lit("day "), number)))
    rss = F.concat(F.lit("<rss><channel><item>"), fields, tags("link", F.concat(F.lit("https://d.example/"), number), late), F.lit("</item></channel></rss>"))
    links = F.concat(F.lit("<link rel='self' href='self'/><link href='https://d.example/atom"), number, F.lit("'/><link href='late'/>"))
    atom = F.concat(F.lit("<feed><entry>"), fields, links, F.lit("</entry></feed>"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select(number.alias("feed_id"), F.encode(F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom), "utf-8").alias("body"))
    out = feed_docs.parse_feed_documents(docs).filter("pos = 0")
    return out.select("feed_id", "title", "guid", F.md5("description").alias("description"), "link", "pub_date")


@query(with_views("select token, sum(n)::bigint as n, string_agg(section || '=' || n, ',' order by section) as sections from counts group by 1", "moves_doc", ctes=_MODEL))
def state_pack(spark, sf):
    packed = classify.state_pack(*_model(spark, sf)).select(F.explode("tokenCounts").alias("token", "by"))
    pairs = F.array_sort(F.transform(F.map_entries("by"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    total = F.aggregate(F.map_values("by"), F.lit(0).cast("long"), lambda a, x: a + x)
    return packed.select("token", total.alias("n"), F.array_join(pairs, ",").alias("sections"))


# Tables on disk


@query(with_views("select feed_id, url, section, title, user_id % 10 = 0 and user_id % 4 > 0 as is_paused, 0 as seen from feeds_ev", "feeds_ev"))
def read_feed_registry(spark, sf):
    """The registry as a JSON array for each reader, in which some rows lack the newer fields, and read again."""
    path = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    paused = F.when(F.col("user_id") % 4 > 0, F.col("is_paused"))
    row = F.struct("feed_id", "url", "section", "title", paused.alias("is_paused"))
    files = view(spark, sf, "feeds_ev").groupBy((F.col("user_id") % 5).alias("reader")).agg(F.to_json(F.collect_list(row)).alias("value"))
    files.write.partitionBy("reader").text(path)
    return feed_docs.read_feed_registry(spark, path).select("feed_id", "url", "section", "title", "is_paused", F.size("last_seen_item_ids").alias("seen"))


@query(with_views("select row_id, title from items_ev where edition_date = date '2024-01-07' and row_id % 2 = 0 union all select row_id, title from items_ev where edition_date = date '2024-01-08'", "items_ev"))
def write_edition(spark, sf):
    """All days written, one of them written again by half of its rows, and two days read."""
    path = f"{shared_dir(spark)}/editions-{uuid.uuid4().hex}"
    ev = events(spark, sf).select("row_id", "title", "edition_date")
    store.write_edition(ev, path)
    store.write_edition(ev.filter("edition_date = '2024-01-07' and row_id % 2 = 0"), path)
    return store.read_edition(spark, path, "2024-01-07").unionByName(store.read_edition(spark, path, "2024-01-08")).select("row_id", "title")


@query(with_views("select row_id, title, edition_date from items_ev", "items_ev"))
def read_edition(spark, sf):
    """Every stored day, read as a partition by itself."""
    path = f"{shared_dir(spark)}/editions-{uuid.uuid4().hex}"
    ev = events(spark, sf).select("row_id", "title", "edition_date")
    store.write_edition(ev, path)
    days = [str(r[0]) for r in spark.read.parquet(path).select("edition_date").distinct().collect()]
    out = [store.read_edition(spark, path, day).select("row_id", "title", "edition_date") for day in days]
    return functools.reduce(DataFrame.unionByName, out, ev.limit(0))


@query(with_views("select edition_date, row_id, slot, slot_rank, page_no from placed", "items_ev", ctes=_SLOTS))
def edition_documents(spark, sf):
    """One JSON document a day, written, one of them written again, and read as rows."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    nested = cut(editions.edition_nest(_placed(spark, sf), ["row_id", "title"]))
    store.write_documents(nested, path)
    first = nested.agg(F.min("edition_date")).first()[0]
    store.write_documents(nested.filter(F.col("edition_date") == F.lit(first)), path)
    again = store.read_documents(spark, path, nested.schema)
    return editions.edition_flatten(again).select("edition_date", "row_id", "slot", "slot_rank", "page_no")


# Streams over the events, run to their end, against batch SQL


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, columns, where = VIEWS[name]
    path = f"{sf}/{source}.parquet"
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return live.where(where).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def _drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has put out at its end, as a table in the shared folder."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def batch(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    query_ = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query(with_views("select edition_date, feed_id, count(*) as n from items_ev group by 1, 2", "items_ev"))
def stream_day_counts(spark, sf):
    return _drain(jobs.stream_day_counts(_stream(spark, sf, "items_ev").drop("edition_date"), "60 days"), "complete")


@query(with_views("select distinct edition_date, lower(link) as link from items_ev", "items_ev"))
def stream_dedupe(spark, sf):
    return _drain(jobs.stream_dedupe(_stream(spark, sf, "items_ev").drop("edition_date"), delay="60 days").select("edition_date", F.lower("link").alias("link")))


@query(with_views("select row_id, case when edition_date < date '2024-01-10' then 'late' when edition_date > date '2024-01-10' then 'early' else 'today' end as timing from items_ev", "items_ev"))
def stream_late_items(spark, sf):
    return _drain(jobs.stream_late_items(_stream(spark, sf, "items_ev"), "2024-01-10").select("row_id", "timing"))


@query(with_views("select feed_id, epoch_us(won) as success, case when won is null or lost > won then epoch_us(lost) end as failure from st", "fetch_log_ev", ctes=(_STATE,)))
def stream_feed_health(spark, sf):
    out = _drain(jobs.stream_feed_health(_stream(spark, sf, "fetch_log_ev").withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return out.select("feed_id", F.unix_micros("last_success_at").alias("success"), F.unix_micros("last_failure_at").alias("failure"))


@query(with_views("select row_id from kept", "items_ev", ctes=_KEPT))
def stream_accumulate(spark, sf):
    path = f"{shared_dir(spark)}/paper-{uuid.uuid4().hex}"
    live = _stream(spark, sf, "items_ev").drop("edition_date").withColumn("published_at", F.col("published_at").cast("timestamp"))
    jobs.stream_accumulate(live, f"{path}/editions", f"{path}/checkpoint", TIE).awaitTermination()
    return spark.read.parquet(f"{path}/editions").select("row_id")


@query(with_views("select row_id from kept", "items_ev", ctes=_KEPT))
def stream_refresh(spark, sf):
    """The paper rebuilt from the stream, and once more when nothing new has come, which leaves it published."""
    path = f"{shared_dir(spark)}/paper-{uuid.uuid4().hex}"
    live = _stream(spark, sf, "items_ev").drop("edition_date").withColumn("published_at", F.col("published_at").cast("timestamp"))
    for _ in range(2):
        jobs.stream_refresh(live, f"{path}/editions", f"{path}/checkpoint", TIE, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{path}/editions").select("row_id")


@query(with_views("select item_id, section from best where r = 1 and margin >= 1", "moves_doc", "items_doc", ctes=_SCORE))
def stream_classify(spark, sf):
    path = f"{shared_dir(spark)}/filed-{uuid.uuid4().hex}"
    jobs.stream_classify(_stream(spark, sf, "items_doc"), *_model(spark, sf), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("item_id", "section")


@query(with_views("select row_id from items_ev where edition_date >= date '2024-01-14'", "items_ev"))
def stream_retention(spark, sf):
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    store.write_edition(events(spark, sf).select("row_id", "edition_date"), path)
    jobs.stream_retention(_stream(spark, sf, "items_ev"), path, f"{path}-checkpoint", "2024-01-20").awaitTermination()
    return spark.read.parquet(path).select("row_id")


@query(
    with_views(
        """select l.reader_id, l.item_id from (select reader_id, item_id, arg_max(op, seq) as op, max(seq) as seq from read_log_ev where op <> 'clear' group by 1, 2) l
        left join (select reader_id, max(seq) as c from read_log_ev where op = 'clear' group by 1) c on l.reader_id = c.reader_id where l.op = 'read' and l.seq > coalesce(c.c, -1)""",
        "read_log_ev",
    )
)
def stream_read_state(spark, sf):
    """The log as a stream, whose changes of each reader's state come to the state at its end."""
    path = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    jobs.stream_read_state(_stream(spark, sf, "read_log_ev"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return jobs.current_reads(spark, f"{path}/out")


@query(
    with_views(
        """select row_id, cast(edition_date as varchar) as edition_date, case when day(edition_date) <= 15 then 'late' else 'on_time' end as timing, null::bigint as n from items_ev
        union all select null, cast(edition_date as varchar), 'closed', count(*) from items_ev
        where day(edition_date) > 15 and edition_date < (select cast(max(published_at) - interval 1 day as date) from items_ev) group by 2""",
        "items_ev",
    )
)
def stream_late_table(spark, sf):
    """The second half of the month first, then the first half, whose days have closed by then: each item is in one table."""
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    ev = view(spark, sf, "items_ev").select("row_id", F.col("published_at").cast("timestamp").alias("published_at"))
    for half in (F.dayofmonth("published_at") > 15, F.dayofmonth("published_at") <= 15):
        ev.filter(half).write.mode("append").parquet(f"{path}/in")
        live = spark.readStream.schema(ev.schema).parquet(f"{path}/in")
        jobs.stream_late_table(live, f"{path}/out", f"{path}/checkpoint", salts=4).awaitTermination()
    out = spark.read.parquet(f"{path}/out").groupBy("timing", "row_id", "edition_date").agg(F.sum("n").alias("n"))
    return out.select("row_id", F.col("edition_date").cast("string").alias("edition_date"), "timing", "n")


@query(with_views("select row_id, cast(edition_date as varchar) as edition_date from items_ev where day(edition_date) % 2 = 1 or row_id % 2 = 0", "items_ev"))
def edition_rewrite(spark, sf):
    """All days written, then every second one replaced, beside a folder of another name; all days as the manifest has them."""
    path = f"{shared_dir(spark)}/editions-{uuid.uuid4().hex}"
    ev = events(spark, sf).select("row_id", "edition_date")
    store.write_edition(ev, path)
    ev.write.parquet(f"{path}/edition_date=junk")
    store.write_edition(ev.filter((F.dayofmonth("edition_date") % 2 == 0) & (F.col("row_id") % 2 == 0)), path)
    return store.read_editions(spark, path).select("row_id", F.col("edition_date").cast("string").alias("edition_date"))
