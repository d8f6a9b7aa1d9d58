"""Parsers, pages and stores on hand-written documents."""

import pytest
from pyspark.sql import functions as F

from newsprint.functions import dates, text, urls
from newsprint.operators import article, items, pages
from newsprint.sources import feeds, opml, store

RSS = b"""<?xml version="1.0"?><rss xmlns:media="m" xmlns:content="c"><channel><title> The Site </title><image><title>No</title></image>
<item><title>One &amp;amp; two</title><link> https://a.example/1 </link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate>
<description>short</description><content:encoded><![CDATA[<p>Long <b>body</b></p><img src='https://a.example/i.png'>]]></content:encoded>
<media:content url="w140" width="140"/><media:content url="w700" width="700"/><media:thumbnail url="w460" width="460"/></item>
<item><title>mixed</title><link>https://a.example/2</link><description>a <b>b</b> c</description><pubDate>first</pubDate><pubDate>2 Jan 2024 1:00:00 GMT</pubDate><enclosure url="e" type="image/png"/></item>
<item><title></title><link>https://a.example/3</link></item><item><title>m</title><link>mailto:x</link></item><item><title>u</title><link>HTTP://a.example/4</link></item>
</channel></rss>"""
ATOM = b"""<feed><title>Atom</title><entry><title>T</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/a"/>
<link rel="enclosure" type="image/jpeg" href="img" length="900"/><id>tag:1</id><published>2024-01-01T10:00:00Z</published><updated>2024-01-02T10:00:00+02:00</updated><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    docs = [("rss", RSS), ("atom", ATOM), ("rdf", b"<RDF><item><title>x</title><link>https://r.example</link></item></RDF>"), ("bad", RSS[:400]), ("none", None), ("evil", b'<!DOCTYPE a [<!ENTITY x "y">]><rss><channel><title>&x;</title></channel></rss>')]
    raw = feeds.parse_feed_documents(spark.createDataFrame(docs, "feed_id string, body binary"))
    status = {r.feed_id: r.status for r in raw.filter("pos = -1").collect()}
    assert status == {"rss": "ok", "atom": "ok", "rdf": "ok", "bad": "malformed", "none": "malformed", "evil": "malformed"}
    registry = spark.createDataFrame([("rss", "", "News"), ("atom", "Mine", "Tech"), ("rdf", None, "X")], "feed_id string, title string, section string")
    got = {r.item_id: r for r in items.normalise_items(raw, registry).collect()}
    assert set(got) == {"g1", "https://a.example/2", "tag:1"}
    one, two, atom = got["g1"], got["https://a.example/2"], got["tag:1"]
    assert (one.title, one.summary, one.image_url, one.source_title, one.section) == ("One & two", "Long body", "w700", "The Site", "News")
    assert (two.summary, two.image_url, str(two.published_at)) == ("c", "e", "2024-01-02 01:00:00")
    assert (atom.link, atom.image_url, atom.source_title, str(atom.published_at)) == ("https://x.example/a", "img", "Mine", "2024-01-01 10:00:00")


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Mon, 01 Jan 2024 10:00:00 +0000", "2024-01-01 10:00:00"), ("Mon, 1 Jan 2024 10:00:00 GMT", "2024-01-01 10:00:00"), ("Mon, 01 Jan 2024 10:00 EST", "2024-01-01 15:00:00"),
        ("01 Jan 2024 10:00:00 +0130", "2024-01-01 08:30:00"), ("01 Jan 2024 10:00 GMT", None), ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00.123Z", "2024-01-01 10:00:00.123000"),
        ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"), ("2024-01-01 10:00:00 +0000", "2024-01-01 10:00:00"), ("2024-01-01", "2024-01-01 00:00:00"), ("", None), ("garbage", None), ("99 Jan 2024 10:00:00 GMT", None),
    ],
)
def test_dates(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(dates.parse_date(F.col("s"))).first()[0]
    assert (got and str(got)) == want


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_texts(spark):
    assert one(spark, text.decode_entities, "&amp;lt; &nbsp;x &#8217; &#8220;") == "<  x ’ &#8220;"
    assert one(spark, text.html_to_plain, "<p>a b</p>\n<i>&amp;c</i>") == "a b &c"
    assert one(spark, text.clean_summary, "Submitted by x") == "" and one(spark, text.clean_summary, "link:x") == "link:x"
    assert one(spark, text.text_similarity, "Same title", "same TITLE!") == 1 and one(spark, text.text_similarity, "", "x") == 0


def test_urls(spark):
    assert one(spark, urls.normalized_host, "https://u:p@WWW.Ex.org:80/a b?c") == "ex.org" and one(spark, urls.normalized_host, "mailto:x") is None
    assert one(spark, urls.normalise_user_url, " ex.org/f ") == "https://ex.org/f" and one(spark, urls.normalise_user_url, "http://") is None
    assert one(spark, urls.url_join, "https://a.example/x/y", "../z") == "https://a.example/z" and one(spark, urls.url_join, "https://a.example", "http://b.example") == "http://b.example"


def test_discovery_and_images(spark):
    html = """<head><link rel='alternate' type='application/rss+xml' href='/f' title="T"><LINK href=/f type=application/atom+xml rel=alternate><link rel="alternate" type="application/feed+json" href="/j">
    <meta content='/img.png' property="og:image:secure_url"></head><link rel="alternate" type="application/rss+xml" href="/late">"""
    df = spark.createDataFrame([(1, "https://p.example/a/b", html), (2, "https://q.example/", "<p>"), (3, "https://r.example/", "<feed><title> R </title>")], "page_id long, url string, html string")
    crawl = spark.createDataFrame([("https://q.example/rss", "<rss><title>Q</title>"), ("https://q.example/feed", "<html>"), ("https://q.example/atom.xml", "<feed>")], "url string, body string")
    got = sorted((r.page_id, r.url, r.title) for r in pages.discovery_result(df, crawl).collect())
    assert got == [(1, "https://p.example/f", "T"), (2, "https://q.example/rss", "Q"), (3, "https://r.example/", "R")]
    image = {r.page_id: r.i for r in df.select("page_id", pages.og_image(F.col("html"), F.col("url")).alias("i")).collect()}
    assert image == {1: "https://p.example/img.png", 2: None, 3: None}


@pytest.mark.parametrize(
    "html,want",
    [
        ("<title>Story text goes here today | Site</title>", "Story text goes here today"), ("<title>Site: a long story title here</title>", "a long story title here"),
        ("<title>Short</title><h1>The heading is a bit longer than that</h1>", "The heading is a bit longer than that"), ("<title>Two words | Site</title>", "Two words | Site"), ("<p>none", ""),
    ],
)
def test_titles(spark, html, want):
    assert one(spark, pages.article_title, html) == want


def test_article():
    prose = "This sentence, as it stands, is long enough to be counted as prose. " * 4
    html = f"""<html lang="en"><body><nav class="menu"><a href="/">Home of many links and menus in a row</a></nav><h1>My story</h1><div class="byline">By A. Writer</div>
    <div class="article">{"".join(f"<p>{prose}</p>" for _ in range(4))}<p style="display: none">hidden words</p></div><div class="sidebar"><p>{prose}</p></div><footer class="footer">end</footer></body></html>"""
    got = article.readable(html, "My story")
    assert got["status"] == "ok" and got["text"].count("as it stands") == 16 and got["lang"] == "en" and got["byline"] == "By A. Writer"
    assert "hidden" not in got["text"] and "Home" not in got["text"] and "My story" not in got["text"]
    assert article.readable("<p>short</p>")["status"] == "too_short" and article.readable(None)["status"] == "no_article"


def test_opml(spark):
    body = """<opml><body><outline text="Top" xmlUrl="https://a.example/1"/><outline title=" News "><outline text="A &amp; B" xmlurl="https://a.example/2"/><outline text=" "><outline xmlURL="https://a.example/3"/></outline>
    <outline text="x" xmlUrl="ftp://a.example"><outline text="in" xmlUrl="https://a.example/4"/></outline></outline><outline text="cut" xmlUrl="https://a.example/5"/><outline"""
    got = [(r.url, r.title, r.section) for r in opml.import_opml(spark.createDataFrame([("r", body)], "reader_id string, body string")).orderBy("pos").collect()]
    assert got == [
        ("https://a.example/1", "Top", "Imported"), ("https://a.example/2", "A & B", "News"), ("https://a.example/3", None, "Imported"), ("https://a.example/4", "in", "x"), ("https://a.example/5", "cut", "Imported"),
    ]


def test_registry_file(spark, tmp_path):
    (tmp_path / "feeds.json").write_text('[{"feed_id": "a", "url": "u", "section": "s"}, {"feed_id": "b", "url": "v", "section": "s", "is_paused": true, "last_seen_item_ids": ["x"]}]')
    got = {r.feed_id: (r.is_paused, r.last_seen_item_ids, r.title) for r in feeds.read_feed_registry(spark, str(tmp_path / "feeds.json")).collect()}
    assert got == {"a": (False, [], None), "b": (True, ["x"], None)}
    (tmp_path / "bad.json").write_text("{nope")
    assert feeds.read_feed_registry(spark, str(tmp_path / "bad.json")).count() == 0


def test_store(spark, tmp_path):
    path = str(tmp_path / "editions")
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-09")], "row_id long, d string").select("row_id", F.col("d").cast("date").alias("edition_date"))
    store.write_edition(rows, path)
    store.write_edition(rows.filter("row_id = 2").withColumn("row_id", F.lit(20).cast("long")), path)
    assert [r.row_id for r in store.read_edition(spark, path, "2024-01-02").collect()] == [20]
    assert store.read_edition(spark, path, "2023-01-01").count() == 0 and spark.read.parquet(path).count() == 3
    assert {r.row_id for r in store.prune_editions(rows, "2024-01-08").collect()} == {2, 3}
    assert [str(r[0]) for r in store.prunable_dates(rows, "2024-01-08").collect()] == ["2024-01-01"]


def test_decode(spark):
    rows = [("u", "é".encode(), "text/html"), ("l", b"\xe9", None), ("p", b"%PDF-1", None), ("t", b"x", "Application/PDF; q")]
    got = {r.url: (r.html, r.is_pdf) for r in feeds.read_crawl_pages(spark.createDataFrame(rows, "url string, body binary, content_type string")).collect()}
    assert got == {"u": ("é", False), "l": ("é", False), "p": (None, True), "t": (None, True)}
