"""Null keys, readers of their own, deletion, JSON documents, the shared folder, and article pages of many kinds."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsprint import session
from newsprint.operators import article, classify, dedupe, editions, filters
from newsprint.plans import publish, reflow
from newsprint.sources import store

ITEMS = "row_id long, reader_id string, feed_id string, item_id string, link string, published_at timestamp, section string, image_url string, edition_date date"


def items(spark, rows):
    from datetime import date, datetime

    day = {None: None, 1: date(2024, 1, 1), 2: date(2024, 1, 2)}
    return spark.createDataFrame([(i, reader, feed, item, link, datetime(2024, 1, 1), "s", None, day[d]) for i, reader, feed, item, link, d in rows], ITEMS)


def test_dedupe_null_keys(spark):
    rows = [(1, "a", "f", "x", "l1", None), (2, "a", "f", "x", "l2", None), (3, "a", "f", "x", "l3", 1), (4, None, "f", "y", "L1", None), (5, "a", None, None, None, 1), (6, "a", None, None, None, 1)]
    df = items(spark, rows)
    assert {r.row_id for r in dedupe.dedupe_items(df, tie=("row_id",)).collect()} == {1, 3, 5}
    assert {r.row_id for r in dedupe.dedupe_items(df, ("reader_id", "edition_date"), ("row_id",)).collect()} == {1, 3, 4, 5}
    assert dedupe.dedupe_items(df.filter("row_id = 4"), most_rounds=3).columns == [*df.columns, "gen"]
    assert {r.row_id for r in publish.place(df, tie=("row_id",)).collect()} == {3, 5}
    with pytest.raises(ValueError, match="names itself"):
        dedupe.dedupe_items(df.withColumn("key0", F.lit(1)))


def test_readers_have_filters_of_their_own(spark):
    rows = [(2 * i + (r == "b"), r, f"f{i % 3}", f"i{i}", f"https://h{i % 4}.example/{i}", 1) for i in range(24) for r in "ab"]
    df = items(spark, rows)
    by = ("reader_id",)
    feeds = spark.createDataFrame([(r, f"f{k}", (r, k) == ("a", 1), f"{r}-sec") for r in "ab" for k in range(3)], "reader_id string, feed_id string, is_paused boolean, section string")
    hosts = spark.createDataFrame([("b", "h2.example")], "reader_id string, host string")
    read = spark.createDataFrame([("a", "i0"), ("b", "i3"), ("b", "i3")], "reader_id string, item_id string")
    pins = spark.createDataFrame([("a", "i5", "pinned")], "reader_id string, item_id string, section string")
    out = reflow.reflow(df, feeds, hosts, read, pins, pins.limit(0), keys=("reader_id", "edition_date"), tie=("row_id",)).collect()
    got = {r: {x.item_id for x in out if x.reader_id == r} for r in "ab"}
    assert got["a"] == {f"i{i}" for i in range(24) if i % 3 != 1 and i != 0}
    assert got["b"] == {f"i{i}" for i in range(24) if i % 4 != 2 and i != 3}
    assert {(x.reader_id, x.section) for x in out if x.item_id == "i5"} == {("a", "pinned"), ("b", "b-sec")}
    assert Counter(x.reader_id for x in out if x.slot == "secondary") == {"a": 3, "b": 3}
    only_a = filters.hide_read(df, read.filter("reader_id = 'a'"), (*by, "item_id"))
    assert only_a.filter("reader_id = 'b'").count() == 24


def test_retention_deletes(spark, tmp_path):
    path = f"{tmp_path}/editions"
    ev = spark.range(40).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("edition_date"))
    store.write_edition(ev, path)
    assert store.drop_pruned(spark, path, "2024-01-10", 3) == [f"2024-01-{d:02}" for d in range(1, 8)]
    assert spark.read.parquet(path).count() == 12 and store.drop_pruned(spark, path, "2024-01-10", 3) == []
    assert sorted(f.name for f in (tmp_path / "editions").glob("edition*")) == ["edition_date=2024-01-08", "edition_date=2024-01-09", "edition_date=2024-01-10"]


def test_edition_documents(spark, tmp_path):
    import json

    rows = [(i, "a", f"f{i % 5}", f"i{i}", f"l{i}", 1 + i % 2) for i in range(60)]
    nested = editions.edition_nest(publish.place(items(spark, rows), tie=("row_id",)), ["row_id", "image_url", "published_at"])
    store.write_documents(nested, f"{tmp_path}/d")
    files = {f.parent.name: f.read_text().splitlines() for f in (tmp_path / "d").glob("*/part-*")}
    assert set(files) == {"edition_date=2024-01-01", "edition_date=2024-01-02"} and all(len(x) == 1 for x in files.values())
    doc = json.loads(files["edition_date=2024-01-01"][0])
    assert list(doc) == ["edition_date", "briefs", "lead", "secondaries", "sections"] and doc["edition_date"] == "2024-01-01"
    assert doc["briefs"][0]["published_at"] == "2024-01-01T00:00:00Z" and doc["briefs"][0]["image_url"] is None
    # a day is replaced as a whole, the other one stays
    store.write_documents(nested.filter("edition_date = '2024-01-01'").withColumn("briefs", F.slice("briefs", 1, 2)), f"{tmp_path}/d")
    again = {str(r.edition_date): len(r.briefs) for r in store.read_documents(spark, f"{tmp_path}/d", nested.schema).collect()}
    assert again == {"2024-01-01": 2, "2024-01-02": 12}


def test_shared_folder_is_asked_for_on_a_cluster(tmp_path):
    def on(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return session.shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context))

    assert on("local[4]") and on("yarn", "hdfs:///shared") == "hdfs:///shared"
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            on(master)


def test_margin_of_ties_and_single_sections(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", -5.0), ("b", "x", 2.0), ("c", "x", -3.0), ("c", "y", -1.5)], "item_id string, section string, score double")
    assert {tuple(r) for r in classify.predict_margin(scores).collect()} == {("a", "y", 0.0), ("b", "x", None), ("c", "y", 1.5)}


def test_tokens_count_clusters(spark):
    texts = ["ab abc " + "x" * 24 + " " + "y" * 25, "e\u0301e\u0301 e\u0301e\u0301e\u0301 \u00e9\u00e9\u00e9 \u00e9\u00e9", "Ünïcode ß ßßß The"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(classify.tokenise(F.col("x")).alias("t")).collect()]
    assert got == [["abc", "x" * 24], ["e\u0301" * 3, "\u00e9\u00e9\u00e9"], ["ünïcode", "ßßß"]]


def test_similarity_of_long_texts(spark):
    import time

    from newsprint.functions import text

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("a b c c", "c d d e"), ("", "a"), ("a", ""), (None, "a"), ("A_b, x", "a_b x"), ("x x x", "y"), (long, long + " extra extra")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    began = time.time()
    got = [round(r.s, 9) for r in df.select("i", text.text_similarity(F.col("a"), F.col("b")).alias("s")).sort("i").collect()]
    assert got == [round(x, 9) for x in (1 - 5 / 7, 0.0, 0.0, 0.0, 1.0, 0.0, 1 - 11 / len(rows[-1][1]))]
    assert time.time() - began < 20


PROSE = "This sentence, as it stands, is long enough to be counted as prose of a story. " * 3


def page(body: str) -> str:
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


BODIES = {
    "paragraphs": "<div>" + f"<p>{PROSE}</p>" * 5 + "</div>",
    "article tag": "<article>" + f"<p>{PROSE}</p>" * 5 + "</article>",
    "text and breaks": "<div>" + f"{PROSE}<br><br>" * 5 + "</div>",
    "inline children": "<div>" + f"{PROSE}<wbr><samp>code</samp> <ruby>r</ruby> <dfn>d</dfn> <data>v</data>" * 5 + "</div>",
    "navigation beside": f"<div class='sidebar'><p>{PROSE}</p></div><div class='content'>" + f"<p>{PROSE}</p>" * 5 + "</div>",
    "footer below": "<div class='post'>" + f"<p>{PROSE}</p>" * 5 + "</div><footer class='footer'><p>all rights</p></footer>",
    "list inside": "<div class='entry'>" + f"<p>{PROSE}</p>" * 5 + "<ul><li>one point</li><li>another</li></ul></div>",
    "table cell": "<table><tr><td>" + f"<p>{PROSE}</p>" * 5 + "</td></tr></table>",
    "unclosed": "<div>" + f"<p>{PROSE}" * 5,
    "hidden part": "<div>" + f"<p>{PROSE}</p>" * 5 + "<p hidden>secret words</p></div>",
}


@pytest.mark.parametrize("name", list(BODIES))
def test_article_pages(name):
    got = article.readable(page(BODIES[name]), "T")
    assert got["status"] == "ok" and got["text"].count("as it stands") == 15
    assert not any(x in got["text"] for x in ("all rights", "secret words"))


def test_inline_elements_do_not_split_a_paragraph():
    for tag in sorted(article.PHRASING - article.VOID - {"script", "noscript", "select", "button", "textarea", "input", "object", "embed", "datalist", "del", "ins"}):
        attempt = article._Attempt(page(f"<div><p>x</p>{PROSE}<{tag}>word</{tag}> {PROSE}</div>"), "T", False, False)
        attempt.prepare(attempt.body)
        div = next(n for n in attempt.body.walk() if n.tag == "div")
        assert [k.tag for k in div.kids if not isinstance(k, str)] == ["p", "p"], tag


def test_deep_pages_keep_their_text(spark):
    deep = page("<div>" * 4000 + f"<p>{PROSE}</p>" * 5 + "</div>" * 4000)
    got = article.extract_article(spark.createDataFrame([(1, deep)], "page_id long, html string")).first()
    assert got.status == "ok" and got.text.count("as it stands") == 15
