"""RSS and Atom documents, the subscription registry, and crawled pages."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprint import schemas

_FIRST = {
    "title": "title", "guid": "guid", "id": "guid", "description": "description", "summary": "description",
    "content:encoded": "content", "content": "content",
}
_LAST = {"pubdate": "pub_date", "updated": "updated", "published": "published"}


class _Unsafe(Exception):
    pass


class _FeedReader:
    """State of one document: text gathers since the last tag, the first or last value of a field counts."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.text: list[str] = []
        self.flavour, self.channel = "", ""
        self.item: dict | None = None
        self.items: list[dict] = []

    def read(self, body: bytes) -> list[dict]:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        parser.CharacterDataHandler = self.text.append
        parser.EntityDeclHandler = self.refuse
        parser.Parse(body, True)
        return self.items

    def refuse(self, *_: object) -> None:
        raise _Unsafe("entity declarations are not read")

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.lower()
        self.open.append(name)
        self.text.clear()
        self.flavour = self.flavour or {"rss": "rss", "feed": "atom"}.get(name, "")
        if name in ("item", "entry"):
            self.item = dict.fromkeys(("link", *_FIRST.values(), *_LAST.values()), "") | {"images": []}
        elif self.item is not None:
            self.attributes_of(name, attributes)

    def attributes_of(self, name: str, a: dict[str, str]) -> None:
        image = a.get("type", "").startswith("image/")
        if name == "link" and self.flavour == "atom":
            rel = a.get("rel", "alternate")
            if rel == "alternate":
                self.item["link"] = self.item["link"] or a.get("href", "")
            elif rel == "enclosure" and image:
                self.add_image(a.get("href", ""), a.get("length"))
        elif name == "enclosure" and image and "url" in a:
            self.add_image(a["url"], None)
        elif name in ("media:thumbnail", "media:content") and "url" in a:
            self.add_image(a["url"], a.get("width"))

    def add_image(self, url: str, width: str | None) -> None:
        digits = (width or "").lstrip("+-")
        value = int(width) if digits.isascii() and digits.isdigit() and len(digits) < 10 else 0
        self.item["images"].append({"url": url, "width": value})

    def end(self, tag: str) -> None:
        name, text = tag.lower(), "".join(self.text).strip()
        if self.item is None:
            if name == "title" and not self.channel and {"channel", "feed"} & set(self.open):
                self.channel = text
        elif name in ("item", "entry"):
            self.items.append(self.item)
            self.item = None
        elif name == "link":
            if self.flavour == "rss":
                self.item["link"] = self.item["link"] or text
        elif name in _FIRST:
            self.item[_FIRST[name]] = self.item[_FIRST[name]] or text
        elif name in _LAST:
            self.item[_LAST[name]] = text
        self.open.pop()
        self.text.clear()


def parse_feed_documents(docs: DataFrame) -> DataFrame:
    """Rows of RAW_ITEMS from documents (feed_id, body): one for each entry, and one without an item (pos -1) for each
    document, whose status is ok or malformed. A malformed document gives no items; one of another kind gives none either."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split(" ")[0] for f in schemas.RAW_ITEMS.replace("array<struct<url: string, width: int>>", "images").split(", ")]
        for batch in batches:
            out = []
            for feed, body in zip(batch["feed_id"], batch["body"], strict=True):
                reader, status = _FeedReader(), "ok"
                try:
                    items = reader.read(bytes(body) if body is not None else b"")
                except (expat.ExpatError, _Unsafe, ValueError):
                    items, status = [], "malformed"
                out.append({"feed_id": feed, "channel_title": reader.channel if status == "ok" else None, "pos": -1, "status": status})
                out += [i | {"feed_id": feed, "channel_title": reader.channel, "pos": k, "status": status} for k, i in enumerate(items)]
            yield pd.DataFrame(out, columns=columns).astype(object).where(lambda d: d.notna(), None).astype({"pos": "int32"})

    return docs.select("feed_id", F.col("body").cast("binary").alias("body")).mapInPandas(run, schemas.RAW_ITEMS)


def read_feed_registry(spark: SparkSession, path: str) -> DataFrame:
    """Subscriptions from JSON, with defaults for the fields that older files lack."""
    df = spark.read.schema(schemas.FEEDS).json(path, multiLine=True)
    return df.withColumns(
        {
            "last_seen_item_ids": F.coalesce("last_seen_item_ids", F.array().cast("array<string>")),
            "is_paused": F.coalesce("is_paused", F.lit(False)),
        }
    ).filter(F.col("feed_id").isNotNull())


def decode_body(body: Column) -> Column:
    """UTF-8 if the bytes are, else Latin-1."""
    return F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).otherwise(F.decode(body, "ISO-8859-1"))


def is_pdf(body: Column, content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) | (F.hex(F.substring(body, 1, 4)) == "25504446")


def read_crawl_pages(pages: DataFrame) -> DataFrame:
    """Pages (url, content_type, body) with html (null for a PDF) and is_pdf."""
    pdf = F.coalesce(is_pdf(F.col("body"), F.col("content_type")), F.lit(False))
    return pages.withColumn("is_pdf", pdf).withColumn("html", F.when(~F.col("is_pdf"), decode_body(F.col("body"))))
