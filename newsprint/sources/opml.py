"""Subscription lists as OPML."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint import schemas
from newsprint.functions.text import html_escape
from newsprint.functions.urls import host


def _outlines(body: bytes) -> list[tuple[str, str | None, str]]:
    """(url, title, section) of each feed read before the end or the first error."""
    found: list[tuple[str, str | None, str]] = []
    open_: list[str | None] = []  # a section's name, or None for a feed

    def start(tag: str, a: dict[str, str]) -> None:
        if tag.lower() != "outline":
            return
        url = next((a[k].strip() for k in ("xmlUrl", "xmlurl", "xmlURL") if k in a), "")
        text = next((a[k].strip() for k in ("text", "title") if k in a), None)
        if url.startswith(("http:", "https:")) and " " not in url:
            found.append((url, text, next((s for s in reversed(open_) if s is not None), "Imported")))
            open_.append(None)
        else:
            open_.append(text or "Imported")

    def end(tag: str) -> None:
        if tag.lower() == "outline" and open_:
            open_.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(body, True)
    except (expat.ExpatError, ValueError):
        pass
    return found


def import_opml(docs: DataFrame) -> DataFrame:
    """Rows of OPML_ENTRIES from documents (reader_id, body). What stands before an error is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, i, *x) for r, b in zip(batch["reader_id"], batch["body"], strict=True) for i, x in enumerate(_outlines((b or "").encode()))]
            yield pd.DataFrame(rows, columns=["reader_id", "pos", "url", "title", "section"])

    return docs.select("reader_id", "body").mapInPandas(run, schemas.OPML_ENTRIES)


def export_opml(feeds: DataFrame, created: str, name: str = "Subscriptions", keys: tuple[str, ...] = ("reader_id",)) -> DataFrame:
    """One document for each reader: sections and, inside them, feeds in case-insensitive order."""
    label = F.coalesce("title", F.nullif(host(F.col("url")), F.lit("")), "url")
    line = F.concat(
        F.lit('      <outline type="rss" text="'), html_escape(label), F.lit('" title="'), html_escape(label),
        F.lit('" xmlUrl="'), html_escape(F.col("url")), F.lit('"/>\n'),
    )
    row = F.struct(F.lower(F.coalesce("title", "url")).alias("by"), F.col("url").alias("then"), line.alias("line"))
    per = feeds.groupBy(*keys, "section").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = html_escape(F.col("section"))
    block = F.concat(
        F.lit('    <outline text="'), text, F.lit('" title="'), text, F.lit('">\n'),
        F.array_join(F.transform("rows", lambda r: r["line"]), ""), F.lit("    </outline>\n"),
    )
    part = F.struct(F.lower("section").alias("by"), F.col("section").alias("then"), block.alias("block"))
    docs = per.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>{name}</title>\n    <dateCreated>{created}</dateCreated>\n  </head>\n  <body>\n'
    body = F.array_join(F.transform("parts", lambda p: p["block"]), "")
    return docs.select(*keys, F.concat(F.lit(head), body, F.lit("  </body>\n</opml>\n")).alias("body"))
