"""Views that stand for the library's tables, derived from the given ones by the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprint.operators.sieve import may_match, sieve

#: name -> (source, columns as (name, expression), filter). The expressions mean the same in both dialects.
VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "items_ev": (
        "events",
        {
            "row_id": "event_id",
            "feed_id": "cast(user_id as string)",
            "item_id": "event_type || '-' || cast(cast(floor(value) as bigint) as string)",
            "title": "event_type || ' ' || cast(event_id as string)",
            "link": "'https://' || case when event_id % 2 = 0 then 'www.' else '' end || 'Site' || cast(user_id % 7 as string) || '.example/a/' || regexp_extract(props, '[0-9]+', 0)",
            "summary": "'about ' || event_type",
            "image_url": "case when event_id % 3 = 0 then 'https://img' || cast(user_id % 5 as string) || '.example/' || regexp_extract(props, '[0-9]+', 0) || '.png' end",
            "published_at": "ts",
            "edition_date": "cast(ts as date)",
            "section": "event_type",
            "source_title": "'Feed ' || cast(user_id as string)",
        },
        "true",
    ),
    "fetch_log_ev": (
        "events",
        {"run": "cast(ts as date)", "feed_id": "cast(user_id as string)", "ts": "ts", "ok": "event_type <> 'error'", "seq": "event_id"},
        "true",
    ),
    "read_log_ev": (
        "events",
        {
            "reader_id": "cast(user_id % 20 as string)",
            "item_id": "event_type || '-' || cast(cast(floor(value) as bigint) as string)",
            "op": "case when event_type = 'click' then 'unread' when event_id % 500 = 7 then 'clear' else 'read' end",
            "seq": "event_id",
        },
        "true",
    ),
    "reads_ev": (
        "events",
        {"reader_id": "cast(user_id as string)", "item_id": "event_type || '-' || cast(cast(floor(value) as bigint) as string)"},
        "event_type = 'view' and value < 10",
    ),
    "items_doc": (
        "documents",
        {
            "row_id": "doc_id",
            "item_id": "cast(doc_id as string)",
            "feed_id": "source",
            "text": "coalesce(text, '')",
            "section": "lang",
        },
        "true",
    ),
    "pages_x": (
        "pages",
        {
            "page_id": "page_id",
            "url": "url",
            "html": "replace(html, '<head>', '<head>' || "
            "case page_id % 5 when 0 then '<meta property=\"og:image\" content=\"https://img.example/' || cast(page_id as string) || '.png\">' "
            "when 1 then '<meta content=\"https://img.example/' || cast(page_id as string) || '.jpg\" name=\"twitter:image:src\">' "
            "when 2 then '<link rel=\"image_src\" href=\"https://img.example/' || cast(page_id as string) || '.gif\">' "
            "when 3 then '<meta property=\"og:image\" content=\"data:x\">' else '' end || "
            "case page_id % 4 when 0 then '<link rel=\"alternate\" type=\"application/rss+xml\" title=\"Feed ' || cast(page_id as string) || '\" href=\"https://feeds.example/' || cast(page_id as string) || '\">"
            "<link rel=alternate type=application/atom+xml href=https://feeds.example/atom>' "
            "when 1 then '<link rel=\"alternate\" type=\"application/json\" href=\"https://feeds.example/j\">' else '' end || "
            "case page_id % 3 when 0 then '<meta property=\"og:title\" content=\"Title &amp; ' || cast(page_id as string) || '\"><meta name=\"Author\" content=\"A. Writer\">' "
            "when 1 then '<meta name=\"description\" content=\"first\"><meta name=\"description\" content=\" about ' || cast(page_id as string) || ' \"><meta property=\"og:site_name\" content=\"Site\">' else '' end)",
        },
        "true",
    ),
}

#: Tables that need more than a projection, in SQL that both dialects read; they may name views above them.
TABLES: dict[str, str] = {
    "feeds_ev": """
        select cast(user_id as string) as feed_id,
               'https://Site' || cast(user_id % 7 as string) || '.example/feed/' || cast(user_id as string) || case when user_id % 2 = 0 then '/' else '' end as url,
               event_type as section,
               case when user_id % 9 <> 0 then 'Feed ' || cast(user_id as string) end as title,
               user_id % 10 = 0 as is_paused, user_id
        from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as rn
              from events group by user_id, event_type) t
        where rn = 1""",
    "image_checks_ev": """
        select url, cast(case when k % 4 = 0 then 404 else 200 end as int) as status, cast(case when k % 7 = 0 then 10 else 640 end as int) as width,
               480 as height, case when k % 11 = 0 then 13.0 else 0.5 end as elapsed_s
        from (select distinct image_url as url, cast(regexp_extract(image_url, '/([0-9]+)[.]png', 1) as int) as k from items_ev where image_url is not null) t""",
    "moves_doc": """
        select cast(d.doc_id as string) as item_id, d.doc_id + 1000000000 as seq, d.lang as section, coalesce(d.text, '') as text
        from documents d join labels l on d.doc_id = l.doc_id
        union all
        select cast(d.doc_id as string) as item_id, d.doc_id as seq, 'zz' as section, coalesce(d.text, '') as text
        from documents d join labels l on d.doc_id = l.doc_id where d.doc_id % 5 = 0""",
    "crawl_x": """
        select regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || case page_id % 3 when 0 then '/rss' when 1 then '/feed' else '/index.xml' end as url,
               min(case when page_id % 2 = 0 then '<?xml?><RSS><channel><title> T ' || cast(page_id % 3 as string) || ' </title>' else '<html>' end) as body
        from pages group by 1""",
}

_NEEDS = {"image_checks_ev": ("items_ev",)}
_SOURCES = ("events", "documents", "pages", "labels")


def projection(name: str) -> str:
    source, columns, where = VIEWS[name]
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source} where {where}"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of moves_doc from one join by item, which the last move of each item needs anyway: texts are shuffled once,
    and of texts without a label only the few that the sieve lets through."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").withColumn("item_id", F.col("doc_id").cast("string")) for t in ("documents", "labels"))
    ids = labels.select("item_id").filter("item_id is not null")
    found = may_match(docs, F.col("item_id"), sieve(ids, "item_id")).filter("may").join(ids, "item_id")
    by_lang = F.struct((F.col("doc_id") + 1_000_000_000).alias("seq"), F.col("lang").alias("section"))
    by_id = F.struct(F.col("doc_id").alias("seq"), F.lit("zz").alias("section"))
    moves = F.when(F.col("doc_id") % 5 == 0, F.array(by_lang, by_id)).otherwise(F.array(by_lang))
    return found.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.inline(moves)).select("item_id", "seq", "section", "text")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the given tables."""
    if name == "moves_doc":
        return _moves(spark, sf_dir)
    if name in VIEWS:
        source, columns, where = VIEWS[name]
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(where)
        return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
    text = TABLES[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES if f" {t}" in text}
    frames |= {t: view(spark, sf_dir, t) for t in _NEEDS.get(name, ())}
    query = text
    for t in frames:
        for before in ("from ", "join "):
            query = query.replace(f"{before}{t} ", f"{before}{{{t}}} ").replace(f"{before}{t}\n", f"{before}{{{t}}}\n")
        if query.endswith(f"from {t}"):
            query = query[: -len(t)] + f"{{{t}}}"
    return spark.sql(query, **frames)


def with_views(select: str, *names: str, ctes: tuple[str, ...] = ()) -> str:
    """DuckDB SQL: a select behind the views that it names and further tables of its own."""
    order = [n for need in names for n in (*_NEEDS.get(need, ()), need)]
    parts = [f"{n} as ({projection(n) if n in VIEWS else TABLES[n]})" for n in dict.fromkeys(order)]
    parts += ctes
    return f"with recursive {', '.join(parts)} {select}" if parts else select
