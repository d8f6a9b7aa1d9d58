"""Editions: interleaving feeds, the lead, slots and section pages, and the nested form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprint.operators.dedupe import KEYS, order_struct
from newsprint.session import cut

SECONDARIES, BRIEFS = 3, 12


def newest_first(items: DataFrame, *tie: str) -> DataFrame:
    return items.orderBy(F.col("published_at").desc_nulls_last(), *tie)


def top_k_newest(items: DataFrame, k: int = 24, run_keys: tuple[str, ...] = (), tie: tuple[str, ...] = ("feed_id", "item_id", "link")) -> DataFrame:
    """The k newest items: of all (a bounded top-k, no full sort), or of each refresh run."""
    order = [F.col("published_at").desc_nulls_last(), *map(F.col, tie)]
    if not run_keys:
        return items.orderBy(*order).limit(k)
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(*run_keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).drop("rank")


def round_robin(items: DataFrame, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = ()) -> DataFrame:
    """items with rr, a struct that orders an edition: lap by lap one item of each feed, feeds by their newest item."""
    if "gen" not in items.columns:
        items = items.withColumn("gen", F.lit(0))
    own = Window.partitionBy(*keys, "feed_id").orderBy("o")
    out = items.withColumn("o", order_struct(*tie))
    rr = F.struct(F.row_number().over(own).alias("lap"), F.first("o").over(own).alias("head"))
    return out.withColumn("rr", rr).drop("o")


def usable_image(items: DataFrame, checks: DataFrame) -> DataFrame:
    """items with `usable`: there is an image, and no check of it failed (status, size, time, undecodable)."""
    ok = F.col("status").between(200, 299) & (F.col("width") >= 48) & (F.col("height") >= 48) & (F.col("elapsed_s") <= 12)
    failed = checks.filter(~F.coalesce(ok, F.lit(False))).select(F.col("url").alias("image_url")).distinct().withColumn("failed", F.lit(True))
    out = items.join(failed, "image_url", "left")
    return out.withColumn("usable", F.col("image_url").isNotNull() & F.col("failed").isNull()).drop("failed")


def lead_pick(ranked: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rr) of the first usable item of each edition: a minimum, with partial results before the shuffle."""
    return ranked.filter("usable").groupBy(*keys).agg(F.min("rr").alias("rr"))


def validated_lead(ranked: DataFrame, checks: DataFrame, keys: tuple[str, ...] = KEYS, tries: int = 8) -> DataFrame:
    """(keys, rr) of leads: candidates are checked in order; after `tries` failures the next one is taken unchecked."""
    order = Window.partitionBy(*keys).orderBy("rr")
    some = ranked.filter(F.col("image_url").isNotNull()).withColumn("try", F.row_number().over(order)).filter(F.col("try") <= tries + 1)
    judged = usable_image(some, checks)
    return judged.filter(F.col("usable") | (F.col("try") == tries + 1)).groupBy(*keys).agg(F.min("rr").alias("rr"))


def _front(ranked: DataFrame, keys: list[str], leads: DataFrame) -> DataFrame:
    """(keys, rr, slot, slot_rank) of the front page: the lead, and the first 15 of the others, found among the first 16."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rr"))
    top = ranked.select(*keys, "rr").withColumn("n", place).filter(F.col("n") <= SECONDARIES + BRIEFS + 1)
    beside = top.join(leads.select(*keys, F.col("rr").alias("lead")), keys, "left").filter("lead is null or rr <> lead")
    beside = beside.withColumn("n", F.col("n") - F.coalesce(F.col("lead") < F.col("rr"), F.lit(False)).cast("int")).filter(F.col("n") <= SECONDARIES + BRIEFS)
    second = F.col("n") > SECONDARIES
    others = beside.select(*keys, "rr", F.when(second, "brief").otherwise("secondary").alias("slot"), (F.col("n") - F.when(second, SECONDARIES).otherwise(0)).alias("slot_rank"))
    return others.unionByName(leads.select(*keys, "rr", F.lit("lead").alias("slot"), F.lit(1).alias("slot_rank")))


def slots(ranked: DataFrame, keys: tuple[str, ...] = KEYS, leads: DataFrame | None = None) -> DataFrame:
    """ranked with slot, slot_rank and page_no: the lead, three secondaries, twelve briefs, then section pages.

    The front page needs the first 16 rows of an edition only: Spark's group limit stops there. It is written, 16 rows an
    edition, and joined once; the others are ranked inside their section, so no task gets a whole edition to sort.
    """
    keys = list(keys)
    leads = lead_pick(ranked, tuple(keys)) if leads is None else leads
    front = cut(_front(ranked, keys, cut(leads.select(*keys, "rr"))))
    own = F.when(F.col("slot").isNull(), F.struct("section"))
    rank = F.row_number().over(Window.partitionBy(*keys, own).orderBy("rr"))
    placed = ranked.join(front, [*keys, "rr"], "left").withColumn("slot_rank", F.coalesce("slot_rank", rank))
    names = ranked.select(*keys, "section", "rr").join(front.select(*keys, "rr"), [*keys, "rr"], "left_anti").select(*keys, "section").distinct()
    page = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.lower("section"), "section")) + 1
    pages = names.select(*keys, F.struct("section").alias("own"), page.alias("page"))
    out = placed.withColumn("own", own).join(pages, [*keys, "own"], "left")
    out = out.withColumns({"page_no": F.when(F.col("slot").isNull(), F.col("page")).otherwise(1), "slot": F.coalesce("slot", F.lit("section"))})
    return out.select(*ranked.columns, "slot", "slot_rank", "page_no")


def front_page(ranked: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return slots(ranked, keys).filter(F.col("slot") != "section")


def section_pages(placed: DataFrame, keys: tuple[str, ...] = KEYS, *columns: str) -> DataFrame:
    """One row for each section page, its items in order."""
    items = F.array_sort(F.collect_list(F.struct("slot_rank", *columns)))
    return placed.filter("slot = 'section'").groupBy(*keys, "section", "page_no").agg(items.alias("items"))


def edition_summary(placed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n_items, has_lead, n_sections, total_pages, is_empty)."""
    is_section = F.col("slot") == "section"
    out = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.coalesce(F.max(F.when(F.col("slot") == "lead", 1)), F.lit(0)).alias("has_lead"),
        F.count_distinct(F.when(is_section, F.col("section"))).alias("n_sections"),
    )
    return out.withColumns({"total_pages": F.greatest(F.lit(1), 1 + F.col("n_sections")), "is_empty": F.col("n_items") == 0})


def page_titles(placed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, page_no, title): the front page, then the sections."""
    front = placed.select(*keys).distinct().select(*keys, F.lit(1).alias("page_no"), F.lit("Front Page").alias("title"))
    rest = placed.filter("slot = 'section'").select(*keys, "page_no", F.col("section").alias("title")).distinct()
    return front.unionByName(rest)


def edition_nest(placed: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One document for each edition: lead, secondaries, briefs and sections as nested arrays."""
    item = F.struct("slot_rank", *columns)

    def of(slot: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("slot") == slot, item)))

    top = placed.groupBy(*keys).agg(of("lead").alias("lead"), of("secondary").alias("secondaries"), of("brief").alias("briefs"))
    pages = section_pages(placed, keys, *columns)
    sections = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", F.col("section").alias("name"), "items"))).alias("sections"))
    out = top.join(sections, list(keys), "left")
    return out.select(*keys, F.get("lead", F.lit(0)).alias("lead"), "secondaries", "briefs", "sections")


def edition_flatten(nested: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of nested editions again, with slot, slot_rank and page_no, in the order of the paper."""
    top = F.concat(
        F.transform(F.array_compact(F.array("lead")), lambda x: F.struct(F.lit("lead").alias("slot"), F.lit(1).alias("page_no"), x.alias("item"))),
        F.transform("secondaries", lambda x: F.struct(F.lit("secondary").alias("slot"), F.lit(1).alias("page_no"), x.alias("item"))),
        F.transform("briefs", lambda x: F.struct(F.lit("brief").alias("slot"), F.lit(1).alias("page_no"), x.alias("item"))),
        F.coalesce(
            F.flatten(
                F.transform(
                    "sections",
                    lambda s: F.transform(s["items"], lambda x: F.struct(F.lit("section").alias("slot"), s["page_no"].alias("page_no"), x.alias("item"))),
                )
            ),
            F.array(),
        ),
    )
    return nested.select(*keys, F.explode(top).alias("r")).select(*keys, "r.slot", "r.page_no", "r.item.*")
