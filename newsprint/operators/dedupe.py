"""First-seen dedupe by two keys, and carrying an edition over."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprint.operators.components import components
from newsprint.session import cut

KEYS = ("edition_date",)


def order_struct(*extra: str) -> Column:
    """The total order of items: newest first, then fresh before prior, feed, id, link, and further columns."""
    return F.struct(
        (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(-(2**62)))).alias("age"),
        F.col("gen").alias("gen"),
        F.col("feed_id").alias("feed_id"),
        F.col("item_id").alias("item_id"),
        F.col("link").alias("link"),
        *[F.col(c).alias(c) for c in extra],
    )


def carry_over(fresh: DataFrame, prior: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Fresh items and those already published, with gen 0 and 1; of the latter only those whose feed is still there."""
    kept = prior if feeds is None else prior.join(feeds.select("feed_id").distinct(), "feed_id", "left_semi")
    return fresh.withColumn("gen", F.lit(0)).unionByName(kept.withColumn("gen", F.lit(1)), allowMissingColumns=True)


def _in_order(left: DataFrame, keys: list[str], most_rows: int) -> tuple[DataFrame, DataFrame]:
    """The kept among the undecided rows, item by item in order, and the rows of components of over `most_rows`.

    Items that share a link or an id, directly or over others, decide on one another; other items do not. So each such
    component is a group of its own, in which the rule is applied as it reads.
    """
    link, id_ = F.xxhash64(F.lit("link"), *keys, "lk"), F.xxhash64(F.lit("id"), *keys, "ik")
    left = left.withColumns({"a": link, "b": id_})
    rooted = left.join(components(left).withColumnRenamed("node", "a"), "a").drop("a", "b")
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    placed = rooted.join(sizes, "root").withColumn("m", F.col("m") <= most_rows)
    small = placed.filter("m").drop("m").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("o")))
    small = cut(small)

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        links, ids, out = set(), set(), []
        for place, lk, ik, *key in pdf.sort_values("place")[["place", "lk", "ik", *keys]].itertuples(index=False):
            if (lk, *key) not in links and (ik, *key) not in ids:
                links.add((lk, *key))
                ids.add((ik, *key))
                out.append(place)
        return pd.DataFrame({"root": pdf["root"].iloc[0], "place": out})

    chosen = small.select("root", "place", "lk", "ik", *keys).groupBy("root").applyInPandas(kept, "root long, place int")
    return cut(small.join(chosen, ["root", "place"], "left_semi").select(*keys, "o", "lk", "ik")), cut(placed.filter("not m").select(*keys, "lk", "ik", "o"))


def dedupe_items(items: DataFrame, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = (), most_rounds: int = 200, in_order_from: int = 5, most_rows: int = 200_000) -> DataFrame:
    """Items that no earlier *kept* item of their edition shares the lower-cased link or the id with.

    The greedy rule goes in parallel rounds: an undecided item that comes first for both its link and its id is kept, and
    the undecided items that share either with a kept one go. Minima are group-bys with partial results, so a guid that
    very many items share costs a row a task, and only the minima of either kind meet in a join; the anti joins that
    follow start from plain shuffles, of which Spark can split a hot key's. Each round works on what the last one left.

    A round settles at least the ends of a chain in which each item shares its link or id with the next, which would take
    as many rounds as the chain is long. So after `in_order_from` rounds the few items still undecided are gathered into
    components, and those of up to `most_rows` items are decided at once, in order; larger ones go on in rounds.

    A null key (an undated item has no edition date) is an edition of its own: joins take null for a value.
    """
    named = {f"key{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)} | {f"none{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    keys, whole = list(named), items.columns
    if clash := {c.lower() for c in whole} & {*keys, "o", "lk", "ik"}:
        raise ValueError(f"dedupe_items uses these column names itself: {sorted(clash)}")
    if "gen" not in items.columns:
        items = items.withColumn("gen", F.lit(0))
    key = F.coalesce(F.lower("link"), F.lit("")).alias("lk"), F.coalesce("item_id", F.lit("")).alias("ik")
    left, kept = items.select(*[c.alias(k) for k, c in named.items()], *key, order_struct(*tie).alias("o")), None
    for done in range(1, most_rounds + 1):
        by_link = left.groupBy(*keys, "lk").agg(F.min("o").alias("o"))
        by_id = left.groupBy(*keys, "ik").agg(F.min("o").alias("o"))
        won = cut(by_link.join(by_id, [*keys, "o"]).select(*keys, "o", "lk", "ik"))
        kept = won if kept is None else kept.unionByName(won)
        rest = left.join(won.select(*keys, "lk"), [*keys, "lk"], "left_anti").join(won.select(*keys, "ik"), [*keys, "ik"], "left_anti")
        left = cut(rest)
        if left.isEmpty():
            break
        if done % in_order_from == 0:
            won, left = _in_order(left, keys, most_rows)
            kept = kept.unionByName(won)
            if left.isEmpty():
                break
    else:
        raise RuntimeError(f"dedupe did not settle in {most_rounds} rounds")
    chosen = kept.select(*keys, "o")
    # The order and the keys are expressions here, not columns, so that what is shuffled of all items has each value once.
    same = [c == chosen[k] for k, c in named.items()]
    out = items.join(chosen, [*same, order_struct(*tie) == chosen["o"]], "left_semi").withColumns(named | {"o": order_struct(*tie)})
    return out.dropDuplicates([*keys, "o"]).select(*whole, *([] if "gen" in whole else ["gen"]))
