"""A paper that grows: arriving items change only the part of their day that they are connected with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StructField, StructType

from newsprint.operators.components import components
from newsprint.operators.dedupe import dedupe_items, order_struct
from newsprint.session import cut
from newsprint.sources import store

#: All items that have come, with their component and whether they are kept; and the component of each link and id.
ROWS, NAMES = "_seen/rows", "_seen/names"
_NAME_FIELDS = StructType([StructField("edition_date", DateType()), StructField("bucket", IntegerType()), StructField("name", LongType()), StructField("comp", LongType())])


def _bucket(name: Column | str, buckets: int) -> Column:
    return F.pmod(F.col(name) if isinstance(name, str) else name, F.lit(buckets)).cast("int")


def _parts(df: DataFrame, table: str) -> set[str]:
    """The parts (edition_date, bucket) that df has rows of: their number is bounded by days times buckets."""
    return {f"{table}/edition_date={r.edition_date}/bucket={r.bucket}".lstrip("/") for r in df.select("edition_date", "bucket").distinct().collect()}


def _read(df: DataFrame, path: str, table: str, schema: StructType) -> tuple[DataFrame, set[str]]:
    parts = _parts(df, table)
    return store.read_parts(df.sparkSession, path, table, parts.__contains__, schema), parts


def add_items(items: DataFrame, path: str, tie: tuple[str, ...] = (), buckets: int = 8) -> None:
    """Adds items (with edition_date) to the stored paper, which then holds what one dedupe of all items so far keeps.

    Dropped items are remembered, since an item that comes later may drop the one that dropped them. Items that share a
    link or an id, directly or over others, are a component; what arrives changes only the components that it touches, so
    only these are deduped again. They are found by the names (links and ids) of the arriving items: names and items
    lie in hash buckets of their day, of which a batch reads and writes those it touches. All parts are swapped at once,
    and an item that is already there changes nothing, so a batch can run again.

    Days that were stored as a whole (by write_edition) are taken over as they are, behind what arrives.
    """
    spark = items.sparkSession
    fresh = items.filter("edition_date is not null").withColumn("edition_date", F.col("edition_date").cast("date"))
    fresh = cut(fresh if "gen" in fresh.columns else fresh.withColumn("gen", F.lit(0)))
    columns = fresh.columns
    days = {str(r[0]) for r in fresh.select("edition_date").distinct().collect()}
    if not days:
        return
    whole = (days & set(store.stored_days(spark, path))) - store.tables_of(spark, path).get(ROWS, set())
    if whole:
        stored = store.read_editions(spark, path, whole, StructType([f for f in fresh.schema if f.name != "gen"]))
        fresh = cut(fresh.unionByName(stored.withColumn("gen", F.lit(1))))
    link, id_ = F.coalesce(F.lower("link"), F.lit("")), F.coalesce("item_id", F.lit(""))
    ends = {"a": F.xxhash64(F.lit("link"), "edition_date", link), "b": F.xxhash64(F.lit("id"), "edition_date", id_)}
    fresh = fresh.withColumns(ends)

    def names_of(df: DataFrame) -> DataFrame:
        named = df.select("edition_date", F.explode(F.array("a", "b")).alias("name"), *(c for c in df.columns if c == "comp")).distinct()
        return named.withColumn("bucket", _bucket("name", buckets))

    asked = cut(names_of(fresh))
    known, _ = _read(asked, path, NAMES, _NAME_FIELDS)
    met = cut(known.join(asked, ["edition_date", "bucket", "name"], "left_semi").select("edition_date", "name", "comp"))
    roots = components(fresh.select("a", "b").unionByName(met.select(F.col("name").alias("a"), F.col("comp").alias("b"))))
    # A component is called by one of its names, so names and components are nodes of one graph.
    root_of = roots.withColumnRenamed("root", "new")
    old = cut(met.select("edition_date", "comp").distinct().withColumn("bucket", _bucket("comp", buckets)))
    schema = StructType([*fresh.schema, StructField("comp", LongType()), StructField("kept", BooleanType()), StructField("bucket", IntegerType())])
    seen, _ = _read(old, path, ROWS, schema)
    touched = seen.join(old, ["edition_date", "bucket", "comp"], "left_semi").drop("kept", "bucket")
    again = touched.join(root_of, touched.comp == root_of.node, "left").withColumn("comp", F.coalesce("new", "comp")).drop("node", "new")
    arrived = fresh.join(root_of, fresh.a == root_of.node).withColumnRenamed("new", "comp").drop("node")
    every = again.unionByName(arrived).withColumn("o", order_struct(*tie))
    every = cut(every.dropDuplicates(["edition_date", "o"]).drop("o"))
    kept = dedupe_items(every.select(*columns), tie=tie)
    marked = every.withColumn("o", order_struct(*tie)).join(kept.select("edition_date", order_struct(*tie).alias("o"), F.lit(True).alias("kept")), ["edition_date", "o"], "left")
    marked = marked.withColumn("kept", F.coalesce("kept", F.lit(False))).drop("o").withColumn("bucket", _bucket("comp", buckets))
    marked = cut(marked.select(*schema.fieldNames()))
    # Whole buckets are written: those of the old components, which may have moved, and those of the new ones.
    stale = old.select("edition_date", "bucket").unionByName(marked.select("edition_date", "bucket")).distinct()
    beside, row_parts = _read(stale, path, ROWS, schema)
    rows = cut(beside.join(old, ["edition_date", "bucket", "comp"], "left_anti").unionByName(marked))
    new_names = cut(names_of(marked.select("edition_date", "a", "b", "comp")))
    others, name_parts = _read(new_names, path, NAMES, _NAME_FIELDS)
    names = others.join(new_names, ["edition_date", "bucket", "name"], "left_anti").unionByName(new_names.select(*_NAME_FIELDS.fieldNames()))
    edition = rows.filter("kept").select(*columns, "bucket")
    replaced = row_parts | name_parts | {p.removeprefix(f"{ROWS}/") for p in row_parts} | {f"edition_date={d}" for d in whole}
    store.publish({"": edition, ROWS: rows, NAMES: names}, path, ("edition_date", "bucket"), lambda part, _: part in replaced)
