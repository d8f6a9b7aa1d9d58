"""The paper as streams: landing items, first sightings, counts by day, feed health, classification, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsprint.operators.classify import nb_best, nb_model, occurrences
from newsprint.operators.filters import read_state
from newsprint.operators.registry import fetch_state
from newsprint.plans.accumulate import add_items
from newsprint.sources.store import drop_pruned
from newsprint.streaming.stateful import day_timing, keyed_state, read_changes


def timestamps(df: DataFrame, column: str = "published_at") -> DataFrame:
    """A watermark needs a timestamp with a zone; tables often hold one without."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_dedupe(items: DataFrame, key: str = "link", delay: str = "1 day") -> DataFrame:
    """The first sighting of a link (or id) on its day. State lasts as long as the watermark."""
    keyed = timestamps(items).withColumns({"edition_date": F.to_date("published_at"), "seen": F.lower(F.col(key))})
    return keyed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["edition_date", "seen"]).drop("seen")


def stream_day_counts(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """(edition_date, feed_id, n) for tumbling days; rows later than the watermark are left out."""
    day = F.window("published_at", "1 day")
    counts = timestamps(items).withWatermark("published_at", delay).groupBy(day.alias("w"), "feed_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("w.start").alias("edition_date"), "feed_id", "n")


def stream_late_items(items: DataFrame, today: str) -> DataFrame:
    """Items with `timing`: late ones (before today) stay out of today's paper, early ones wait for their day.

    Late here is by the calendar; what a watermark leaves out never reaches stream_day_counts or stream_dedupe, and
    is what stream_late_table has in a table of its own.
    """
    day, now = F.to_date("published_at"), F.lit(today).cast("date")
    return items.withColumn("timing", F.when(day < now, "late").when(day > now, "early").otherwise("today"))


def stream_feed_health(log: DataFrame) -> DataFrame:
    """Last success and failure of each feed, updated with every batch."""
    return fetch_state(log)


def stream_classify(items: DataFrame, counts: DataFrame, stats: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Predictions for arriving items with the model as it stands, batch by batch.

    The model is written once, in the form that items join (see classify.nb_model); a batch joins its items with it and
    writes nothing but its predictions. Every batch is a partition of its own, written as a whole: one that runs again
    after a failure replaces its rows.
    """
    model = nb_model(counts, stats)

    def batch(df: DataFrame, number: int) -> None:
        nb_best(occurrences(df), *model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_late_table(items: DataFrame, out: str, checkpoint: str, delay: str = "1 day", salts: int = 16, trigger: dict | None = None) -> StreamingQuery:
    """Every item in one of the tables timing=on_time, timing=late and timing=undated under out, and the sizes of days
    that have closed in timing=closed (see stateful.day_timing). A batch that is run again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("timing", "batch").mode("overwrite")
        rows.option("partitionOverwriteMode", "dynamic").parquet(out)

    with keyed_state(items.sparkSession):
        query = day_timing(items, delay, salts).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def stream_read_state(log: DataFrame, out: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> DataFrame | StreamingQuery:
    """What readers have read. A stream keeps the state of each reader and writes changes to out, a partition for each
    batch (see stateful.read_changes, and current_reads for the state as it stands); a log at rest is reduced at once."""
    if not log.isStreaming:
        return read_state(log)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keyed_state(log.sparkSession):
        query = read_changes(log).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def current_reads(spark: SparkSession, out: str) -> DataFrame:
    """(reader_id, item_id) read as of the last change of each item in the table that stream_read_state writes."""
    last = spark.read.parquet(out).groupBy("reader_id", "item_id").agg(F.max_by("is_read", "version").alias("is_read"))
    return last.filter("is_read").select("reader_id", "item_id")


def stream_accumulate(items: DataFrame, path: str, checkpoint: str, tie: tuple[str, ...] = (), trigger: dict | None = None, buckets: int = 8) -> StreamingQuery:
    """Days grow: after each batch the stored paper is what one dedupe of all items so far keeps, in whatever order they came.

    A batch reads and writes the buckets of its days that its items touch (see add_items). One that is run again after a
    failure changes nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        add_items(df.withColumns({"edition_date": F.to_date("published_at"), "gen": F.lit(0)}), path, tie, buckets)

    query = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def stream_refresh(items: DataFrame, path: str, checkpoint: str, tie: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """The hourly rebuild; what arrived while nothing ran is read at the start, from the checkpoint on.

    Only days that a batch touches are written, so a rebuild without items leaves the published paper as it is.
    """
    return stream_accumulate(items, path, checkpoint, tie, trigger or {"processingTime": "1 hour"})


def stream_retention(items: DataFrame, path: str, checkpoint: str, today: str, retention: int = 7, trigger: dict | None = None) -> StreamingQuery:
    """Deletes the days that have run out, after each batch of arriving items. A batch that is run again deletes no more."""
    spark = items.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        drop_pruned(spark, path, today, retention)

    query = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
