"""State that streams keep: days that close, and what each reader has read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class keyed_state:
    """Queries that are started inside have the state store that these processors need; the session's own stays set."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.before = spark, spark.conf.get(PROVIDER, None)

    def __enter__(self) -> None:
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)


class _Days(StatefulProcessor):
    """Counts the items of an open day, tells those of a closed one as late, and reports the count when the day closes."""

    def __init__(self, columns: list[str]) -> None:
        self.columns, self.row = columns, Row(*columns, "timing", "n")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, closes, _ = key
        n = self.count.get()[0] if self.count.exists() else 0
        late = closes is not None and timerValues.getCurrentWatermarkInMs() >= closes
        timing, before = "undated" if closes is None else "late" if late else "on_time", n
        for r in rows:
            n += timing == "on_time"
            yield self.row(*(r[c] for c in self.columns), timing, None)
        if n > before:
            self.count.update((n,))
            if not before:
                self.handle.registerTimer(closes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.count.exists():
            n = self.count.get()[0]
            self.count.clear()
            yield self.row(*(key[0] if c == "edition_date" else None for c in self.columns), "closed", n)

    def close(self) -> None:
        pass


def day_timing(items: DataFrame, delay: str = "1 day", salts: int = 16) -> DataFrame:
    """items with edition_date, timing and n: `on_time`, `late` (its day had closed) or `undated`, each item once.

    A day closes when the watermark, `delay` behind the newest item, passes its end. Then come rows of timing `closed`, with
    the number n of the day's items and no item. The watermark's own column is left behind, so that Spark drops no
    row by it. A day is dealt to `salts` keys by a hash of its items: it has that many rows of counts.
    """
    plain = items.drop("edition_date", "timing", "n").withColumn("published_at", F.col("published_at").cast("timestamp"))
    day = F.to_date("published_at")
    marked = plain.withColumns({"edition_date": day, "_event": F.col("published_at")}).withWatermark("_event", delay).drop("_event")
    columns = marked.columns
    closes = F.unix_millis(F.date_add("edition_date", 1).cast("timestamp"))
    keyed = marked.withColumns({"_closes": closes, "_salt": F.pmod(F.xxhash64(*(c for c in plain.columns)), F.lit(salts))})
    schema = StructType([StructField(f.name, f.dataType) for f in marked.schema] + [StructField("timing", StringType()), StructField("n", LongType())])
    return keyed.groupBy("edition_date", "_closes", "_salt").transformWithState(_Days(columns), schema, "Append", "EventTime")


class _Reads(StatefulProcessor):
    """The last read or unread of each item of a reader, and the mark up to which all was cleared."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        mark = StructType([StructField("cleared", LongType()), StructField("version", LongType())])
        last = StructType([StructField("is_read", BooleanType()), StructField("seq", LongType())])
        self.mark = handle.getValueState("mark", mark)
        self.items = handle.getMapState("items", StructType([StructField("item", StringType())]), last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cleared, version = self.mark.get() if self.mark.exists() else (-1, 0)
        last, upto = {}, cleared
        for r in rows:
            item = "" if r.item_id is None else f"={r.item_id}"
            if r.op == "clear":
                upto = max(upto, r.seq)
            elif item not in last or r.seq > last[item][1]:
                last[item] = (r.op == "read", r.seq)
        changed = {}
        for item, (is_read, seq) in last.items():
            held = self.items.getValue((item,)) if self.items.containsKey((item,)) else (False, -1)
            if seq > held[1]:
                self.items.updateValue((item,), (is_read, seq))
                if (is_read and seq > upto) != held[0]:
                    changed[item] = is_read and seq > upto
        if upto > cleared:
            for (item,), (is_read, seq) in list(self.items.iterator()):
                if seq <= upto:
                    self.items.removeKey((item,))
                    if is_read and item not in last:
                        changed[item] = False
        self.mark.update((upto, version + 1))
        for item, is_read in changed.items():
            yield Row(reader_id=key[0], item_id=item[1:] if item else None, is_read=is_read, version=version + 1)

    def close(self) -> None:
        pass


def read_changes(log: DataFrame) -> DataFrame:
    """(reader_id, item_id, is_read, version) whenever an item becomes read, or unread by itself or by clearing all.

    Keyed by the reader: each of the items that the reader has marked since the last clearing, and the clearing's place
    in the log, are its state; log rows may come in any order. version grows with each batch that has rows of the reader.
    """
    reader, item = log.schema["reader_id"].dataType, log.schema["item_id"].dataType
    schema = StructType([StructField("reader_id", reader), StructField("item_id", item), StructField("is_read", BooleanType()), StructField("version", LongType())])
    return log.select("reader_id", "item_id", "op", F.col("seq").cast("long").alias("seq")).groupBy("reader_id").transformWithState(_Reads(), schema, "Update", "None")
