"""Editions on disk: a folder for each day, and a manifest that says which files of it count."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

_MANIFEST, _STAGE = "_manifest", "_stage"
#: Manifests that stay beside the newest one, for readers that have just looked it up.
_KEPT = 20
_FILE = re.compile(r"part-\d+-([0-9a-f-]{36})")


class _Files:
    """The few file-system calls of the store, by Hadoop's interface, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> bool:
        """False if new is there already."""
        return not self.fs.exists(self.path(new)) and self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _day_of(folder: str) -> str | None:
    """The date that a folder is named for, if it is one."""
    found = re.fullmatch(r"edition_date=(\d{4}-\d{2}-\d{2})", folder)
    try:
        return date.fromisoformat(found[1]).isoformat() if found else None
    except ValueError:
        return None


def _table_and_day(part: str) -> tuple[str, str | None]:
    """Of a part such as _seen/rows/edition_date=2024-01-01/bucket=3, its table (_seen/rows; '' for editions) and its day."""
    names = part.split("/")
    at = next((i for i, n in enumerate(names) if n.startswith("edition_date=")), len(names))
    return "/".join(names[:at]), _day_of(names[at]) if at < len(names) else None


def _manifest(files: _Files, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: the version of each part (a day, or a bucket of one), and schemas of tables.

    A store without one (days written by plain Spark) counts as it lies: its days have no version, all of their files count.
    """
    numbers = [int(n[:-5]) for n in files.names(f"{path}/{_MANIFEST}") if re.fullmatch(r"\d+\.json", n)]
    if numbers:
        return max(numbers), json.loads(files.read(f"{path}/{_MANIFEST}/{max(numbers):010d}.json"))
    return 0, {"parts": {n: None for n in files.names(path) if _day_of(n)}, "schemas": {}}


def _swap(files: _Files, path: str, change: Callable[[dict], dict], tries: int = 20) -> tuple[dict, dict]:
    """Puts a changed manifest in the place of the newest one, whole or not at all; the old one and the new one.

    It is written aside and renamed to the next number. Where another writer had that number first, its manifest is read
    and the change is made to it instead.
    """
    for _ in range(tries):
        number, old = _manifest(files, path)
        new, aside = change(json.loads(json.dumps(old))), f"{path}/{_MANIFEST}/.{uuid.uuid4().hex}"
        files.write(aside, json.dumps(new, sort_keys=True))
        if files.move(aside, f"{path}/{_MANIFEST}/{number + 1:010d}.json"):
            for name in files.names(f"{path}/{_MANIFEST}"):
                if re.fullmatch(r"\d+\.json", name) and int(name[:-5]) <= number - _KEPT:
                    files.delete(f"{path}/{_MANIFEST}/{name}")
            return old, new
        files.delete(aside)
    raise RuntimeError(f"{path}: other writers were first {tries} times")


def _leaves(files: _Files, top: str, depth: int) -> list[str]:
    """Folders of so many levels of partition columns under top, by their relative names."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}".lstrip("/") for f in found for n in files.names(f"{top}/{f}".rstrip("/")) if "=" in n]
    return found


def publish(rows: dict[str, DataFrame], path: str, by: tuple[str, ...], gone: Callable[[str, set[str]], bool], write: Callable[[DataFrameWriter, str], None] | None = None, schemas: dict | None = None) -> None:
    """Replaces parts of tables, all at once: new files lie beside the old ones, and count once the manifest names them.

    rows holds a DataFrame for each table ('' is the editions' own), whose parts are values of the columns `by`, the
    first of them edition_date. Parts with new rows are replaced; gone(part, new parts) says which others go with them.
    A write that fails before the swap leaves all as it was, for whoever reads by the manifest. The files of the
    replaced versions are then deleted; those of a write that was cut off stay until `sweep`.
    """
    files, version = _Files(next(iter(rows.values())).sparkSession, path), uuid.uuid4().hex
    stage = f"{path}/{_STAGE}/{version}"
    if not _manifest(files, path)[0]:
        _swap(files, path, lambda m: m)  # what lies there now counts, what is moved there from here on does not yet
    new: dict[str, str] = {}
    for k, (table, df) in enumerate(rows.items()):
        # AQE deals a large part to several tasks and gathers small ones, by the bytes that the shuffle has counted.
        writer = df.filter("edition_date is not null").hint("rebalance", *by).write.partitionBy(*by)
        (write or (lambda w, to: w.parquet(to)))(writer, f"{stage}/{k}")
        for leaf in _leaves(files, f"{stage}/{k}", len(by)):
            part = f"{table}/{leaf}".lstrip("/")
            if _table_and_day(part)[1]:
                files.fs.mkdirs(files.path(f"{path}/{part}"))
                for name in files.names(f"{stage}/{k}/{leaf}"):
                    if found := _FILE.match(name):
                        if not files.move(f"{stage}/{k}/{leaf}/{name}", f"{path}/{part}/{name}"):
                            raise OSError(f"{path}: {name} can't be moved to its part")
                        new[part] = found[1]
    stored = {t: json.loads(df.schema.json()) for t, df in rows.items()} | (schemas or {})

    def change(m: dict) -> dict:
        stay = {p: v for p, v in m["parts"].items() if p not in new and not gone(p, set(new))}
        return {"parts": stay | new, "schemas": m["schemas"] | stored}

    before, after = _swap(files, path, change) if new else ({"parts": {}}, {"parts": {}})
    for part in before["parts"]:
        if after["parts"].get(part, "") != before["parts"][part]:
            _forget(files, path, part, after["parts"].get(part, ""))
    files.delete(stage)


def _forget(files: _Files, path: str, part: str, version: str | None) -> None:
    """Deletes the data files of a part but those of a version."""
    for name in files.names(f"{path}/{part}"):
        found = _FILE.match(name)
        if found and found[1] != version:
            files.delete(f"{path}/{part}/{name}")


def _of_replaced_days(part: str, new: set[str]) -> bool:
    """Whether a part, of whatever table, is of a day that is written as a whole."""
    return any(_table_and_day(part)[1] == _table_and_day(p)[1] for p in new)


def _globs(path: str, parts: dict[str, str | None]) -> list[str]:
    return [f"{path}/{p}" + (f"/part-*-{v}*" if v else "") for p, v in sorted(parts.items())]


def read_parts(spark: SparkSession, path: str, table: str, wanted: Callable[[str], bool] | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of a table's parts that are wanted (of all), by their files alone, as the manifest has them."""
    _, manifest = _manifest(_Files(spark, path), path)
    found = {p: v for p, v in manifest["parts"].items() if _table_and_day(p)[0] == table and (wanted is None or wanted(p))}
    if schema is None and table in manifest["schemas"]:
        schema = StructType.fromJson(manifest["schemas"][table])
    schema = schema or (None if found else StructType([StructField("edition_date", DateType())]))
    if not found:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{path}/{table}".rstrip("/")).option("ignoreCorruptFiles", "true")
    rows = (reader.schema(schema) if schema else reader).parquet(*_globs(path, found))
    return rows.select(*(f.name for f in schema)) if schema else rows


def write_edition(items: DataFrame, path: str) -> None:
    """Replaces the days in items and leaves the others. Days without a row in items are untouched, so an empty rebuild
    does not wipe out an edition that has items; rows without a date are in no edition.

    The days are swapped at once and whole (see publish). A day of very many rows is written by several tasks.
    """
    publish({"": items}, path, ("edition_date",), _of_replaced_days)


def read_editions(spark: SparkSession, path: str, days: Iterable[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of the given days (of all days, if none are given), as the manifest has them.

    A day that is not stored, and a path that does not exist, give no rows; a folder whose name is no date is never
    looked at; a file that can't be decoded gives none of its rows. Without rows the columns are those of `schema`, or of
    what was last written, or just edition_date.
    """
    wanted = None if days is None else set(days)
    return read_parts(spark, path, "", None if wanted is None else lambda part: _table_and_day(part)[1] in wanted, schema)


def read_edition(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The rows of a day, from its files alone; none if there is no such day (see read_editions)."""
    return read_editions(spark, path, [day])


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """The dates that a store has editions of, in order."""
    return sorted({d for t, d in map(_table_and_day, _manifest(_Files(spark, path), path)[1]["parts"]) if not t})


def tables_of(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """The dates that each table beside the editions has parts of."""
    found: dict[str, set[str]] = {}
    for table, day in map(_table_and_day, _manifest(_Files(spark, path), path)[1]["parts"]):
        found.setdefault(table, set()).add(day)
    return found


def publish_guard(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("edition_date",)) -> DataFrame:
    """All editions after publishing: the new ones, and the old ones that have no new rows."""
    fresh = new.select(*keys).distinct()
    return old.join(fresh, list(keys), "left_anti").unionByName(new)


def prune_editions(editions: DataFrame, today: str, retention: int = 7) -> DataFrame:
    """The rows of the last `retention` dates, today's included."""
    return editions.filter(F.col("edition_date") >= F.date_sub(F.lit(today).cast("date"), retention - 1))


def drop_pruned(spark: SparkSession, path: str, today: str, retention: int = 7) -> list[str]:
    """Deletes the days that retention does not keep, and names them. All else is left alone, folders of other names too.

    The days are the folders' names (no row is read). They leave the manifest first, so no reader finds half a day.
    """
    files = _Files(spark, path)
    least = date.fromordinal(date.fromisoformat(today).toordinal() - retention + 1).isoformat()
    number, manifest = _manifest(files, path)
    gone = {d for d in map(_day_of, files.names(path)) if d and d < least}
    old = {(t, d) for t, d in map(_table_and_day, manifest["parts"]) if d < least}
    if old and number:
        _swap(files, path, lambda m: m | {"parts": {p: v for p, v in m["parts"].items() if _table_and_day(p)[1] >= least}})
    for table, day in old | {("", d) for d in gone}:
        files.delete(f"{path}/{table}/edition_date={day}" if table else f"{path}/edition_date={day}")
    return sorted(gone)


def sweep(spark: SparkSession, path: str) -> None:
    """Deletes what writes that were cut off have left: files that the manifest does not name. No write may be running."""
    files = _Files(spark, path)
    number, manifest = _manifest(files, path)
    if not number:
        return
    files.delete(f"{path}/{_STAGE}")
    for table in {_table_and_day(p)[0] for p in manifest["parts"]} | {""}:
        top = f"{path}/{table}".rstrip("/")
        for part in (f"{table}/{leaf}".lstrip("/") for depth in (1, 2) for leaf in _leaves(files, top, depth)):
            if _table_and_day(part)[1] and manifest["parts"].get(part, ""):
                _forget(files, path, part, manifest["parts"][part])
            elif _table_and_day(part)[1] and part not in manifest["parts"]:
                _forget(files, path, part, "")


def write_documents(nested: DataFrame, path: str) -> None:
    """Each edition as one JSON document, in a folder of its date; a date's documents are replaced as a whole, as in
    write_edition.

    Keys are in order, dates and times in ISO form, and nulls are written. nested: see edition_nest.
    """
    fields = sorted(c for c in nested.columns if c != "edition_date")
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    body = F.to_json(F.struct(F.col("edition_date").cast("string").alias("edition_date"), *fields), options)
    schemas = {"": json.loads(nested.schema.json())}
    publish({"": nested.select("edition_date", body.alias("value"))}, path, ("edition_date",), _of_replaced_days, lambda w, to: w.text(to), schemas)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The documents of write_documents, as rows of the nested form.

    A document that is no JSON, that does not fit the schema, or that lacks its date or one of its lists gives no row; so
    does a path that does not exist.
    """
    _, manifest = _manifest(_Files(spark, path), path)
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(_globs(path, manifest["parts"]))
    marked = StructType([*schema, StructField("_broken", StringType())])
    whole = F.from_json("value", marked, {"columnNameOfCorruptRecord": "_broken"})
    needed = [f.name for f in schema if f.name == "edition_date" or f.dataType.typeName() == "array" and f.name in ("secondaries", "briefs")]
    rows = lines.select(whole.alias("d")).filter("d._broken is null").select("d.*").drop("_broken")
    return rows.dropna(subset=needed) if needed else rows


def prunable_dates(editions: DataFrame, today: str, retention: int = 7) -> DataFrame:
    return editions.select("edition_date").distinct().filter(F.col("edition_date") < F.date_sub(F.lit(today).cast("date"), retention - 1))
