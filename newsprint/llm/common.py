"""Helpers that the corpus operators share: reading, lineage cuts, Arrow maps and components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="newsprint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Shuffle files of a query go when it ends, instead of when the driver's collector finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cuts the lineage: the rows as Parquet in the shared folder, read again, so that a lost executor loses nothing.

    Inside `scratch` the table is deleted with the others there, unless `keep` hands it to the scope around that one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside at its end. What is returned from inside must read only docs and tables kept."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Returns freed memory of this worker process to the system: Spark reuses the process, and its peak would stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes that belong to no word turn into a space; A-Z turn into a-z. Bytes from 0x80 on are parts of words.
_WORD_BYTES = {
    digits: bytes(b if b >= 0x80 or digits and 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
    for digits in (True, False)
}


def byte_words(text: str | None, digits: bool) -> list[bytes]:
    """Words of letters (and digits) and characters beyond ASCII as UTF-8, A-Z in lower case; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES[digits]).split()


def row_key() -> list[Column]:
    """Columns rid and did, which tell rows of (doc_id, text) apart. Rows alike in both share a key."""
    return [F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit(0)).alias("did")]


def unlike(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def docs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text alone, a null text as an empty one."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, schema: str | StructType, rows: Callable[[dict[str, list]], dict[str, object]], most: int = 8 << 20) -> DataFrame:
    """mapInArrow by a function from columns (as Python lists) of `most` bytes or a row to columns of the result."""
    return map_pieces(df, schema, lambda piece: rows(piece.to_pydict()), most)


def map_pieces(df: DataFrame, schema: str | StructType, rows: Callable[[pa.RecordBatch], dict[str, object]], most: int) -> DataFrame:
    """mapInArrow by a function from record batches of `most` bytes or a row to columns of the result."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for piece in slices(batch, most):
                out = rows(piece)
                arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
                del out
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            give_back()

    return df.mapInArrow(run, target)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about that many bytes, or a single row."""
    step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def sieved(rows: DataFrame, wanted: DataFrame, on: str = "lid", bits: int = 24) -> DataFrame:
    """The rows whose `on` is wanted, and some others: a table of 2 ** bits bits, packed in words of 64, tells them apart.

    The table has at most 2 ** (bits - 6) rows whatever the input is, so it may be broadcast; the rows themselves need
    no shuffle to be told apart. It only saves work: a join with `wanted` decides, however full the table is.
    """
    marked, may = _marked(rows, wanted, on, bits)
    return marked.filter(may).select(*rows.columns)


def _marked(rows: DataFrame, wanted: DataFrame, on: str, bits: int) -> tuple[DataFrame, Column]:
    """rows with further columns, and the condition over them that a row may be wanted."""
    word, mask = unlike(rows, "word"), unlike(rows, "mask")

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("sieve"), column), F.lit(1 << bits))

    def bit(column: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(column), F.lit(64)).cast("int"))

    table = wanted.groupBy(F.floor(place(on) / 64).alias(word)).agg(F.bit_or(bit(on)).alias(mask))
    marked = rows.withColumn(word, F.floor(place(on) / 64)).join(F.broadcast(table), word, "left")
    return marked, F.coalesce(F.col(mask).bitwiseAND(bit(on)) != 0, F.lit(False))


def absent(docs: DataFrame, keys: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of docs whose row_key is not among keys (rid, did). Few rows beside those among them are shuffled."""
    rid, did = unlike(docs, "rid"), unlike(docs, "did")
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    keyed = docs.withColumns({rid: F.xxhash64(doc_id, text), did: F.coalesce(doc_id, F.lit(0))})
    keys = written(keys.select(F.col("rid").alias(rid), F.col("did").alias(did)).distinct())
    marked, may = _marked(keyed, keys, rid, bits)
    rest = marked.filter(may).join(keys, [rid, did], "left_anti")
    return marked.filter(~may).select(*docs.columns).unionByName(rest.select(*docs.columns))


def salted_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows of each key; partial sums are built before the shuffle, so a hot key sends one row a task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def one_row_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The least row of docs by (doc_id, nulls last, hash of the text) for each root, with all columns.

    rows (doc_id, rid, root) holds a row for each row of docs, rid as the hash of the text (see docs_of). Rows alike in
    doc_id and text are told apart by their other columns, and one stays. Rows that are alone under their root are told
    by a bit table (see sieved) and stay where they are: of docs, the others and few besides are shuffled.
    """
    counted = written(rows.groupBy("root", "doc_id", "rid").agg(F.count(F.lit(1)).alias("n")))
    least = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "n")).alias("x"), F.sum("n").alias("all"))
    least = written(least.filter("all > 1").select("root", "x"))
    # One key for both, so that neither a text with many copies nor a null id gathers rows.
    key, n, whole = unlike(docs, "key"), unlike(docs, "n"), unlike(docs, "whole")
    judged = counted.join(least, "root").select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "rid").alias(key), F.xxhash64("x.none", "x.doc_id", "x.rid").alias("head"), "n")
    # A row's n if it stays, 0 if it goes.
    judged = written(judged.groupBy(key).agg(F.max(F.when(F.col(key) == F.col("head"), F.col("n")).otherwise(0)).alias(n)), keep=True)
    doc_id, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    marked, may = _marked(docs.withColumn(key, F.xxhash64(doc_id.isNull(), doc_id, text)), judged.select(key), key, 24)
    alone = marked.filter(~may).select(*docs.columns)
    found = marked.filter(may).select(*docs.columns, key).join(judged, key, "left")
    kept = alone.unionByName(found.filter(F.coalesce(F.col(n), F.lit(1)) == 1).select(*docs.columns))
    if judged.filter(F.col(n) > 1).isEmpty():
        return kept
    row = F.struct(*docs.columns)
    again = found.filter(F.col(n) > 1).groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(whole)).select(f"{whole}.*")
    return kept.unionByName(again)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); root is the smallest node reachable.

    Alternating large and small stars (Kiveris et al. 2014): every round hangs nodes onto smaller neighbours, and the
    number of edges never grows. The rows stay on the executors; a round's result is written to the shared folder.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    before = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the joins start from two plain shuffles, of which Spark can split a hub's.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
