"""Shards of near-equal size from sampled splitters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprint.llm.common import docs_of, map_arrow, written


#: Rows are in the order of the text's hash, then doc_id; a salt tells rows apart that are alike in both.
_KEY = ["thash", "doc_id", "salt"]


def _splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> list[np.ndarray]:
    """Boundaries of about equal bytes: a sample whose rows come in proportion to their size, cut at quantiles.

    At most about ranges * per_range keys reach the driver, whatever the input: a row of s bytes is drawn with the
    chance s * ranges * per_range / total, by a hash of its key, salt included, so that repeated rows are drawn one by one.
    """
    chance = F.col("size") * F.lit(ranges * per_range / max(1, total))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *_KEY), 11) / F.lit(float(1 << 53))
    got = rows.filter(draw < chance).select(*_KEY).toPandas()
    keys = got.sort_values(_KEY, na_position="first").fillna({"doc_id": np.iinfo(np.int64).min})
    at = np.unique(np.arange(1, ranges) * len(keys) // ranges) if len(keys) else np.zeros(0, np.int64)
    return [keys[c].to_numpy(np.int64)[at] for c in _KEY]


def _range_of(splitters: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of splitters (in order of all parts of the key) that are at most the key."""
    lo, hi = np.searchsorted(splitters[0], keys[0], "left"), np.searchsorted(splitters[0], keys[0], "right")
    if len(splitters) == 1:
        return hi
    out = lo.copy()
    for left, right in {(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b}:
        mine = (lo == left) & (hi == right)
        out[mine] = left + _range_of([s[left:right] for s in splitters[1:]], [k[mine] for k in keys[1:]])
    return out


def shards(docs: DataFrame, n_shards: int = 8, ranges: int = 512, per_range: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): contiguous key ranges of near-equal bytes.

    The key is (hash of the text, doc_id), and a salt for each row: equal texts lie side by side and share a shard unless a boundary has to cut
    their group. Sampled splitters give `ranges` fine ranges, whose exact bytes are then counted. A fine range that lies
    across a shard boundary, or that a hot group of equal texts overfills, is subdivided: inside it, rows go to shards
    by their running bytes. So a shard differs from total / n_shards by less than one row. A slot is the row's place in
    its shard. No window holds more than a fine range; there is one for 100,000 rows, `ranges` at least and 65536 at most,
    so that splitters and sums stay small (beyond 6.5 billion rows a range grows instead). The sample draws `per_range` keys
    a range, 8 above 4096 ranges: it only places the splitters, and exact sums over all rows decide.

    Size is the bytes of the text plus 1; a null text has none. Rows alike in doc_id and text, null ids among them, lie side
    by side in as many fine ranges as their bytes ask for. An empty
    table gives an empty result; further columns are ignored.
    """
    text = docs_of(docs)
    size = F.octet_length("text").cast("long") + 1
    crc = F.crc32(F.encode("text", "utf-8"))
    rows = written(text.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("thash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = int(max(ranges, min(1 << 16, n // 100_000)))
    splitters = _splitters(rows, total, ranges, per_range if ranges < 4096 else 8)

    def place(cols: dict[str, list]) -> dict[str, object]:
        d = np.array([np.iinfo(np.int64).min if x is None else x for x in cols["doc_id"]], np.int64)
        return cols | {"r": _range_of(splitters, [np.array(cols["thash"], np.int64), d, np.array(cols["salt"], np.int64)])}

    ranged = written(map_arrow(rows, "doc_id long, size long, text_crc32 long, thash long, salt long, r int", place))
    # One row for each fine range: sums over them run in one small window of at most `ranges` rows.
    bounds = ranged.groupBy("r").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = bounds.select("r", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("r").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("start")
    middle = (F.col("run") + F.col("size") / 2) * n_shards / F.lit(max(1, total))
    placed = ranged.join(F.broadcast(starts), "r").withColumn("run", run)
    placed = placed.withColumn("shard", F.least(F.floor(middle), F.lit(n_shards - 1)).cast("int"))
    counts = placed.groupBy("shard", "r").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "r", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("r", "shard").orderBy(*_KEY)) - 1
    out = placed.withColumn("within", within).join(F.broadcast(base), ["shard", "r"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
