"""Target-distribution importance resampling: bucket counts as bit planes, weights as popcounts, and a Gumbel draw."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsprint.llm.common import byte_words, map_pieces, unlike, written

#: Documents whose planes are held in memory together.
_CHUNK = 256


class _Buckets(dict):
    """Bucket of a feature, computed once for each different one."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.size
        return found


def features(text: str | None, longest: int) -> list[bytes]:
    """All runs of 1 to `longest` words, repeats included."""
    words = byte_words(text, digits=True)
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(bucket, n) over all features of all texts; each Arrow batch sends a row for each bucket at most."""

    def rows(piece: pa.RecordBatch) -> dict[str, object]:
        known, total = _Buckets(buckets), Counter()
        for text in piece.column("text").to_pylist():
            total.update(map(known.__getitem__, features(text, longest)))
        return {"bucket": list(total), "n": list(total.values())}

    return map_pieces(docs.select("text"), "bucket int, n long", rows, 8 << 20).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, one added to every count."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = [float(target.get(b, 0) + 1) * s_all / (float(source.get(b, 0) + 1) * t_all) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """values >= 0 of shape (..., n) as packed bits (bits, ..., n / 64 words): plane k holds bit k of every value."""
    width = -(-values.shape[-1] // 64) * 64
    planes = []
    for k in range(max(1, int(values.max(initial=0)).bit_length())):
        bits = np.zeros((*values.shape[:-1], width), bool)
        bits[..., : values.shape[-1]] = (values >> k) & 1
        planes.append(np.packbits(bits, axis=-1).view(np.uint64))
    return np.stack(planes)


def weights_of(counts: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Sum of count times gain for each row of counts, from planes alone.

    Bit j of a count and bit k of a gain meet in the AND of their planes; its popcount, 2 ** (j + k) times, adds up to
    the product sum, without a multiplication of values. Gains above and below zero have planes of their own.
    """
    out = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(bit_planes(counts)):
        some = np.flatnonzero(plane.any(axis=1))
        for sign, gain in ((1, plus), (-1, minus)):
            for k, bits in enumerate(gain):
                found = np.bitwise_count(plane[some] & bits).sum(axis=1, dtype=np.int64)
                out[some] += sign * (found << (j + k))
    return out


def weighted(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if none are named) with n_features, n_words and weight.

    The gains are one number a bucket, so their planes go to every task, whatever the corpus. Documents are not shuffled.
    """
    source, wanted = ({r.bucket: r.n for r in bucket_counts(x, buckets, longest).collect()} for x in (docs, target))
    gain = gains(source, wanted, buckets)
    plus, minus = bit_planes(np.maximum(gain, 0)), bit_planes(np.maximum(-gain, 0))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_features", "n_words", "weight")]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in ("n_features", "n_words", "weight")])

    def rows(piece: pa.RecordBatch) -> dict[str, object]:
        known, texts = _Buckets(buckets), piece.column("text").to_pylist()
        size, words, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for lo in range(0, len(texts), _CHUNK):
            some = texts[lo : lo + _CHUNK]
            counts = np.zeros((len(some), buckets), np.int64)
            for i, text in enumerate(some):
                found = features(text, longest)
                size[lo + i], words[lo + i] = len(found), len(byte_words(text, digits=True)) if longest > 1 else len(found)
                counts[i] = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=buckets)
            weight[lo : lo + len(some)] = weights_of(counts, plus, minus)
        return {c: piece.column(c) for c in keep} | {"n_features": size, "n_words": words, "weight": weight}

    return map_pieces(docs.select(*dict.fromkeys([*keep, "text"])), schema, rows, 8 << 20)


def gumbel(doc_id: Column, seed: int = 2024) -> Column:
    """floor(1000 g) for Gumbel noise g from a hash of the id; a null id hashes as no characters."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of rows with `rank` 1, 2, 3... by a total order, over any number of rows.

    The rows are range-partitioned by the order and written; a row's rank is its place in its range plus the sizes of
    the ranges before, of which there are as many as shuffle partitions.
    """
    ranges = written(rows.select(*columns).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("rank", place).join(starts, "_range").select(*columns, (F.col("rank") + F.col("_start")).cast("long").alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, keep: list[str] | None = None,
) -> DataFrame:
    """docs with n_features, weight, score and rank: a draw without replacement whose words are spread like the target's.

    Features fall into `buckets` by crc32; a bucket's gain is the log of how much likelier it is in the target. The sum
    over a document's features is its weight, Gumbel noise by a hash of its id makes the best scores a draw by weight.
    Of the N documents of `least_words` words or more, the N * percent / 100 (rounded down) best by score and then
    smaller id (nulls last) are drawn and ranked; rank is null for all others.

    A null or empty text has no feature and weight 0. A null id has noise of its own; repeated rows are documents by
    themselves, with the same score, of which any may come first. An empty table gives an empty result, an empty target
    the same gain rule with no counts. keep names columns of docs to return (all by default); columns named like new
    ones are replaced.
    """
    n, none = unlike(docs, "row_no"), ("n_features", "n_words", "weight", "score", "rank")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in none]
    rows = weighted(docs, target, buckets, longest, list(dict.fromkeys([*keep, "doc_id"])))
    rows = rows.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), n: F.monotonically_increasing_id()})
    rows = written(rows)
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(n)]
    best = ranked(able, order, ["doc_id", "score", n]).filter(F.col("rank") <= drawn).select(n, "rank")
    return rows.join(best, n, "left").select(*keep, "n_features", "weight", "score", "rank")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row a document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return resampled(plain, benchmark, keep=["doc_id"])


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same rows for DuckDB. crc32 is worked out byte by byte for each different word, from a table made by its rule.
SQL = f"""
with recursive rule as (
    select i as k, i::bigint as c, 0 as step from range(256) t(i)
    union all select k, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, step + 1 from rule where step < 8
),
crc_table as (select list(c order by k) as t from rule where step = 8),
docs as (select row_number() over () as r, doc_id, {_WORDS} as found from documents),
doc_words as (select r, w, count(*) as n from (select r, unnest(found) as w from docs) group by 1, 2),
target_words as (select w, count(*) as n from (select unnest({_WORDS}) as w from benchmark) group by 1),
named as (select distinct w from (select w from doc_words union all select w from target_words)),
hexed as (select w, hex(encode(w)) as h from named),
bytes as (select w, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint) as b from hexed),
hashed as (
    select w, xor(list_reduce(b, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket
    from bytes, crc_table
),
source as (select bucket, sum(n) as s from doc_words join hashed using (w) group by 1),
target as (select bucket, sum(n) as t from target_words join hashed using (w) group by 1),
sizes as (select (select coalesce(sum(s), 0) from source)::double + 10000 as s_all, (select coalesce(sum(t), 0) from target)::double + 10000 as t_all),
gain as (
    select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * s_all / ((s + 1)::double * t_all)))::bigint as gain
    from source left join target using (bucket), sizes
),
weights as (select r, sum(n * gain) as weight from doc_words join hashed using (w) join gain using (bucket) group by 1),
scored as (
    select r, doc_id, len(found) as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from docs left join weights using (r)
),
able as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= 10 * n // 100 then rank::bigint end as rank
from scored left join able using (r)
"""
