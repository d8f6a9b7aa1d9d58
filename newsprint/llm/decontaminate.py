"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprint.llm.common import absent, docs_of, map_arrow, row_key, unlike, written

#: Bytes that belong to no word turn into a space; A-Z turn into a-z. Bytes from 0x80 on are parts of words.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["rid", "did"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and the number of the text that each belongs to."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(data).translate(_TO_WORDS), np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _ODD, np.uint64))
        hashes = _mix(np.add.reduceat(_BYTE[raw[inside]] * power[place], first) + size.astype(np.uint64))
    text_starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    return hashes, np.searchsorted(text_starts, starts, "right") - 1


def _chained(words: np.ndarray, starts: np.ndarray | None, n: int, seed: int) -> np.ndarray:
    """A hash of the n words from each start on (from each word on, if no starts are given)."""
    count = len(words) - n + 1 if starts is None else len(starts)
    h = np.full(max(0, count), seed, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = words[i : i + count] if starts is None else words[starts + i]
            h = _mix(h * _ODD + part)
    return h


def winnow(words: np.ndarray, text: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of n words inside a text, and the least hash of k words in a row in each."""
    k = min(k, n)
    grams = _chained(words, None, k, 1)
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:count].copy()
    for i in range(1, n - k + 1):
        np.minimum(least, grams[i : i + count], out=least)
    starts = np.flatnonzero(text[:count] == text[n - 1 :])
    return starts, least[starts]


def _place(prints: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where fingerprints of windows of n words stand in a table of 2 ** bits bits."""
    with np.errstate(over="ignore"):
        return _mix(prints * _ODD + np.uint64(n)) >> np.uint64(64 - bits)


def benchmark_windows(benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(item, n, print, h1, h2): every different window of every item, with its fingerprint and a hash of 128 bits.

    item is the id as a string. An item of fewer words than `window`, but not none, is one window.
    """

    def rows(cols: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("item", "n", "print", "h1", "h2")}
        for item, text in zip(cols["item"], cols["text"], strict=True):
            words, owner = word_hashes([text])
            if n := min(window, len(words)):
                starts, prints = winnow(words, owner, n, k)
                out["item"] += [item] * len(starts)
                for c, v in zip(("n", "print", "h1", "h2"), (np.full(len(starts), n), prints, *(_chained(words, starts, n, s) for s in (2, 3))), strict=True):
                    out[c].append(v.astype(np.uint64).view(np.int64))
        return {c: v if c == "item" else np.concatenate(v) if v else [] for c, v in out.items()}

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return written(map_arrow(items, "item string, n long, print long, h1 long, h2 long", rows).distinct())


def _sieve(windows: DataFrame, most_bits: int) -> tuple[dict[int, int], np.ndarray]:
    """Lengths of windows, and a bit table of all fingerprints: 2 ** most_bits bits at most, whatever the benchmark."""
    prints = windows.select("n", "print").distinct()
    count = {r["n"]: r["count"] for r in prints.groupBy("n").count().collect()}
    bits = max(12, min(most_bits, int(sum(count.values()) * 16).bit_length()))

    def rows(cols: dict[str, list]) -> dict[str, object]:
        places = [int(_place(np.array([p], np.int64).view(np.uint64), n, bits)[0]) for p, n in zip(cols["print"], cols["n"], strict=True)]
        return {"place": places}

    places = map_arrow(prints, "place long", rows)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    found = places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("set")).toPandas()
    table = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64).view(np.uint64)
    return count, table


def scanned(docs: DataFrame, windows: DataFrame, k: int = 5, most_bits: int = 27) -> DataFrame:
    """(doc_id, rid, did, n_words, found): found holds the windows (n, s, h1, h2) whose fingerprint may be a benchmark's."""
    lengths, table = _sieve(windows, most_bits)
    bits = len(table).bit_length() + 5
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def rows(cols: dict[str, list]) -> dict[str, object]:
        words, text = word_hashes(cols["text"])
        count = len(cols["text"])
        owner, values = [], {c: [] for c in ("n", "s", "h1", "h2")}
        first = np.searchsorted(text, np.arange(count + 1))
        for n in lengths:
            starts, prints = winnow(words, text, n, k)
            at = _place(prints, n, bits)
            starts = starts[(sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            owner.append(text[starts])
            for c, v in zip(values, (np.full(len(starts), n), starts - first[text[starts]], *(_chained(words, starts, n, s) for s in (2, 3))), strict=True):
                values[c].append(v.astype(np.uint64).view(np.int64))
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, count))
        lists = {c: np.split(np.concatenate(v)[order] if v else np.zeros(0, np.int64), cuts) for c, v in values.items()}
        return {c: cols[c] for c in ("doc_id", *_KEY)} | {"n_words": np.diff(first)} | lists

    keyed = docs_of(docs).select("doc_id", "text", *row_key())
    out = map_arrow(keyed, "doc_id long, rid long, did long, n_words long, n array<long>, s array<long>, h1 array<long>, h2 array<long>", rows, 1 << 20)
    return written(out.select("doc_id", *_KEY, "n_words", F.arrays_zip("n", "s", "h1", "h2").alias("found")))


def hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(rid, did, runs, items) of the documents with a benchmark window: runs are merged word runs, items in order.

    A window stands in the join once, with all of its items, so a window of many items and many documents is a row for
    each of the documents.
    """
    window = ["n", "h1", "h2"]
    rows = found.select(*_KEY, F.explode("found").alias("w")).select(*_KEY, "w.*")
    # Both sides written: Spark can split the rows of a window that very many documents hold.
    rows = written(rows.join(written(windows.select(*window).distinct()), window))
    sets = windows.filter("item is not null").groupBy(*window).agg(F.array_sort(F.collect_set("item")).alias("set"))
    named = rows.select(*_KEY, *window).distinct().join(written(sets), window)
    items = named.groupBy(*_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("set")))).alias("items"))
    empty = F.array().cast("array<string>")
    return written(_merged(rows).join(items, _KEY, "left").select(*_KEY, "runs", F.coalesce("items", empty).alias("items")))


def _merged(rows: DataFrame) -> DataFrame:
    """(rid, did, runs): runs of words in order, those that meet or overlap made one.

    A window begins a run if it starts behind the ends of all before it; a run ends where the last of its windows does.
    Rows alike count once, so copies of a document add nothing.
    """
    spans = rows.select(*_KEY, F.col("s").cast("int").alias("s"), (F.col("s") + F.col("n")).cast("int").alias("e")).distinct()
    order = Window.partitionBy(*_KEY).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("own", F.when(before.isNull() | (F.col("s") > before), F.col("s")))
    runs = begun.withColumn("own", F.max("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*_KEY, "own").agg(F.max("e").alias("e"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("own").alias("s"), "e"))).alias("runs"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """docs with n_words, runs (merged word runs inside benchmark windows) and items (ids as sorted strings).

    Winnowing: of every window - k + 1 hashes of k words in a row the least is kept, on both sides, so equal windows have
    an equal fingerprint. A bit table of the benchmark's fingerprints, of bounded size, goes to the executors and leaves
    few windows of the documents, at any size of the benchmark; these are extended to hashes of all of their words, which
    are joined with those of the benchmark. An item of fewer words than `window` is one window by itself, winnowed at its
    own length.

    A null text has no words; items without a word match nothing; the same window in many items counts for each of them;
    repeated rows of an item count once. A row whose item_id is null has windows like any other: its hits count as runs,
    and name no item. Repeated documents are each returned. An empty table on either side gives no hits. Extra columns of
    docs stay, but for those named like new ones.
    """
    windows = benchmark_windows(benchmark, window, k)
    plain = docs.drop("n_words", "runs", "items")
    found = scanned(plain, windows, k)
    counts = found.groupBy(*_KEY).agg(F.max("n_words").alias("n_words"))
    rid, did, new = unlike(plain, "rid"), unlike(plain, "did"), unlike(plain, "new")
    every = _filled(counts.join(hits(found, windows), _KEY, "left"))
    every = every.select(F.col("rid").alias(rid), F.col("did").alias(did), F.struct("n_words", "runs", "items").alias(new))
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    keyed = plain.withColumns({rid: F.xxhash64(doc_id, text), did: F.coalesce(doc_id, F.lit(0))})
    return keyed.join(every, [rid, did]).select(*plain.columns, f"{new}.*")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("runs", "array<struct<s:int,e:int>>"), ("items", "array<string>"))})


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row a document."""
    windows = benchmark_windows(benchmark)
    found = scanned(docs, windows)
    out = _filled(found.drop("found").join(hits(found, windows), _KEY, "left"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["e"] - r["s"]).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents without a benchmark window, with the columns of docs, whatever their names."""
    windows = benchmark_windows(benchmark, window, k)
    return absent(docs, hits(scanned(docs, windows, k), windows))


def sha256_of(items: list[str]) -> str:
    """For tests: the digest of a list of items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
