"""Repeated byte strings across a corpus: buckets of sampled suffixes, refined by the identifiers of later offsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint.llm.common import docs_of, map_arrow, map_pieces, row_key, sieved, written

_CHUNK = 1 << 20
_KEY = ["rid", "did"]
_POS = np.int64((1 << 24) - 1)
#: Two odd numbers: two identifiers of 64 bits each tell strings apart.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The identifier that a bucket x gets by the bucket y at a later offset."""
    with np.errstate(over="ignore"):
        return _mix(x * np.uint64(0x9FB21C651E98DF25) + (y ^ (y >> np.uint64(29))) + np.uint64(1))


class _Grams:
    """Identifiers of all q-byte strings of a text, the initial buckets: a rolling polynomial with wrapping arithmetic."""

    def __init__(self, base: int, most: int):
        with np.errstate(over="ignore"):
            self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(most, base, np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(most, pow(base, -1, 1 << 64), np.uint64)])

    def of(self, data: np.ndarray, q: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.byte[data] * self.power[: len(data)], out=sums[1:])
            return _mix((sums[q:] - sums[:-q]) * self.inverse[: len(data) - q + 1])


_grams: list[_Grams] = []


def _tables() -> list[_Grams]:
    if not _grams:
        _grams.extend(_Grams(base, _CHUNK + 4096) for base in _BASES)
    return _grams


def identifiers(data: bytes, starts: np.ndarray, length: int, q: int, lanes: int = 2) -> list[np.ndarray]:
    """The identifiers of the `length`-byte strings of a text that begin at `starts`: two numbers each.

    Bucket pointers: a bucket of q bytes is refined by the bucket at offset q, which gives the buckets of 2 q bytes, these
    by one another at offset 2 q, and so on; every pass works on the identifiers of the last one. A string whose length
    lies between two passes is the pair of the buckets that it begins and ends with.
    """
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((lanes, len(starts)), np.uint64)
    step = max(1, _CHUNK - length)
    part_of = starts // step
    for part in np.unique(part_of).tolist():
        mine = part_of == part
        at = starts[mine] - part * step
        near = raw[part * step : part * step + int(at.max()) + length]
        for lane, grams in enumerate(_tables()[:lanes]):
            ids, size = grams.of(near, q), q
            while 2 * size <= length:
                ids, size = _pair(ids[:-size], ids[size:]), 2 * size
            out[lane, mine] = _pair(ids[at], ids[at + length - size])
    return [x.view(np.int64) for x in out]


def _run(data: bytes, first: np.ndarray, last: np.ndarray, length: int, q: int, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of runs of windows: of all bytes from a first window to a last one, and numbers that go with them.

    The windows of a run overlap, so the buckets of the first and the last one tell all of its bytes.
    """
    ids = identifiers(data, np.r_[first, last], length, q)
    out = []
    for x in ids:
        x = x.view(np.uint64)
        h = _pair(x[: len(first)], x[len(first) :])
        for y in parts:
            h = _pair(h, y.astype(np.uint64))
        out.append(h.view(np.int64))
    return out[0], out[1]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values in a row (van Herk's two passes)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.r_[x, np.full(pad, np.iinfo(np.int64).max)].reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, bounds: np.ndarray, sample: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places p, their names, and s, e: the windows of `sample` bytes that start at s to e point at p.

    data holds texts in a row, `bounds` where each begins and where the last one ends. A window lies inside a text and
    points at its q-byte string of least name (the first of several). Where depends on the window's bytes alone, so equal
    windows point at equal offsets: a suffix sampled this way stands for all windows around it.
    """
    raw = np.frombuffer(data, np.uint8)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    lengths = np.diff(bounds)
    step = _CHUNK - 4096
    for base in range(0, len(raw) - sample + 1, step):
        part = raw[base : base + step + sample - 1]
        names = _tables()[0].of(part, q)
        packed = ((names >> np.uint64(25)) << np.uint64(24)).astype(np.int64) | np.arange(len(names))
        at = _window_min(packed, sample - q + 1) & _POS
        # Starts of whole windows: those of the texts that reach into this part.
        lo, hi = np.maximum(bounds[:-1], base), np.minimum(bounds[:-1] + lengths - sample, base + len(at) - 1)
        some = hi >= lo
        _, starts = _spread(lo[some], hi[some])
        if len(starts):
            at = at[starts - base]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            out.append((at[first] + base, names[at[first]].view(np.int64), starts[first], starts[last]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_document(rows: DataFrame, texts: DataFrame, *fields: str) -> DataFrame:
    """Different rows gathered for the document they belong to (no more than its own bytes give), with its text.

    Texts without a row are left out before the shuffle (see sieved).
    """
    gathered = rows.groupBy(*_KEY).agg(F.collect_set(F.struct(*fields)).alias("at"))
    gathered = written(gathered.select(*_KEY, *[F.col("at")[f].alias(f) for f in fields]))
    return sieved(texts, gathered, "rid").join(gathered, _KEY)


def _texts(piece: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """All texts of a batch in a row, and where each begins and the last one ends."""
    data = piece.column("data").to_pylist()
    return b"".join(data), np.cumsum([0, *map(len, data)])


def _listed(piece: pa.RecordBatch, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """For columns of lists: the row of each element, and all elements of each column."""
    sizes = piece.column(fields[0]).value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), [piece.column(f).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def _lists(owner: np.ndarray, count: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each of `count` rows; owner says, in order, whose each value is."""
    offsets = np.searchsorted(owner, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all numbers from lo to hi of each row: the row, and the number."""
    n = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _open_classes(rows: DataFrame, bucket: list[str], name: list[str], row: list[str]) -> tuple[DataFrame, DataFrame]:
    """Names that two rows or more share; and one row of each name in buckets of more than one name."""
    # All columns of one row: `first` takes them together.
    classes = written(rows.groupBy(*bucket, *name).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in row]))
    several = written(classes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").drop("classes"))
    return classes.filter("n > 1").select(*bucket, *name), classes.join(several, bucket).select(*row)


def repeated_spans(docs: DataFrame, length: int = 400, q: int = 50, block: int = 32) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, kept_sha256, shares_passage): spans (s, e) cover just the bytes of
    `length`-byte strings that start anywhere else too, in the same document or another.

    Bucket-pointer refinement over sampled suffixes. Suffixes at `anchors` (about two in 5 q bytes) fall into
    buckets by their first q bytes; buckets of one are done. The others are refined by the identifiers of buckets at other
    offsets, which are themselves made by refining (see identifiers), and what is settled in a pass is used again below it:
    1. all windows whose first 5 q bytes point at a suffix, by the buckets of the first and the last one: equal
       identifiers settle all of these windows at once, and one suffix stands for the class from here on;
    2. classes left in a bucket with others: blocks of `block` windows, first bucketed by the bytes that all of a
       block's windows share, then refined by the buckets of its first and last window;
    3. single windows of blocks that share a bucket but not an identifier.
    Identifiers have 128 bits and follow from the bytes alone, so tasks agree on them without a global order. Every pass is
    a group-by with partial sums and an equi-join, so no bucket is ever gathered, whatever its size; a document's own
    rows are gathered with its text (once, for documents with a shared bucket).

    shares_passage says that a document has a shorter string in common with a different one: always for 5 q bytes
    (250: about 45 words) or more, never for less than 4 q. Around a suffix lie 4 strings of 4 q bytes, of which one is
    inside any common string of 5 q bytes that holds the suffix's bucket. Nothing is removed for it.

    Strings are judged as UTF-8 bytes on the input; a null text is empty. Texts shorter than `length` keep all their
    bytes. Rows alike in doc_id and text repeat each other; a row that stands R times is gathered once, not R times. An
    empty table gives an empty result; further columns are ignored, whatever their names.
    """
    sample = 5 * q
    keyed = docs_of(docs).select("doc_id", F.encode("text", "utf-8").alias("data"), *row_key())
    ids = ("doc_id", *_KEY)

    def scan(piece: pa.RecordBatch) -> dict[str, object]:
        data, bounds = _texts(piece)
        p, name, s, _ = anchors(data, bounds, sample, q)
        owner = np.searchsorted(bounds, s, "right") - 1
        return {c: piece.column(c) for c in ids} | {
            "n_bytes": np.diff(bounds),
            "kept_sha256": [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
            "pos": _lists(owner, len(bounds) - 1, p - bounds[owner], pa.int32()),
            "name": _lists(owner, len(bounds) - 1, name, pa.int64()),
        }

    scanned = written(map_pieces(keyed, "doc_id long, rid long, did long, n_bytes long, kept_sha256 string, pos array<int>, name array<long>", scan, 1 << 20))
    at = scanned.select(*_KEY, F.explode(F.arrays_zip("pos", "name")).alias("a")).select(*_KEY, "a.pos", "a.name")
    # Written, so that the join that follows starts from two plain shuffles, of which Spark can split a hot name.
    shared = written(at.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"))
    chosen = at.join(shared, "name", "left_semi")

    def context(piece: pa.RecordBatch) -> dict[str, object]:
        data, bounds = _texts(piece)
        row, (wanted,) = _listed(piece, "pos")
        p, name, s, e = anchors(data, bounds, sample, q)
        keep = np.isin(p, wanted + bounds[row])
        p, name, s, e = p[keep], name[keep], s[keep], e[keep]
        owner = np.searchsorted(bounds, s, "right") - 1
        count = len(bounds) - 1
        # Strings of 4 q bytes around the suffix, as far as the text reaches.
        around = (p[:, None] - np.arange(4) * q).ravel()
        whose = np.repeat(owner, 4)
        inside = (around >= bounds[whose]) & (around + 4 * q <= bounds[whose + 1])
        (near,) = identifiers(data, around[inside], 4 * q, q, 1)
        # Windows of the full length; those that begin too late for it are left out.
        e = np.minimum(e, bounds[owner + 1] - length)
        full = e >= s
        p, name, s, e, own = p[full], name[full], s[full], e[full], owner[full]
        w1, w2 = _run(data, s, e, length, q, p - e, p - s)
        values = {"pos": p - bounds[own], "name": name, "lo": p - e, "hi": p - s, "w1": w1, "w2": w2}
        out = {c: _lists(own, count, v, pa.int32() if c in ("pos", "lo", "hi") else pa.int64()) for c, v in values.items()}
        return {c: piece.column(c) for c in (*ids, "data")} | out | {"near": _lists(whose[inside], count, near, pa.int64())}

    arrays = "pos array<int>, name array<long>, lo array<int>, hi array<int>, w1 array<long>, w2 array<long>, near array<long>"
    texts = written(map_pieces(_by_document(chosen, keyed, "pos"), f"doc_id long, rid long, did long, data binary, {arrays}", context, 1 << 20))
    near = texts.select(*_KEY, F.explode("near").alias("near"))
    common = written(near.groupBy("near").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low <> high").select("near"))
    sharing = near.join(common, "near", "left_semi").select(*_KEY).distinct()
    names = ("pos", "name", "lo", "hi", "w1", "w2")
    suffixes = texts.select(*_KEY, F.explode(F.arrays_zip(*names)).alias("a")).select(*_KEY, "a.*")
    texts = texts.drop(*names, "near")
    same, left = _open_classes(suffixes, ["name"], ["w1", "w2"], [*_KEY, "pos", "lo", "hi"])
    starts = [F.col("pos") - F.col("hi"), F.col("pos") - F.col("lo")]
    settled = [suffixes.join(same, ["name", "w1", "w2"], "left_semi").select(*_KEY, starts[0].alias("s"), starts[1].alias("e"))]

    def keys_of(piece: pa.RecordBatch, row: np.ndarray) -> dict[str, np.ndarray]:
        return {c: piece.column(c).to_numpy(zero_copy_only=False)[row] for c in _KEY}

    def blocks(piece: pa.RecordBatch) -> dict[str, object]:
        data, bounds = _texts(piece)
        owner, (pos, low, high) = _listed(piece, "pos", "lo", "hi")
        row, b = _spread(low // block, high // block)
        lo, hi = np.maximum(low[row], b * block), np.minimum(high[row], (b + 1) * block - 1)
        pos, owner = pos[row], owner[row]
        p = pos + bounds[owner]
        c1, c2 = (_pair(x.view(np.uint64), b.astype(np.uint64)).view(np.int64) for x in identifiers(data, p - b * block, length + 1 - block, q))
        w1, w2 = _run(data, p - hi, p - lo, length, q, b, lo, hi)
        return keys_of(piece, owner) | {"pos": pos, "lo": lo, "hi": hi, "c1": c1, "c2": c2, "w1": w1, "w2": w2}

    schema = "rid long, did long, pos int, lo int, hi int, c1 long, c2 long, w1 long, w2 long"
    parts = written(map_pieces(_by_document(left, texts, "pos", "lo", "hi"), schema, blocks, 1 << 20))
    same, left = _open_classes(parts, ["c1", "c2"], ["w1", "w2"], [*_KEY, "pos", "lo", "hi"])
    settled.append(parts.join(same, ["c1", "c2", "w1", "w2"], "left_semi").select(*_KEY, starts[0].alias("s"), starts[1].alias("e")))

    def windows(piece: pa.RecordBatch) -> dict[str, object]:
        data, bounds = _texts(piece)
        owner, (pos, lo, hi) = _listed(piece, "pos", "lo", "hi")
        row, s = _spread(pos - hi, pos - lo)
        w1, w2 = identifiers(data, s + bounds[owner[row]], length, q)
        return keys_of(piece, owner[row]) | {"s": s, "w1": w1, "w2": w2}

    single = written(map_pieces(_by_document(left, texts, "pos", "lo", "hi"), "rid long, did long, s int, w1 long, w2 long", windows, 1 << 20))
    twice = written(single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"))
    settled.append(single.join(twice, ["w1", "w2"], "left_semi").select(*_KEY, "s", F.col("s").alias("e")))
    found = settled[0].unionByName(settled[1]).unionByName(settled[2])

    def remove(cols: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "spans", "n_removed", "kept_sha256", "shares_passage")}
        for doc, data, s, e, shares in zip(cols["doc_id"], cols["data"], cols["s"], cols["e"], cols["shares"], strict=True):
            spans = merged([(a, b + length) for a, b in zip(s, e, strict=True)])
            kept = without(data, spans)
            row = (doc, len(data), [{"s": a, "e": b} for a, b in spans], len(data) - len(kept), hashlib.sha256(kept).hexdigest(), shares)
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return out

    schema = "doc_id long, n_bytes long, spans array<struct<s: int, e: int>>, n_removed long, kept_sha256 string, shares_passage boolean"
    marks = found.select(*_KEY, F.struct("s", "e").alias("x"), F.lit(False).alias("shares")).unionByName(
        sharing.select(*_KEY, F.lit(None).cast("struct<s: int, e: int>").alias("x"), F.lit(True).alias("shares"))
    )
    marks = written(marks.groupBy(*_KEY).agg(F.collect_set("x").alias("x"), F.max("shares").alias("shares")).select(*_KEY, "x.s", "x.e", "shares"))
    cut = marks.filter(F.size("s") > 0)
    touched = map_arrow(sieved(texts, cut, "rid").join(cut, _KEY), schema, remove)
    clean = scanned.join(marks, _KEY, "left").filter(F.coalesce(F.size("s"), F.lit(0)) <= 0)
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    clean = clean.select("doc_id", "n_bytes", none.alias("spans"), F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    return touched.unionByName(clean)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of disjoint spans in order."""
    ends = [0, *(e for _, e in spans)]
    starts = [*(s for s, _ in spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage), one row a document."""
    out = repeated_spans(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "shares_passage")
