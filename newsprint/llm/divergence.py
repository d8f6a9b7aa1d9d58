"""Source divergence audit: how far the words of each source of a language lie from those of the others."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprint.llm.common import byte_words, map_pieces, slices, written

_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("docs", pa.int64())])
_POSTING = pa.schema([f for f in _RUN if f.name != "docs"])
_SUM = "lang string, source string, item string, value long"


def _added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    return key[first], np.add.reduceat(value[order], first) if len(key) else value


def _run(block: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    """A block's postings in the order of language and term: a row for each, with its sources."""
    terms = sorted(set().union(*(count for count, _ in block.values())))
    place = {t: i for i, t in enumerate(terms)}
    groups = sorted(block)
    langs = sorted({lang for lang, _ in groups})
    size = [len(block[g][0]) for g in groups]
    head = np.concatenate([np.fromiter(map(place.__getitem__, block[g][0]), np.int64, n) + langs.index(g[0]) * len(terms) for g, n in zip(groups, size, strict=True)])
    count = np.concatenate([np.fromiter(block[g][0].values(), np.int64, n) for g, n in zip(groups, size, strict=True)])
    seen = np.concatenate([np.fromiter(map(block[g][1].__getitem__, block[g][0]), np.int64, n) for g, n in zip(groups, size, strict=True)])
    order = np.argsort(head, kind="stable")
    heads, docs = _added(head, seen)
    cuts = pa.array(np.r_[np.searchsorted(head[order], heads), len(head)], pa.int32())
    sources = pa.array([s for _, s in groups]).take(pa.array(np.repeat(np.arange(len(groups)), size)[order]))
    arrays = [
        pa.array(langs).take(pa.array(heads // len(terms))), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(heads % len(terms))),
        pa.ListArray.from_arrays(cuts, sources), pa.ListArray.from_arrays(cuts, pa.array(count[order])), pa.array(docs),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_RUN)


def term_runs(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(lang, term, sources, counts, docs): sorted runs of postings, each of a block of documents that fills the memory.

    A task counts terms in dictionaries of its own, in one pass over its documents. Once they hold `most` postings (and
    before that, a document at most more), they go out as a run in the order of (lang, term), and a new block begins.
    Each (lang, source) has a posting of the term '' with no occurrence, so that groups without terms are known. A very
    long text is one document of a block, whose different terms are all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch in batches:
            for piece in slices(batch):
                for lang, source, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    count, seen = block[lang, source]
                    held -= len(count)
                    words = byte_words(text, digits=False)
                    count.update(words)
                    count[b""] += 0
                    seen.update(set(words))
                    held += len(count)
                    if held >= most:
                        yield _run(block)
                        block.clear()
                        held = 0
        if block:
            yield _run(block)

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>, docs long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    size = len(columns[0])
    new = np.zeros(size, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, size - 1)))
    return np.flatnonzero(new)


def _merge(table: pa.Table, least: int) -> pa.RecordBatch:
    """Postings of whole terms from rows in order; terms in fewer than `least` documents of their language go, '' stays."""
    lang, term, sources, counts = (table.column(c).combine_chunks() for c in ("lang", "term", "sources", "counts"))
    first = _starts(lang, term)
    seen = np.add.reduceat(table.column("docs").to_numpy(), first)
    names = sources.flatten().dictionary_encode()
    size = np.diff(np.r_[first, len(term)])
    head = np.repeat(np.repeat(np.arange(len(first)), size), pc.list_value_length(sources).to_numpy())
    key, count = _added(head * len(names.dictionary) + names.indices.to_numpy(), counts.flatten().to_numpy())
    cuts = pa.array(np.searchsorted(key // len(names.dictionary), np.arange(len(first) + 1)), pa.int32())
    lists = pa.ListArray.from_arrays(cuts, names.dictionary.take(pa.array(key % len(names.dictionary))))
    heads = term.take(pa.array(first))
    keep = pa.array((seen >= least) | np.asarray(pc.equal(heads, "")))
    arrays = [lang.take(pa.array(first)), heads, lists, pa.ListArray.from_arrays(cuts, pa.array(count))]
    return pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], schema=_POSTING)


def postings(runs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, sources, counts) of the terms in `least` documents of their language or more, and of ''.

    Runs are dealt by (lang, term) into hash shards; Spark's sort of a shard spills and heap-merges the runs that it
    gets, and a task streams over them in order, with the rows of an Arrow batch and of one term in memory. A term has a
    row for each block at most, so a frequent one is no heavier than its sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(_RUN)
            cut = int(_starts(batch.column("lang"), batch.column("term"))[-1])
            whole = cut > 0 or rest and (rest[-1].column("lang")[-1], rest[-1].column("term")[-1]) != (batch.column("lang")[0], batch.column("term")[0])
            if whole and (rest or cut):
                yield _merge(pa.Table.from_batches([*rest, batch.slice(0, cut)]), least)
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield _merge(pa.Table.from_batches(rest), least)

    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 1) / total), exact in 64 bits: the quotient is taken three digits at a time."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def surprise(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); both are at most 10 ** 9 + 1, so the square fits."""
    return (p - q) ** 2 // q


def _terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a source uses more than its language does."""

    def run(piece: pa.RecordBatch) -> dict[str, object]:
        count, total, all_n, all_total = (piece.column(c).to_numpy() for c in ("n", "total", "lang_n", "lang_total"))
        p, q = shares(count, total), shares(all_n, all_total)
        keep = pa.array((count > 0) & (p > q))
        names = {c: piece.column(d).filter(keep) for c, d in (("lang", "lang"), ("source", "source"), ("item", "term"))}
        return names | {"value": pa.array(surprise(p, q)).filter(keep)}

    return map_pieces(rows, _SUM, run, 8 << 20)


def _together(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Corrections of pairs of sources that both have a term, streamed term by term.

    Beside a pair's sums for terms that only one of its sources has (see _alone), a shared term adds
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), with p0 and q0 the shares of a count of zero. Corrections are held as
    numbers of a batch's groups and added up once about `most` are there, so a task sends a row for each pair and batch
    at most. Terms of as many sources are worked on together, a slice of their pairs at a time.
    """

    def run(piece: pa.RecordBatch) -> dict[str, object]:
        lists = {c: piece.column(c) for c in ("sources", "counts", "totals")}
        size = pc.list_value_length(lists["sources"]).to_numpy()
        start = np.cumsum(size) - size
        names, langs = lists["sources"].flatten().dictionary_encode(), piece.column("lang").dictionary_encode()
        width = len(names.dictionary)
        own = names.indices.to_numpy().astype(np.int64) + np.repeat(langs.indices.to_numpy().astype(np.int64), size) * width
        count, total = (lists[c].flatten().to_numpy() for c in ("counts", "totals"))
        p, p0 = shares(count, total), shares(np.zeros_like(count), total)
        key, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for n in np.unique(size).tolist():
            at = start[size == n]
            step = max(1, most // (n * n))
            part = max(1, min(n, most // n))
            for lo in range(0, len(at), step):
                place = at[lo : lo + step, None] + np.arange(n)
                for i in range(0, n, part):
                    a, b, g = (x[place[:, i : i + part]][:, :, None] for x in (p, p0, own))
                    q, q0, h = (x[place][:, None, :] for x in (p, p0, own))
                    found = surprise(a, q) - surprise(a, q0) - surprise(b, q) + surprise(b, q0)
                    keep = g != h
                    parts.append(_added((g << 32 | h)[keep], found[keep]))
                    held += len(parts[-1][0])
                    if held >= most:
                        key, value = _added(*(np.concatenate([x, *(y[k] for y in parts)]) for k, x in enumerate((key, value))))
                        parts, held = [], 0
        key, value = _added(*(np.concatenate([x, *(y[k] for y in parts)]) for k, x in enumerate((key, value))))
        first, second = key >> 32, key & 0xFFFFFFFF
        named = {"lang": langs.dictionary.take(pa.array(first // width)), "source": names.dictionary.take(pa.array(first % width))} if width else {"lang": [], "source": []}
        return named | {"item": names.dictionary.take(pa.array(second % max(1, width))), "value": value}

    return map_pieces(rows, _SUM, run, 8 << 20)


def _alone(rows: DataFrame) -> DataFrame:
    """For each group, what it adds to its pairs with all others: counts of zero everywhere, then its own counts.

    rows (lang, source, total, kept, seen, times, others, totals) are one a group: it has `times` terms of `seen`
    occurrences each, so a group's row is as long as it has different counts.
    """

    def run(piece: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("lang", "source", "item", "value")}
        columns = [piece.column(c).to_pylist() for c in ("lang", "source", "total", "kept", "seen", "times", "others", "totals")]
        for lang, source, total, kept, seen, times, others, totals in zip(*columns, strict=True):
            if not kept:
                near = far = [0] * len(others)
            else:
                none = np.zeros(1, np.int64)
                q0 = shares(none, np.array(totals, np.int64))
                p, p0 = shares(np.array(seen, np.int64), np.int64(total)), shares(none, np.int64(total))
                base = surprise(p0, q0)
                near, back = kept * base, surprise(q0, p0)
                far = np.zeros_like(near)
                for x, k in zip(p, np.array(times, np.int64), strict=True):
                    near = near + k * (surprise(x, q0) - base)
                    far = far + k * (surprise(q0, x) - back)
                near, far = near.tolist(), far.tolist()
            for other, mine, theirs in zip(others, near, far, strict=True):
                if other != source:
                    out["lang"] += [lang, lang]
                    out["source"] += [source, other]
                    out["item"] += [other, source]
                    out["value"] += [mine, theirs]
        return out

    return map_pieces(rows, _SUM, run, 1 << 20)


def divergence(docs: DataFrame, least: int = 3, ranks: int = 200, most: int = 400_000) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs.

    Part `pair`: item is each other source of the language; value sums floor((p - q) ** 2 / q) over all terms that the
    language keeps (those in `least` of its documents), p and q being the smoothed shares of the term in either source.
    Part `term`: the `ranks` terms of the greatest value that the source uses more than its language as a whole.

    Blocks of postings become sorted runs, runs become frequencies shard by shard, and pairs of sources are corrected by
    a stream of postings: the sum for counts of zero comes first, then each group's own counts against zeros, then the
    terms that both have. So the work goes with the postings and with the pairs that are the result, not with terms times
    pairs. Only sums of pairs and groups are shuffled beside the postings.

    Null texts, languages and sources are empty ones; a group without a term has its pairs all the same, and a language
    without kept terms has pairs of value 0. Repeated rows are documents by themselves. An empty table gives no rows;
    further columns are ignored.
    """
    merged = written(postings(term_runs(docs, most), least))
    lang_n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("lang_n")
    flat = merged.select("lang", "term", lang_n, F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    flat = flat.select("lang", "term", "lang_n", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    real = flat.filter("term <> ''")
    kept = merged.filter("term <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = flat.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    groups = written(groups.withColumn("total", F.col("n") + F.col("kept")))
    langs = written(groups.groupBy("lang").agg((F.sum("n") + F.max("kept")).alias("lang_total"), F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g")))
    rows = written(real.join(groups.select("lang", "source", "total"), ["lang", "source"]))
    told = rows.join(langs.select("lang", "lang_total"), "lang")
    lists = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total")).alias("x")).filter(F.size("x") > 1)
    lists = lists.select("lang", F.col("x.source").alias("sources"), F.col("x.n").alias("counts"), F.col("x.total").alias("totals"))
    times = rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("n", "k")).alias("x"))
    own = groups.join(times, ["lang", "source"], "left").join(langs.select("lang", "g"), "lang")
    none = F.array().cast("array<long>")
    own = own.select("lang", "source", "total", "kept", F.coalesce("x.n", none).alias("seen"), F.coalesce("x.k", none).alias("times"), F.col("g.source").alias("others"), F.col("g.total").alias("totals"))
    pairs = _together(lists).unionByName(_alone(own)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(_terms(told).withColumn("part", F.lit("term")))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    term_best = both.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)
    pair_best = both.filter("part = 'pair'").withColumn("rank", F.row_number().over(best))
    return pair_best.unionByName(term_best).select("lang", "source", "part", "item", "value", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same rows for DuckDB: every kept term of a language for each of its groups.
SQL = f"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as found
    from documents
),
words as (select r, lang, source, w, count(*) as n from (select r, lang, source, unnest(found) as w from docs) group by all),
kept as (select lang, w from words group by 1, 2 having count(*) >= 3),
sizes as (select lang, count(*) as v from kept group by 1),
groups as (select distinct lang, source from docs),
counts as (select lang, source, w, sum(n)::hugeint as n from words join kept using (lang, w) group by 1, 2, 3),
group_n as (select lang, source, sum(n) as total from counts group by 1, 2),
lang_n as (select lang, w, sum(n) as n, sum(sum(n)) over (partition by lang) as total from counts group by 1, 2),
shares as (
    select g.lang, g.source, k.w, coalesce(c.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + s.v)::hugeint as p
    from groups g join kept k on g.lang = k.lang join sizes s on s.lang = g.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.w = k.w left join group_n t on t.lang = g.lang and t.source = g.source
),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.w = x.w
    where x.w is null or y.w is not null group by 1, 2, 3
),
terms as (
    select x.lang, x.source, x.w as item, ((x.p - q.q) * (x.p - q.q) // q.q)::bigint as value
    from shares x join (select lang, w, 1 + (1000000000::hugeint * (n + 1)) // (total + v)::hugeint as q from lang_n join sizes using (lang)) q on q.lang = x.lang and q.w = x.w
    where x.n > 0 and x.p > q.q
)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""
