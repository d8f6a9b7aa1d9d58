"""Line dedup: exact copies, and lines a few edits apart by a segment-partition join. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.llm.common import components, row_key, scratch, sieved, unlike, written

_KEY = ["rid", "did"]


def edits_within(s: Column, t: Column, threshold: int) -> Column:
    """Whether two strings are at most `threshold` edits apart: a banded automaton, a bit for each diagonal.

    State e holds the diagonals that e edits can reach after a prefix of s; one step takes a character of s. A match keeps
    the diagonal, a substitution too, a deletion goes one down and an insertion one up, at the cost of an edit each.
    """
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    start = [F.lit(sum(1 << (threshold + k) for k in range(e + 1))).cast("int").alias(f"r{e}") for e in range(threshold + 1)]
    # The characters travel in the state: an expression inside the step would be computed anew for each character.
    first = F.struct(F.split(s, "").alias("s"), F.split(t, "").alias("t"), *start)

    def step(state: Column, i: Column) -> Column:
        here, other = F.get(state["s"], i), state["t"]
        same = reduce(lambda x, y: x.bitwiseOR(y), [F.when(here == F.get(other, i + (d - threshold)), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)])
        new: list[Column] = []
        for e in range(threshold + 1):
            now = state[f"r{e}"].bitwiseAND(same)
            if e:
                less = state[f"r{e - 1}"]
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(F.lit(full))
            new.append(now)
        return F.struct(state["s"].alias("s"), other.alias("t"), *[x.alias(f"r{e}") for e, x in enumerate(new)])

    end = F.length(t) - F.length(s) + threshold
    reach = F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), first, step, lambda r: r[f"r{threshold}"])
    fits = F.abs(F.length(t) - F.length(s)) <= threshold
    return F.when(~fits, False).when(F.length(s) == 0, fits).otherwise(F.call_function("shiftright", reach, end).bitwiseAND(F.lit(1)) == 1)


def split_lines(docs: DataFrame) -> DataFrame:
    """(rid, did, idx, line, lid, n) for every line with a character other than white space."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    # The key of a row is worked out once, in front of the lines, which would carry the whole text along otherwise.
    out = keyed.select(*row_key(), F.split("text", "\n").alias("lines")).select(*_KEY, F.posexplode("lines").alias("idx", "line"))
    return out.filter(F.col("line").rlike(r"[^\x09-\x0D\x20]")).select("*", F.xxhash64("line").alias("lid"), F.length("line").alias("n"))


def _cut(rows: DataFrame, count: int) -> DataFrame:
    """Every row once for each of `count` segments of its rest: keyed by all of the rest but the segment, which is the new rest.

    rows: (key, lid, longer, size, rest, before, last). Under a key lie rests of `size` characters and, where `longer` says
    so, of one more, which one deletion has to bring to `size`. Two rests are one edit apart just if, for some segment, all
    else is equal and the segments are one edit apart. before is the character in front of the rest; last says whether the
    line ends with it.
    """
    parts = F.least(F.lit(count), F.col("size"))
    out = rows.withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    out = out.withColumns({"lo": F.expr(f"int(size * j div least({count}, size))"), "hi": F.expr(f"int(size * (j + 1) div least({count}, size))"), "more": F.col("longer").cast("int")})
    tail = F.expr("substring(rest, hi + more + 1, size)")
    return out.select(
        F.xxhash64("key", "size", "j", F.expr("substring(rest, 1, lo)"), tail).alias("key"), "lid", "longer", (F.col("hi") - F.col("lo")).alias("size"),
        F.expr("substring(rest, lo + 1, hi - lo + more)").alias("rest"), F.when(F.col("lo") > 0, F.expr("substring(rest, lo, 1)")).otherwise(F.col("before")).alias("before"),
        (F.col("last") & (F.col("j") == parts - 1)).alias("last"),
    )


def _halved(lines: DataFrame, least: int) -> DataFrame:
    """The rows of _cut for both halves of each line, as it is and as the longer one of two."""
    whole = lines.select("lid", F.col("line").alias("rest"), "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    whole = whole.withColumn("size", F.col("n") - F.col("longer").cast("int")).filter(F.col("size") >= max(2, least))
    return _cut(whole.select(F.lit(0).cast("long").alias("key"), "lid", "longer", "size", "rest", F.lit("").alias("before"), F.lit(True).alias("last")), 2)


def _but_one_part(t: Column, s: Column, size: Column, parts: int = 8) -> Column:
    """Whether s is t but for one of `parts` parts, behind which s may be shifted: it is, if one edit lies between."""
    shift = F.length(s) - size
    found = []
    for j in range(parts):
        lo, hi = F.floor(size * j / parts).cast("int"), F.floor(size * (j + 1) / parts).cast("int")
        front = F.substring(t, F.lit(1), lo) == F.substring(s, F.lit(1), lo)
        found.append(front & (F.substring(t, hi + 1, size) == F.substring(s, hi + 1 + shift, size)))
    return reduce(lambda x, y: x | y, found)


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b): rows of a key whose rests are one edit apart. Each pair of lines is given under one key alone.

    Of the deletions that turn a rest into a shorter one, the leftmost counts: it must not be possible further left, in
    front of the rest, nor lie at the end of a segment, which is the beginning of the next one.
    """
    own = rows.filter("not longer").select("key", F.col("lid").alias("a"), F.col("rest").alias("t"), "size", "before", "last")
    other = rows.select("key", F.col("lid").alias("b"), F.col("rest").alias("s"), "longer")
    met = own.join(other, "key").filter("longer or a < b").filter(_but_one_part(F.col("t"), F.col("s"), F.col("size")))
    met = met.filter(edits_within(F.col("t"), F.col("s"), 1))
    left = F.expr("substring(s, 1, 1) = before and substring(s, 2, size) = t")
    right = F.expr("not last and substring(s, 1, size) = t and substring(s, size + 1, 1) <> substring(s, size, 1)")
    return met.filter(~F.col("longer") | ~(left | right)).select("a", "b")


def _single(rows: DataFrame) -> DataFrame:
    """(a, b) for rows whose rest is one character, or two in longer ones, of which one deletion leaves one (see _pairs)."""
    first, second = F.substring("rest", 1, 1), F.substring("rest", 2, 1)
    left = F.array_compact(F.array(F.when(first != F.col("before"), second), F.when(F.col("last") & (first != second), first)))
    longer = rows.filter("longer").select("key", F.col("lid").alias("b"), F.explode(left).alias("rest"))
    return rows.filter("not longer").select("key", "rest", F.col("lid").alias("a")).join(longer, ["key", "rest"]).select("a", "b")


def one_edit(lines: DataFrame, least: int = 24, hot: int = 8, fan: int = 4) -> tuple[DataFrame, DataFrame]:
    """Links between different lines (lid, line, n) one edit apart, the shorter of `least` characters or more.

    First (a, b): edges that connect just what all links connect. Second (lid, links): the number of a line's links.

    Halves are the segments: of two lines one edit apart, one half of the shorter stands in the longer at its own place, or
    one further on. Keys are computed where the lines are read, and only keys that two different lines have go on. The
    lines of a key are compared pair by pair while they are `hot` at most. A larger family is keyed anew by segments of
    what is left of its lines (see _cut), until one character is left: then all lines of the key are links of one another,
    which a star and their number stand for. So the rows stay a multiple of the lines, however large a family is.
    """
    keyed = _halved(lines, least)
    shared = keyed.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high"), F.min("longer").alias("none")).filter("low <> high and not none")
    shared = written(shared.select("key"))
    rows = written(sieved(keyed, shared, "key").join(shared, "key").distinct())
    pairs, stars, degrees = [], [], []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("longer")).alias("own"), F.min(F.when(~F.col("longer"), F.col("lid"))).alias("head"))
        live = written(rows.join(written(sizes.filter("m > 1 and own > 0")), "key"))
        leaf, small = live.filter("size = 1"), live.filter(f"size > 1 and m <= {hot}")
        pairs += [written(_pairs(small)), written(_single(leaf))]
        same = leaf.filter("not longer and own > 1")
        stars.append(same.filter("lid <> head").select(F.col("head").alias("a"), F.col("lid").alias("b")))
        degrees.append(same.select("lid", (F.col("own") - 1).alias("links")))
        large = live.filter(f"size > 1 and m > {hot}")
        if large.isEmpty():
            break
        rows = written(_cut(large.select(*rows.columns), fan))
    found = reduce(DataFrame.unionByName, pairs)
    degrees.append(found.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count(F.lit(1)).alias("links")))
    count = reduce(DataFrame.unionByName, degrees).groupBy("lid").agg(F.sum("links").alias("links"))
    return reduce(DataFrame.unionByName, stars, found), written(count)


def duplicate_lines(docs: DataFrame, least: int = 24) -> DataFrame:
    """(rid, did, removed, n_links): for each document with any, the numbers of the lines that go, and its lines' links.

    Lines that equal one another, or that links of one_edit connect, are a class; its first line, by doc_id and then
    place, stays. Lines of white space are left alone. Rows alike in doc_id and text count as one document.
    """
    lines = split_lines(docs)
    place = F.struct("did", "rid", "idx")
    with scratch(docs.sparkSession):
        found = written(lines.groupBy("lid").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
        links, degree = one_edit(lines, least)
        classes = components(links).withColumnsRenamed({"node": "lid"})
        known = found.join(classes, "lid", "left").join(degree, "lid", "left").filter("n > 1 or root is not null")
        known = written(known.withColumn("root", F.coalesce("root", "lid")))
        keeper = known.groupBy("root").agg(F.min("first").alias("keep"))
        judged = written(known.join(keeper, "root").select("lid", "keep", F.coalesce("links", F.lit(0)).alias("links")), keep=True)
    rows = lines.select(*_KEY, "idx", "lid").join(judged, "lid").select(*_KEY, "idx", (place != F.col("keep")).alias("gone"), "links")
    mine = rows.groupBy(*_KEY).agg(F.collect_set(F.struct("idx", "gone", "links")).alias("x"))
    removed = F.array_sort(F.transform(F.filter("x", lambda e: e["gone"]), lambda e: e["idx"]))
    return mine.select(*_KEY, removed.alias("removed"), F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e["links"]).alias("n_links"))


def _mask(removed: Column) -> Column:
    """Whether each line up to the last removed one goes, from the numbers of removed lines in order."""
    before = F.slice(F.concat(F.array(F.lit(-1)), removed), F.lit(1), F.size(removed))
    return F.flatten(F.zip_with(before, removed, lambda x, y: F.concat(F.array_repeat(F.lit(False), y - x - 1), F.array(F.lit(True)))))


def _judged(docs: DataFrame, least: int) -> tuple[DataFrame, str]:
    """docs with a further column, a struct (text, n_lines, n_removed, n_links), whose name is returned too."""
    rid, did, new = unlike(docs, "rid"), unlike(docs, "did"), unlike(docs, "new")
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    keyed = docs.withColumns({rid: F.xxhash64(doc_id, text), did: F.coalesce(doc_id, F.lit(0))})
    gone = duplicate_lines(docs, least).withColumn("mask", _mask(F.col("removed")))
    gone = gone.select(F.col("rid").alias(rid), F.col("did").alias(did), F.struct("removed", "n_links", "mask").alias(new))
    lines, empty = F.split(text, "\n"), F.array().cast("array<int>")
    removed = F.coalesce(F.col(f"{new}.removed"), empty)
    # The mask comes out of the join, so a line looks at one place of it and nothing is worked out for each line.
    goes = lambda _, i: ~F.coalesce(F.get(F.col(f"{new}.mask"), i), F.lit(False))
    kept = F.when(F.size(removed) == 0, text).otherwise(F.array_join(F.filter(lines, goes), "\n"))
    what = F.struct(kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.coalesce(F.col(f"{new}.n_links"), F.lit(0)).alias("n_links"))
    return keyed.join(gone, [rid, did], "left").withColumn(new, what).select(*docs.columns, new), new


def dedup_lines(docs: DataFrame, least: int = 24) -> DataFrame:
    """docs with text cut to its first lines, and n_lines, n_removed, n_links; one row a document, all columns stay.

    A line links to those one edit away, if the shorter has `least` characters (an edit for `least` characters is the
    measure of likeness, so shorter lines are alike only if equal); n_links adds up the links of the document's lines. A
    null text is empty: one blank line, which stays. A null doc_id counts as 0 for which line is first. Repeated rows are
    one document, and each of them is returned. An empty table gives an empty result. Columns of docs named like the new
    ones are replaced.
    """
    out, new = _judged(docs.drop("n_lines", "n_removed", "n_links"), least)
    return out.withColumn("text", F.col(f"{new}.text")).select("*", f"{new}.n_lines", f"{new}.n_removed", f"{new}.n_links").drop(new)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, kept_sha256), one row a document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_links", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def keep_first_lines(docs: DataFrame, least: int = 24) -> DataFrame:
    """docs with each class of lines once (see dedup_lines); documents of which no line is left go.

    The columns are those of docs, whatever their names; n_chars, if there, follows the text.
    """
    out, new = _judged(docs, least)
    text = F.col(f"{new}.text")
    out = out.filter((F.col(f"{new}.n_removed") == 0) | text.rlike(r"[^\x09-\x0D\x20]")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
