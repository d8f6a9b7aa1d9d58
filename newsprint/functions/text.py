"""Text columns: entities, plain text, summaries, similarity. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities and their characters, replaced one after the other in this order.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&#8217;", "’"),
)

#: Beginnings of summaries that say nothing.
BOILERPLATE = ("article url:", "comments url:", "submitted by", "link: ", "url: ")

#: Words and signs that already tell of a video.
VIDEO_HINTS = ("video", "watch", "▶", "📺", "🎥", "🎬")

#: Commas of several scripts.
COMMAS = "[,،﹐︐︑⹁⸴⸲，]"

#: Markup characters and their escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def _replace_all(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def decode_entities(text: Column) -> Column:
    """The first replacement can make entities for the later ones: &amp;lt; ends as <."""
    return _replace_all(text, ENTITIES)


def html_escape(text: Column) -> Column:
    return _replace_all(text, ESCAPES)


def strip(text: Column) -> Column:
    """Without white space (Unicode's, line ends included) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_to_plain(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def clean_summary(text: Column) -> Column:
    return F.when(F.lower(text).rlike("^(" + "|".join(BOILERPLATE) + ")"), F.lit("")).otherwise(text)


def display_title(title: Column, summary: Column, is_video: Column) -> Column:
    told = F.lower(F.concat(title, F.lit(" "), summary)).rlike("|".join(VIDEO_HINTS))
    return F.when(is_video & ~told, F.concat(title, F.lit(" [VIDEO]"))).otherwise(title)


def inner_text(html: Column) -> Column:
    """Text of markup: tags go, ends are trimmed, runs of white space become one space."""
    return F.regexp_replace(strip(F.regexp_replace(html, "<[^>]*>", "")), r"\s{2,}", " ")


def paragraph_score(text: Column) -> Column:
    """Points of a paragraph of 25 characters or more: one, one for each part between commas, up to three for length."""
    parts = F.regexp_count(text, F.lit(COMMAS)) + 1
    return F.when(F.length(text) >= 25, 1 + parts + F.least(F.floor(F.length(text) / 100), F.lit(3))).cast("int")


def _words(text: Column) -> Column:
    # Splitting at what is not a word takes some nine times as long.
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def text_similarity(a: Column, b: Column) -> Column:
    """1 less the share of b's text that stands in tokens a lacks; 0 if either has none, or is null.

    Of a, only the tokens that b has too are kept, by one look at a hash set for each; these and b's are sorted together,
    a's first, so that one pass over them tells what a lacks. So a costs no more than finding its tokens, however long it is.
    """
    right = _words(b)
    none = F.struct(F.lit("").alias("known"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(state: Column, x: Column) -> Column:
        lacks = (x["k"] == 1) & (x["t"] != state["known"])
        known = F.when(x["k"] == 0, x["t"]).otherwise(state["known"])
        return F.struct(known.alias("known"), (state["n"] + lacks.cast("int")).alias("n"), (state["size"] + F.when(lacks, F.length(x["t"])).otherwise(0)).alias("size"))

    def tag(tokens: Column, k: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(k).alias("k")))

    def of(x: Column) -> Column:
        tagged = tag(x["both"], 0), tag(x["right"], 1)
        joined = F.aggregate(F.sort_array(F.concat(*tagged)), none, step, lambda s: s["size"] + F.greatest(s["n"] - 1, F.lit(0)))
        # Without a token in common the result is 0, whether a has tokens or not.
        return F.when(F.size(x["both"]) == 0, F.lit(0.0)).otherwise(1 - joined / F.length(F.array_join(x["right"], " ")))

    # The pair stands in an array of one, so that a's tokens are found once.
    pair = F.struct(F.array_intersect(_words(a), right).alias("both"), right.alias("right"))
    return F.get(F.transform(F.array(pair), of), F.lit(0))


def link_density(html: Column) -> Column:
    """Anchor text against all text of a piece of markup; links inside the page weigh 0.3."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    weight = F.transform(
        anchors,
        lambda a: F.length(inner_text(a)) * F.when(a.rlike(r"""(?i)^<a\b[^>]*href=["']#[^"']+["']"""), 0.3).otherwise(1.0),
    )
    total = F.length(inner_text(html))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.aggregate(weight, F.lit(0.0), lambda x, y: x + y) / total)
