"""Statistics of whole documents, for quality rules and classifiers, and the labelled rows models learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.llm.common import docs_of

#: The characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

NAMES = (
    "log_words", "word_chars", "symbol_rate", "symbol_words", "upper_rate", "mark_rate", "stop_rate", "comma_rate", "digit_rate", "repeat_rate",
    "distinct_rate", "twin_rate", "dup_line_rate", "short_words", "log_lines", "pipe_rate",
)


def repeat_words(words: list[bytes]) -> tuple[int, int, float]:
    """Words inside a 3-word window that occurs twice or more; distinct words; share of words equal to the one before."""
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    v = len(known)
    twins = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    if n < 4:
        return 0, v, twins
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # keep v * v * v below 2 ** 63
        pair = np.unique(pair, return_inverse=True)[1]
    _, back, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + 3 if n > 3 else at, -1)
    return int((np.cumsum(hit)[:n] > 0).sum()), v, twins


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines in all."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    return len(full) - len(set(full)), len(lines)


def counts(text: str) -> dict[str, int]:
    """Whole-text counts behind the quality rules."""
    words = text.encode("utf-8", "surrogatepass").split()
    repeats, distinct, twins = repeat_words(words)
    dups, lines = dup_lines(text)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dups,
        "n_repeat_words": repeats,
        "distinct": distinct,
        "lines": lines,
        "twins": twins,
        "words": words,
    }


def features(text: str, c: dict | None = None) -> list[float]:
    """NAMES: rates that do not depend on the language, on scales where classes look bell-shaped."""
    c = c or counts(text)
    words, n, chars = c["words"], max(1, c["n_words"]), max(1, c["word_chars"])
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    letters = max(1, upper + lower)
    marked = sum(1 for w in words if w[-1] in b"#*$%&|<>")
    return [
        np.log1p(c["n_words"]),
        chars / n,
        np.sqrt(c["n_symbols"] / chars),
        np.sqrt(marked / n),
        np.sqrt(upper / letters),
        np.sqrt((hist[33] + hist[63]) / n),
        np.sqrt(hist[46] / n),
        np.sqrt(hist[44] / n),
        np.sqrt(int(hist[48:58].sum()) / chars),
        np.sqrt(c["n_repeat_words"] / n),
        np.log1p(c["distinct"]) / np.log1p(n),
        np.sqrt(c["twins"]),
        np.sqrt(c["n_dup_lines"] / c["lines"]),
        np.sqrt(sum(1 for w in words if len(w) < 4) / n),
        np.log1p(c["lines"]),
        np.sqrt(hist[124] / n),
    ]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; of an empty text for a null id."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(modulus))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None, most: int = 20_000) -> DataFrame:
    """(doc_id, text, y): at most `most` labelled documents, those of the least hash of their id.

    The bound makes the label side safe to broadcast, so the documents are scanned and not shuffled. Labels that are
    null and ids that are null take no part; of several labels of a document the largest counts, and of several texts of
    an id the one of least hash, so that a repeated id is one row and the bound holds.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    if learn is not None:
        chosen = chosen.filter(learn)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs_of(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))
