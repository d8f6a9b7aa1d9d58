"""Toxicity: boosted trees over lexicon, address, shouting and obfuscation features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprint.llm import trees
from newsprint.llm.common import docs_of, map_arrow, written
from newsprint.llm.stats import remainder, training_rows

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"\b(?=\w*[^\W\d_])[^\W_]*[0-9@$][\w@$]*\b|\b[^\W\d_]+[*@$!#][^\W\d_]+")
#: Look-alike characters and what they stand for.
_LOOKS = str.maketrans("013457@$", "oieastas")
#: Words that address the reader.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted ustedes ti tus vosotros".split())
STEMS = (4, 5, 6)
NAMES = (
    "weight", "rate", "hits", "distinct", "top", "near_second", "second_rate", "plain_caps", "mark_rate", "punctuation_rate", "mixed_rate",
    "hidden_hits", "log_words",
)


def _keys(word: str) -> list[str]:
    """The word itself, and its beginnings, which stand for inflected forms."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    weight = {w: max((lexicon.get(k, 0.0) for k in _keys(w)), default=0.0) for w in set(words)}
    hot = {w: v for w, v in weight.items() if v}
    at = [i for i, w in enumerate(words) if w in hot] if hot else []
    near = sum(1 for i in at if SECOND.intersection(words[max(0, i - 4) : i + 5])) if at else 0
    mixed = _MIXED.findall(low) if re.search(r"[0-9@$*!#]", low) else []
    hidden = sum(1 for m in mixed if any(k in lexicon for w in _WORD.findall(m.translate(_LOOKS)) for k in _keys(w)))
    caps = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    return [
        sum(hot[words[i]] for i in at),
        len(at) / n,
        len(at),
        len(hot),
        max(hot.values(), default=0.0),
        near,
        sum(1 for w in words if w in SECOND) / n,
        caps / n,
        (text.count("!") + text.count("?")) / n,
        sum(map(text.count, ".,;:")) / n,
        len(mixed) / n,
        hidden,
        np.log1p(len(words)),
    ]


def learn_lexicon(rows: DataFrame, most: int = 400, least: int = 12, odds: float = 8.0) -> dict[str, float]:
    """Words and beginnings far likelier in toxic documents: log odds of the `most` strongest. rows: (text, y)."""

    def stems(cols: dict[str, list]) -> dict[str, object]:
        seen = (Counter(), Counter())
        for text, y in zip(cols["text"], cols["y"], strict=True):
            seen[int(y > 0.5)].update({k for w in set(_WORD.findall(text.lower())) for k in _keys(w)})
        both = list(seen[0].keys() | seen[1].keys())
        return {"stem": both, "clean": [seen[0][k] for k in both], "toxic": [seen[1][k] for k in both]}

    total = rows.agg(F.count_if(F.col("y") > 0.5), F.count_if(F.col("y") <= 0.5)).first()
    found = map_arrow(rows.select("text", "y"), "stem string, clean long, toxic long", stems).groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = ((F.col("toxic") + 0.5) / (total[0] + 1)) / ((F.col("clean") + 0.5) / (total[1] + 1))
    strong = found.filter(F.col("toxic") >= least).withColumn("w", F.log(rate)).filter(F.col("w") >= np.log(odds))
    return {r["stem"]: r["w"] for r in strong.orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "stem").limit(most).collect()}


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: trees.Forest
    knots: np.ndarray
    shares: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability; a share of the raw one breaks ties inside a level step."""
        if not texts or not len(self.forest.feature):
            return np.zeros(len(texts))
        p = 1 / (1 + np.exp(-self.forest.raw(np.array([features(t, self.lexicon) for t in texts]))))
        return np.clip(0.99 * np.interp(p, self.knots, self.shares) + 0.01 * p, 0, 1)


def classifier(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0, `most` of them at most.

    A quarter of them, which the trees do not see, calibrates the scores.
    """
    rows = training_rows(docs, labels, "toxic", remainder(F.col("doc_id"), 5) != 0, most)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4))
    rows = written(rows.withColumn("part", part))
    lexicon = learn_lexicon(rows.filter("part > 0"))
    got = map_arrow(
        rows.select("text", "y", "part"), "y double, part int, x array<double>", lambda c: {"y": c["y"], "part": c["part"], "x": [features(t, lexicon) for t in c["text"]]}
    ).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    order = np.lexsort((*x.T, got["y"], got["part"]))
    x, y, fold = x[order], got["y"].to_numpy()[order], got["part"].to_numpy()[order]
    forest = trees.fit(x[fold > 0], y[fold > 0], [1 if n in ("weight", "rate", "top", "distinct", "hits") else 0 for n in NAMES])
    if not (fold == 0).any():
        return Model(lexicon, forest, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, shares = trees.isotonic(1 / (1 + np.exp(-forest.raw(x[fold == 0]))), y[fold == 0])
    return Model(lexicon, forest, knots, shares)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a document.

    The lexicon has at most 400 words and beginnings, each in 12 toxic training documents or more (see learn_lexicon).
    A null text is an empty one and gets a score too. Repeated rows, and ties of any kind, get equal scores; a null doc_id
    counts as an empty id in held_out; extra columns are ignored, whatever their names; an empty table gives an empty
    result. Without labelled rows the score is 0; labels of one class give all documents nearly that class's score.
    """
    model = model or classifier(docs, labels)

    def rows(cols: dict[str, list]) -> dict[str, object]:
        s = model.score(cols["text"])
        return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    out = map_arrow(docs_of(docs), "doc_id long, score double, predicted int", rows)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
