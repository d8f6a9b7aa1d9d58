"""Quality: a regularised quadratic discriminant, and rules with gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprint.llm import trees
from newsprint.llm.common import docs_of, map_arrow
from newsprint.llm.stats import NAMES, counts, features, remainder, training_rows


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunken covariances, and the factors' inverses, computed once."""

    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of log densities (Mahalanobis lengths in whitened coordinates)."""
        z = (x - self.shift) / self.scale
        log = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.inverses, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrink: float = 0.15, ridge: float = 0.05) -> Discriminant | None:
    """Covariance of a class: (1 - shrink) own + shrink pooled, plus ridge on the diagonal, over standardised features.

    None if a class has less than two rows, of which no covariance can be told.
    """
    if not len(x):
        return None
    shift, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - shift) / scale
    parts = [z[y == c] for c in (0, 1)]
    if not all(len(p) > 1 for p in parts):
        return None
    own = [np.cov(p.T) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
    means, factors, offsets = [], [], []
    for p, c in zip(parts, own, strict=True):
        factor = np.linalg.cholesky((1 - shrink) * c + shrink * pooled + ridge * np.eye(len(c)))
        means.append(p.mean(0))
        factors.append(factor)
        offsets.append(np.log(len(p) / len(z)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(factors), np.linalg.inv(np.array(factors)), np.array(offsets), scale, shift)


def _sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    rows = map_arrow(
        training_rows(docs, labels, label, learn, most), "y double, x array<double>", lambda c: {"y": c["y"], "x": [features(t) for t in c["text"]]}
    ).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    order = np.lexsort((*x.T, rows["y"]))  # the order of arrival does not matter
    return x[order], rows["y"].to_numpy()[order]


def classifier(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Discriminant | None:
    """Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1, `most` of them at most.

    None if they have not two rows of each class: then nothing can be told apart.
    """
    return fit_discriminant(*_sample(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, most))


def _score(text: Column, model: Discriminant | None) -> Column:
    """The model's score of a text; 0.5 without a model. No other column of the table passes through Python."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES))))

    return score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a document.

    A null text is an empty one and gets a score too. Repeated rows, and ties of any kind, get equal scores; a null doc_id
    counts as an empty id in held_out. Labels without two rows of each class give 0.5, predicted 1, to all. An empty table
    gives an empty result; further columns are ignored, whatever their names.
    """
    rows = docs_of(docs)
    out = rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), _score(F.col("text"), classifier(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be of quality 1 (see score_quality), with the columns of docs, whatever their names.

    Repeated rows stay or go together. Labels that do not tell classes apart let all documents stay.
    """
    return docs.filter(_score(F.col("text"), classifier(docs, labels)) >= 0.5)


#: The score may only fall as these rise.
FALLING = ("symbol_rate", "symbol_words", "repeat_rate", "dup_line_rate", "pipe_rate", "twin_rate")


def rule_model(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> trees.Forest:
    """Boosted trees over document statistics, learnt from `most` labelled rows at most."""
    x, y = _sample(docs, labels, "quality", None, most)
    return trees.fit(x, y, [-1 if n in FALLING else 0 for n in NAMES])


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = 20_000, model: trees.Forest | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every document.

    Base rules count over the whole text; a document of under 50 words, or with over half of its words inside repeated
    3-word windows, fails them. The others are kept if the trees give 0.5 or more: node arrays, scored for a batch at a
    time, that can only fall as the FALLING statistics rise. A null text is empty (and fails). Repeated rows are judged
    alike, and so are ties; extra columns are ignored, whatever their names; an empty table gives an empty result. Without
    labels there are no trees, and the base rules alone decide.
    """
    model = model or rule_model(docs, labels, most)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(cols: dict[str, list]) -> dict[str, object]:
        c = [counts(t) for t in cols["text"]]
        raw = model.raw(np.array([features(t, x) for t, x in zip(cols["text"], c, strict=True)]))
        failed = np.array([x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for x in c], bool)
        return {"doc_id": cols["doc_id"], **{b: [x[b] for x in c] for b in base}, "base_failed": failed, "score": 1 / (1 + np.exp(-raw)), "kept": ~failed & (raw >= 0)}

    schema = "doc_id long, " + "".join(f"{b} long, " for b in base) + "base_failed boolean, score double, kept boolean"
    return map_arrow(docs_of(docs), schema, rows)
