"""Models without rows, without labels or with one class, repeated ids, clashing names; features against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import quality, stats, toxicity, trees  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"plain words number {i} and some more, of a text.") for i in range(12)] + [(None, None), (12, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(df):
    return [(r.score, r.predicted) for r in df.collect()]


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert scores(quality.score_quality(docs, none)) == [(0.5, 1)] * 14
    assert quality.keep_good(docs, none).count() == 14
    assert scores(toxicity.score_toxicity(docs, none)) == [(0.0, 0)] * 14
    rules = quality.quality_rules(docs, none).collect()
    assert len(rules) == 14 and all(r.kept != r.base_failed for r in rules)


@pytest.mark.parametrize("value", [0, 1])
def test_one_class(spark, docs, value):
    labels = spark.createDataFrame([(i, value, value) for i in range(12)] + [(None, 1, 1), (3, None, None)], LABELS)
    assert scores(quality.score_quality(docs, labels)) == [(0.5, 1)] * 14
    assert {p for _, p in scores(toxicity.score_toxicity(docs, labels))} == {value}
    assert quality.quality_rules(docs, labels).count() == 14


def test_no_documents(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], LABELS)
    for found in (quality.score_quality(none, labels), quality.keep_good(none, labels), toxicity.score_toxicity(none, labels), quality.quality_rules(none, labels)):
        assert found.collect() == []


def test_keep_good_leaves_columns_alone(spark):
    rows = [(i, "good words " * 20 if i % 2 else "%%% ### " * 20, 0.25, 7, None, {"a": i}) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, held_out string, extra map<string, int>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    kept = quality.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 2]


def test_repeated_ids_are_one_training_row(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (2, "c"), (None, "d")] + [(3, "hot")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0), (None, 1, 1), (4, 1, 1)], LABELS)
    got = {r.doc_id: (r.text, r.y) for r in stats.training_rows(docs, labels, "quality").collect()}
    assert got.keys() == {1, 2, 3} and got[1][1] == 1.0 and got[1][0] in "ab" and got[2] == ("c", 0.0) and got[3] == ("hot", 1.0)
    assert stats.training_rows(docs, labels, "quality", most=2).count() == 2


def plain_features(text: str) -> dict[str, float]:
    """The 16 statistics, counted one by one."""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + d for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = text.split("\n")
    full = [x for x in lines if x.strip(" \t\n\v\f\r")]
    up, low = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    root = {
        "symbol_rate": len(re.findall(r"[#*$%&|<>]", text)) / chars,
        "symbol_words": sum(w[-1] in "#*$%&|<>" for w in words) / n,
        "upper_rate": up / max(1, up + low),
        "mark_rate": len(re.findall("[!?]", text)) / n,
        "stop_rate": text.count(".") / n,
        "comma_rate": text.count(",") / n,
        "digit_rate": len(re.findall("[0-9]", text)) / chars,
        "repeat_rate": len(hit) / n,
        "twin_rate": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1),
        "dup_line_rate": (len(full) - len(set(full))) / len(lines),
        "short_words": sum(len(w.encode()) < 4 for w in words) / n,
        "pipe_rate": text.count("|") / n,
    }
    return {k: v**0.5 for k, v in root.items()} | {
        "log_words": np.log1p(len(words)),
        "word_chars": chars / n,
        "distinct_rate": np.log1p(len(set(words))) / np.log1p(n),
        "log_lines": np.log1p(len(lines)),
    }


def test_document_statistics():
    cases = ["", " ", "One, two! Three? 4 five. | a|b #x y# é ÉÉ", "a a a b\n\na a a b\n \nTail line.", "x " * 70, "L1\nL1\nl1\n\n", "\u00a0a\u00a0 b"]
    for text in cases:
        want = plain_features(text)
        assert np.allclose(stats.features(text), [want[n] for n in stats.NAMES]), text


def plain_toxic(text: str, lexicon: dict[str, float]) -> dict[str, float]:
    """The dense features, word by word."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    n = max(1, len(words))

    def weight(w):
        return max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "~", 0.0) for k in toxicity.STEMS if len(w) > k)])

    hot = [i for i, w in enumerate(words) if weight(w)]
    mixed = re.findall(r"\b(?=\w*[^\W\d_])[^\W_]*[0-9@$][\w@$]*\b|\b[^\W\d_]+[*@$!#][^\W\d_]+", low)
    hidden = sum(any(weight(w) for w in re.findall(r"[^\W\d_]+", m.translate(str.maketrans("013457@$", "oieastas")))) for m in mixed)
    return {
        "weight": sum(weight(words[i]) for i in hot),
        "rate": len(hot) / n,
        "hits": len(hot),
        "distinct": len({words[i] for i in hot}),
        "top": max((weight(words[i]) for i in hot), default=0.0),
        "near_second": sum(any(words[j] in toxicity.SECOND for j in range(max(0, i - 4), min(len(words), i + 5))) for i in hot),
        "second_rate": sum(w in toxicity.SECOND for w in words) / n,
        "plain_caps": sum(len(w) > 2 and w.isupper() for w in text.split()) / n,
        "mark_rate": len(re.findall("[!?]", text)) / n,
        "punctuation_rate": len(re.findall("[.,;:]", text)) / n,
        "mixed_rate": len(mixed) / n,
        "hidden_hits": hidden,
        "log_words": np.log1p(len(words)),
    }


def test_toxic_features():
    lexicon = {"moron": 2.0, "idiot": 3.0, "idio~": 1.5, "stupi~": 2.5}
    cases = ["", "You MORON, you idiotic stupid m0ron!", "a clean text; nothing to see: here.", "1d10t and id!ot said YOU " * 3, "Idiots idiot IDIOT far from the one who reads it now here ok you"]
    for text in cases:
        want = plain_toxic(text, lexicon)
        assert np.allclose(toxicity.features(text, lexicon), [want[n] for n in toxicity.NAMES]), text


def test_lexicon_is_log_odds(spark):
    rows = [("bad stuffing word", 1.0)] * 15 + [("fine word", 0.0)] * 30 + [("bad", 1.0)] * 5
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y double"))
    want = {k: np.log(((n + 0.5) / 21) / (0.5 / 31)) for k, n in {"bad": 20, "stuffing": 15, "stuf~": 15, "stuff~": 15, "stuffi~": 15}.items()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_verdict_follows_the_trees(spark):
    """kept is the trees' verdict over the statistics of each text, node by node."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["word", "other", "#x", "a|b", "And.", "more!"], size=int(n))) for n in rng.integers(55, 90, 60)] + ["short one"]
    x = np.array([stats.features(t) for t in texts])
    y = (x[:, stats.NAMES.index("symbol_rate")] < np.median(x[:, stats.NAMES.index("symbol_rate")])).astype(float)
    forest = trees.fit(x, y, [-1 if n in quality.FALLING else 0 for n in stats.NAMES], trees=10)

    def verdict(row):
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at]
        return total >= 0

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_rules(df, None, model=forest).collect():
        assert r.kept == (not r.base_failed and verdict(x[r.doc_id]))
