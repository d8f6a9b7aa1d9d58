"""Texts with very many hits, removed lines or nested headers, in time that follows their length."""

from __future__ import annotations

import base64
import json
import time

import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import decontaminate, lines, secrets  # noqa: E402


def encoded(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


@pytest.mark.parametrize("unit,close", [(b'{"x":', b"1" + b"}"), (b'{"a":0,"b":[', b"]}"), (b'{"a":"\\\\\\"{",', b"}"), (b'"{"', b"}"), (b'\\\\"', b"}")])
def test_nested_headers_take_time_by_length(unit, close):
    took = []
    for n in (20_000, 40_000):
        text = encoded(unit * n + close * n) + ".aaaa.bbbb"
        began = time.time()
        secrets._tokens(text, 0, len(text))
        took.append(time.time() - began)
    assert took[1] < 6 and took[1] < 4 * took[0] + 0.5


def test_headers_behind_and_inside_other_objects():
    head = json.dumps({"alg": "HS256", "note": 'a "quoted" } brace \\ { and ]'}).encode()
    for before in (b"", b'{"x":', b'{"open":"', b"}}}", b'"""', b"xyz"):
        pad = before + b" " * (-len(before) % 3)
        text = encoded(pad + head)
        assert list(secrets._headers(pad + head)) == [len(pad)], before
        assert secrets._tokens(f"{text}.eyJzdWIiOiIxIn0.c2ln", 0, len(text) + 21)
    assert not list(secrets._headers(b'{"alg":1}')) and not list(secrets._headers(b'{"a":{"alg":"x"}}')) and not list(secrets._headers(b' {"alg":"x"}'))
    assert list(secrets._headers(b'{"alg":"x"}  ')) == [0] and not list(secrets._headers(b"")) and not list(secrets._headers(b'{"alg":"x"'))


def test_very_many_runs(spark):
    """A document with 60,000 hits apart from one another, and a window of 400 items in 300 documents."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    many = " ".join(f"{item} w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, many), (2, many), (2, many)] + [(10 + i, f"x{i} {item} y") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, item) for i in range(400)], "item_id long, text string")
    decontaminate.digest(docs.filter("doc_id > 9"), bench).count()
    began = time.time()
    rows = decontaminate.digest(docs, bench).collect()
    assert time.time() - began < 40
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows)[:3] == [(1, 660_000, 600_000, 400), *[(2, 660_000, 600_000, 400)] * 2]
    assert {(r.n_hit, r.n_items, r.items_sha256) for r in rows if r.doc_id > 9} == {(10, 400, decontaminate.sha256_of([str(i) for i in range(400)]))}


def test_very_many_removed_lines(spark):
    text = "\n".join(f"{'first' if i % 3 else 'only'} line number {i if i % 3 == 0 else i % 7} of the text" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "other\n\n" + text), (3, "one\ntwo"), (4, None)], "doc_id long, text string")
    lines.digest(docs.filter("doc_id > 2")).count()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup_lines(docs, 10**6).collect()}
    assert time.time() - began < 60
    once = 33_334 + 6 + 1
    assert got[1][0] == 100_000 and got[1][0] - got[1][1] in (once, once - 1) and got[2] == (100_002, 100_000) and got[3] == (2, 0) and got[4] == (1, 0)
