"""Secrets behind other words, and PEM blocks as they stand in JSON, .env files and with headers."""

from __future__ import annotations

import base64

import pytest

pytest.importorskip("newsprint.llm")

from newsprint.llm import secrets  # noqa: E402

TOKEN = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.sig"
DER = base64.b64encode(b"\x30\x82\x01\x08\x02\x82\x01\x00" + bytes(range(1, 255)) + b"\x07\x08\x02\x02\x01\x03").decode()
SSH = base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(range(32))).decode()


def found(text: str, kind: str) -> list[str]:
    return [text[s:e] for s, e, k in secrets.scan(text) if k == kind]


@pytest.mark.parametrize("before", ["", "username.session.", "aaaaaaaa.bbbbbbbb.", "session_", "eyJhbGci.eyJhbGciO.", "x.y.", "eyeyey"])
def test_token_behind_words(before):
    assert found(f"see {before}{TOKEN} there", "jwt") == [TOKEN]


@pytest.mark.parametrize("before", ["", "keys/", "private_key_", "a/MI/AAAA/"])
def test_keys_behind_words(before):
    assert found(f"see {before}{DER} there", "der_key") == [DER]
    assert found(f"see {before}{SSH} there", "ssh_key") == [SSH]


@pytest.mark.parametrize("end", ["\n", "\\n", "\\r\\n", "\r\n"])
def test_pem_forms(end):
    rows = [DER[i : i + 64] for i in range(0, len(DER), 64)]
    pem = end.join(["-----BEGIN RSA PRIVATE KEY-----", *rows, "-----END RSA PRIVATE KEY-----"])
    assert found(f'{{"private_key": "{pem}{end}"}}', "pem_key") == [pem]
    body = base64.b64encode(bytes(range(128))).decode()
    pem = end.join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", "", body, "-----END RSA PRIVATE KEY-----"])
    assert found(pem, "pem_key") == [pem]


@pytest.mark.parametrize("before", ["prefixaa.", "session_token.value.", "user1234.", "a.b.c.d.", "eyJh", "x" * 9 + ".eyJhIjoxfQ."])
def test_spans_of_tokens(before):
    """Offsets are those of code points, and nothing but the token is added."""
    text = f"é {before}{TOKEN} é"
    at = 2 + len(before)
    assert [s for s in secrets.scan(text) if s[2] not in secrets.BASE] == [(at, at + len(TOKEN), "jwt")]


ED25519 = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(1, 33))


@pytest.mark.parametrize("before", ["", "/", "A", "sk-", "key/", "AAAA", "MII", "M"])
@pytest.mark.parametrize("key", [base64.b64decode(DER), ED25519])
def test_spans_of_keys(before, key):
    """All alignments of base64, and hex behind an odd digit."""
    body = base64.b64encode(key).decode()
    at = 4 + len(before)
    assert [s for s in secrets.scan(f"see {before}{body} there") if s[2] not in secrets.BASE] == [(at, at + len(body), "der_key")]
    for digits in ("", "f", "ab1"):
        text = f"see {digits}{key.hex()} there"
        at = 4 + len(digits)
        assert [s for s in secrets.scan(text) if s[2] not in secrets.BASE] == [(at, at + 2 * len(key), "der_key")]


def test_nested_strings():
    """What a string of an algorithm's key holds has to parse as well."""
    inner = b"\x30\x06\x02\x01\x05\x02\x01\x07"
    good = b"\x02\x01\x00\x30\x0d\x06\x09" + bytes(9) + b"\x05\x00\x04" + bytes([len(inner)]) + inner
    for body, want in ((good, 1), (good[:-5] + b"\x09" + good[-4:], 0), (b"\x02\x10" + bytes(16) + b"\x02\x10" + bytes(16), 0)):
        text = base64.b64encode(b"\x30" + bytes([len(body)]) + body).decode()
        assert len([s for s in secrets.scan(text) if s[2] == "der_key"]) == want


@pytest.mark.parametrize("text", ["a", "0", "A", "M", "MII", "eyJ", "eyJhIjox", "AAAAB3NzaC", "a.", "aaaaaaaa.", "token", "-----BEGIN KEY-----", "password = ", "f", "30820102", "AKIA"])
def test_time_follows_the_length(text):
    """Long runs of what candidates begin with: four times the text takes about four times as long."""
    import time

    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        secrets.scan((text * n)[:n] + ".aaaa.bbbb")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3 and took[1] < 8


def test_nothing_found():
    for text in ("MIMIMIMIMIMI" * 3000, "AAAA" * 9000, "eyJeyJ" * 5000 + ".aaaa.bbbb", "keys/" + DER[:-8], "a.eyJhbGciOiJIUzI1NiJ9"):
        assert not [s for s in secrets.scan(text) if s[2] not in secrets.BASE]
