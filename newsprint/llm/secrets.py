"""Secret scan: patterns, and structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from newsprint.llm.common import docs_of, map_arrow

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_STARTS = ("passw", "secret", "token", "api")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_ANY = re.compile(r"[0-9a-fA-F]{48,}")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_SEGMENT = re.compile(r"[A-Za-z0-9_-]{8,}")
_TAIL = re.compile(r"\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: How a DER sequence and an ssh key begin in base64, and in hex.
_OPENING = re.compile(r"(?=M[A-I]|AAAA[B-P][GHWXmn23]|b3BlbnNzaC1rZXk)")
_HEX_OPENING = re.compile(r"(?=30(?:8[1-4]|[1-7])|000000[0-3][0-9a-f](?:73|65)|6f70656e7373682d6b6579)", re.I)
_MAGIC = b"openssh-key-v1\0"
#: Keys have fewer parts than this at any level.
_PARTS = 64
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----(?:\s|\\[rn])*((?:[A-Za-z][A-Za-z0-9-]{0,40}: [^\n\\]{0,200}(?:\n|\\[rn])(?:\s|\\[rn])*){0,8}+)"
    r"((?:[A-Za-z0-9+/=\s]|\\[rn]){16,}?)-----END \1-----"
)
_ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED\b.*DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}", re.S)
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "der_key", "ssh_key", "pem_key")


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: Bytes of a candidate from a place on, as many as asked for or as there are; decoded only where they are looked at.
Read = Callable[[int, int], bytes]


def _in_base64(text: str, at: int, hi: int) -> tuple[Read, int]:
    """The bytes that base64 between two places stands for, and their number."""

    def read(i: int, n: int) -> bytes:
        lo = at + i // 3 * 4
        return (_b64(text[lo : min(hi, at + -(-(i + n) // 3) * 4)]) or b"")[i % 3 : i % 3 + n]

    return read, (hi - at) * 3 // 4


def _in_hex(text: str, at: int, hi: int) -> tuple[Read, int]:
    size = (hi - at) // 2
    return lambda i, n: bytes.fromhex(text[at + 2 * i : at + 2 * min(size, i + n)]), size


def _element(read: Read, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at a place; None if its length does not fit."""
    head = read(at, 6)
    if at + 2 > end or len(head) < 2:
        return None
    tag, n, at = head[0], head[1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or len(head) < 2 + width or head[2] == 0:
            return None
        n, at = int.from_bytes(head[2 : 2 + width], "big"), at + width
    return (tag, at, at + n) if at + n <= end else None


def _elements(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch, if they do."""
    out = []
    while at < end:
        item = _element(read, at, end)
        if not item or len(out) == _PARTS:
            return None
        out.append(item)
        at = item[2]
    return out


def _der_key(read: Read, size: int) -> int | None:
    """Bytes of the DER key that the data begin with: a SEQUENCE whose elements' lengths nest and fit, with a key's parts.

    These are the integers of a key (of an RSA public key, a long one and another), or an algorithm with a string that
    holds the key, or a version and the string of a curve's key. A string that begins like a SEQUENCE is parsed too.
    """
    top = _element(read, 0, size)
    items = _elements(read, top[1], top[2]) if top and top[0] == 0x30 else None
    if not items:
        return None
    for tag, lo, hi in items:
        if tag == 0x30 and _elements(read, lo, hi) is None:
            return None
        lo += tag == 0x03
        if tag in (0x03, 0x04) and read(lo, 1) == b"\x30" and ((inner := _element(read, lo, hi)) is None or inner[2] != hi or _elements(read, inner[1], hi) is None):
            return None
    tags = [tag for tag, *_ in items]
    if set(tags) == {0x02}:
        good = len(tags) > 4 or len(tags) == 2 and items[0][2] - items[0][1] >= 48
    else:
        good = 0x30 in tags and bool({0x03, 0x04} & set(tags)) or tags[:2] == [0x02, 0x04]
    return top[2] if good else None


def _ssh_key(read: Read, size: int) -> bool:
    """The private-key magic, or length-prefixed fields that begin with a key type and fill the data."""
    if read(0, len(_MAGIC)) == _MAGIC:
        n = int.from_bytes(read(len(_MAGIC), 4), "big")
        return len(_MAGIC) + 4 + n <= size and read(len(_MAGIC) + 4, min(n, 64)).isascii()
    at, fields = 0, 0
    while at + 4 <= size and fields < _PARTS:
        n = int.from_bytes(read(at, 4), "big")
        if at + 4 + n > size or not fields and not read(4, min(n, 8)).startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return False
        at, fields = at + 4 + n, fields + 1
    return at == size and fields >= 2


def _key_bytes(read: Read, size: int) -> tuple[str, int] | None:
    """Kind and length in bytes of the key that the data begin with."""
    if _ssh_key(read, size):
        return "ssh_key", size
    end = _der_key(read, size)
    return ("der_key", end) if end else None


def _headers(data: bytes) -> Iterator[int]:
    """Where, at bytes that a multiple of four characters precede, an object begins that ends with the data and names an algorithm.

    An object that ends with the data begins at the one brace that matches the last one. Braces are counted from the
    end, past strings, whose quotes are those behind an even number of backslashes; only that object is then parsed.
    """
    body = data.rstrip(b" \t\r\n")
    if not body.endswith(b"}"):
        return
    depth, quoted = 0, False
    for m in reversed([*_MARKS.finditer(body)]):
        at, mark = m.start(), m[0]
        if mark.endswith(b'"'):
            quoted ^= len(mark) % 2 == 1
        elif not quoted:
            depth += 1 if mark in b"}]" else -1
            if not depth:
                break
    else:
        return
    if at % 3 == 0 and _OBJECT.match(body, at):
        try:
            head = json.loads(body[at:].decode("latin-1"))
            if isinstance(head.get("alg"), str) and data[at:].decode():
                yield at
        except (ValueError, RecursionError):
            pass


_OBJECT = re.compile(rb"\{\s*\"")
#: A quote with the backslashes before it, or a bracket.
_MARKS = re.compile(rb'\\*"|[{}\[\]]')


def _tokens(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Signed tokens: a header may begin wherever a JSON object can, behind other words and dots too."""
    out, done = [], lo
    for seg in _SEGMENT.finditer(text, lo, hi):
        start, end = seg.span()
        if start < done or not (tail := _TAIL.match(text, end, hi)):
            continue
        found = [start + shift + at // 3 * 4 for shift in range(4) for at in _headers(_b64(text[start + shift : end]) or b"")]
        if found:
            out.append((min(found), tail.end(), "jwt"))
            done = tail.end()
    return out


def _keys(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Keys inside a run of base64, at their known openings; a DER key ends where its length says."""
    out, done = [], lo
    end = hi - (hi - lo - len(text[lo:hi].rstrip("=")))
    for m in _OPENING.finditer(text, lo, end):
        at = m.start()
        if at >= done and (key := _key_bytes(*_in_base64(text, at, end))):
            done = at + -(-key[1] * 4 // 3)
            done = hi if done == end else done
            out.append((at, done, key[0]))
    return out


def _hex_keys(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Keys inside a run of hex digits."""
    out, done = [], lo
    for m in _HEX_OPENING.finditer(text, lo, hi):
        at = m.start()
        if at >= done and (key := _key_bytes(*_in_hex(text, at, hi))):
            done = at + 2 * key[1]
            out.append((at, done, key[0]))
    return out


def _is_pem_key(headers: str, body: str) -> bool:
    """The body is a key; or, encrypted as its headers say, whole cipher blocks."""
    data = _b64("".join(re.sub(r"\\[rn]", " ", body).split()))
    if _ENCRYPTED.match(headers):
        return bool(data) and len(data) % 8 == 0
    key = _key_bytes(lambda i, n: data[i : i + n], len(data)) if data else None
    return bool(key) and key[1] == len(data)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, in code points; by start, then kind in the order of KINDS, then end."""
    out = []
    low = text.lower()
    if any(s in low for s in _STARTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    for run in _LONG.finditer(text):
        lo, hi = run.span()
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text, lo, hi) if m.end() - m.start() >= 20]
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, lo, hi) if m.end() - m.start() >= 24]
        for m in _HEX_ANY.finditer(text, lo, hi):
            out += _hex_keys(text, *m.span())
        out += _tokens(text, lo, hi)
        for m in _B64.finditer(text, lo, hi):
            out += _keys(text, *m.span())
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem_key") for m in _PEM.finditer(text) if _is_pem_key(m[2], m[3])]
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed) for every document.

    Base patterns find assignments, access key ids and long hex runs. Structural confirmation then decodes base64 and
    hex candidates and reports those that parse: DER sequences with nested lengths, ssh keys with length-prefixed
    fields, PEM blocks whose body is one of these, and signed tokens whose header is JSON that names an algorithm. It
    only adds spans. A null text is empty and has none; every row is judged alone, so copies, ties and a null doc_id are no
    special case. The time goes with a text's length, whatever it holds: candidates are parsed where they are looked at. An
    empty table gives an empty result. Further columns are ignored, whatever their names.
    """

    def rows(cols: dict[str, list]) -> dict[str, object]:
        spans = [scan(t) for t in cols["text"]]
        base = [[s for s in x if s[2] in BASE] for x in spans]
        return {
            "doc_id": cols["doc_id"],
            **{f"n_{k}": [sum(s[2] == k for s in x) for x in base] for k in BASE},
            "base_sha256": [hashlib.sha256(_join(x).encode()).hexdigest() for x in base],
            "spans": [_join(x) for x in spans],
            "n_confirmed": [len(x) - len(y) for x, y in zip(spans, base, strict=True)],
        }

    return map_arrow(docs_of(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", rows)
