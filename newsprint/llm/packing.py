"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprint.llm.common import docs_of, map_arrow, scratch, written

TOKENIZER = "word_bpe_49k.json"

#: What the tokenizer takes for white space (not U+001C to U+001F, which are tokens).
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: ASCII and the Latin letters of U+00C0 to U+00FF, of which every one is a character of its own in normal form.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: How the tokenizer splits lower-cased plain text.
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


class _Recent(dict):
    """A table of bounded size that forgets what was not asked for lately: two generations of `most` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def make_room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """Token ids of whole texts, from the ids of the pieces that the tokenizer splits them into.

    Plain text is lower-cased and split here, and the tokenizer's model gives the ids of each new piece; a table of bounded
    size holds those met before. The tokenizer drops white space and never joins what it separates, so of other text the
    chunks between white space are encoded whole, and are pieces like any other (a chunk that is not plain, or holds the
    beginning of a special string, is never a plain piece).
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        in_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: in_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.known = _Recent(most)

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _PIECE.findall(text.lower())
        chunks = _SPACES.split(text)
        if len(chunks) == 1:
            return [text]
        out: list[str] = []
        for c in chunks:
            if c:
                out += self.pieces(c)
        return out

    def learn(self, piece: str) -> bytes:
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            return np.array(self.ids_of(piece), "<u4").tobytes()
        part = piece if piece.isascii() else piece.translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        get = self.known.__getitem__
        out = []
        for at in range(0, len(texts), 256):
            split = [self.pieces(t) for t in texts[at : at + 256]]
            fresh = [p for p in set().union(*split).difference(self.known) if get(p) is None]
            self.known.make_room(len(fresh))
            # What was moved to the older generation just now is asked for again.
            self.known.update((p, self.learn(p)) for p in fresh)
            out += [b"".join(map(get, pieces)) for pieces in split]
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int, waste: float = 0.02) -> list[int]:
    """Piece lengths of a document of n tokens: whole sequences first, then pieces that nearly fill a harmonic slot.

    A rest of r tokens is of class k = capacity // r; k of its class fill a sequence. If that would leave more than
    `waste` of it empty, a piece of exactly capacity // (k + 1) tokens, which fills the next class, is cut off.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, k): the pieces of every document, k the harmonic class."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k")}
        for doc, ids in zip(cols["doc_id"], encoder(tokenizer_path).encode(cols["text"]), strict=True):
            ids += end_id.to_bytes(4, "little")
            start = 0
            for length in cuts(len(ids) // 4, capacity):
                part = ids[4 * start : 4 * (start + length)]
                for c, v in zip(out, (doc, start, length, zlib.crc32(part), len(ids) // 4, capacity // length), strict=True):
                    out[c].append(v)
                start += length
        return out

    return map_arrow(docs_of(docs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int", rows, most=2 << 20)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 2, workers: int | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset, so that every sequence has at most `capacity` tokens.

    Harmonic packing: class k holds pieces of capacity // (k + 1) < length <= capacity // k, and k of them fill a sequence.
    Every class is dealt into `workers` parts, which number their pieces independently; only the counts of the parts are
    added up, so that a class leaves one open sequence in all. The pieces of the open sequences (under k a class, so
    fewer than capacity * ln(capacity) in all, whatever the input) are put first-fit, longest first, into shared
    sequences. Documents are cut, never shortened.

    A null text is empty: its one token is the end. Rows that repeat a document give its pieces again. An empty table
    gives an empty result; further columns are ignored. Ids of the tokenizer's own special strings are its usual ones.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    workers = workers or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch(docs.sparkSession):
        found = written(pieces(docs, tokenizer_path, capacity, end_id))
        part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(workers)).cast("int")
        dealt = found.withColumn("part", part)
        counts = dealt.groupBy("k", "part").agg(F.count(F.lit(1)).alias("c"))
        earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.withColumns({"base": F.coalesce(F.sum("c").over(earlier), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("k"))})
        mine = Window.partitionBy("k", "part").orderBy("doc_id", "start", "ids_crc32")
        ranked = dealt.withColumn("rank", F.row_number().over(mine) - 1).join(base.drop("c"), ["k", "part"])
        ranked = written(ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part"), keep=True)
    whole = F.floor(F.col("n") / F.col("k"))
    classes = ranked.groupBy("k").agg(F.floor(F.max("n") / F.col("k")).alias("bins"))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    first = classes.select("k", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first"))
    full = ranked.filter(F.col("rank") < whole * F.col("k")).join(F.broadcast(first), "k")
    full = full.withColumn("sequence_id", F.col("first") + F.floor(F.col("rank") / F.col("k")))
    seat = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(seat), F.lit(0)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    closed = full.select(*columns)
    open_ = ranked.filter(F.col("rank") >= whole * F.col("k")).crossJoin(F.broadcast(classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("first"))))
    rest = open_.groupBy("first").applyInPandas(_first_fit(capacity), StructType([*open_.schema.fields]).add("sequence_id", "long").add("offset", "long"))
    return closed.unionByName(rest.select(*columns))


def _first_fit(capacity: int):
    """Pieces, longest first, each into the first sequence with room."""

    def run(pieces):
        pieces = pieces.sort_values(["length", "k", "rank"], ascending=[False, True, True])
        used = np.zeros(0, np.int64)
        bins, offsets = [], []
        for length in pieces["length"]:
            room = np.flatnonzero(used + length <= capacity)
            at = int(room[0]) if len(room) else len(used)
            used = used if len(room) else np.append(used, 0)
            bins.append(at)
            offsets.append(int(used[at]))
            used[at] += length
        return pieces.assign(sequence_id=pieces["first"] + bins, offset=offsets)

    return run
