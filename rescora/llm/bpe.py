"""Byte-level BPE over documents: exact token ids by backtracking from longest matches, and back to bytes.

Each match of the split pattern is encoded by itself. A match that is a token is that token. Others are matched, one
Latin-1 character for each byte, by an Aho-Corasick automaton of all tokens, which gives the longest token from each
position. From the left the longest token is taken that the one before it is compatible with; where none is, the one
before is given up for its next shorter prefix, and its end is marked so that no path comes to it again.

Two tokens are compatible if the merges of their joined bytes give just these two again. A sequence whose neighbours
are all compatible is what the merges give: the first merge over a border of the sequence would take place between its
two tokens alone as well, since nothing before it came from outside. So each prefix has one such sequence, a position
that was given up is so for good, and the work is linear in the text. Compatibility is remembered for pairs of ids.
Tokens that merges don't arrive at from their own bytes are left out of the automaton.

The vocabulary is a file of ranks (base64 of a token's bytes and its rank, which is its id, in each line) with all
single bytes, read by the driver; a broadcast of its size, one rank for each token, carries it to the workers.

Nulls and ties: a null or empty text has no ids; equal texts have equal ids; repeated rows are encoded each. Texts are
encoded whole, in memory of some times their size. Strings of special tokens are ordinary text. Extra columns are kept;
one named like the result is replaced. An empty table gives an empty table. Null ids decode to no bytes; an id without
a token, or bytes that are no whole ids, raise.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches
from .common import open_fs

#: Pieces, and pairs of tokens, that a worker remembers at most, and then anew; longer pieces aren't remembered.
REMEMBERED, LONGEST_PIECE = 1 << 19, 64
#: Longer texts are split piece by piece, not into a list.
LONG_TEXT = 1 << 22
ID_BYTES = 4


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and their ranks from the lines of a rank file."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines.splitlines()))}
    if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be distinct, with one for each single byte")
    return ranks


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the leftmost neighbours whose joined bytes have the lowest rank, until none have any."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [(rank, i) for i, (a, b) in enumerate(pairwise(parts)) if (rank := ranks.get(a + b)) is not None]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Encoder(dict):
    """Ids of pieces of text, as bytes, by piece."""

    def __init__(self, lines: bytes, pattern: str):
        import ahocorasick
        import regex

        super().__init__()
        self.ranks = read_ranks(lines)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.match = regex.Match.group
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if merged(token, self.ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefix: dict[int, int | None] = {}

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        left, right = self.token[a], self.token[b]
        fits = self.pairs[a, b] = merged(left + right, self.ranks) == [left, right]
        return fits

    def shorter(self, k: int) -> int | None:
        """The longest shorter token in the automaton that begins this one."""
        if k not in self.prefix:
            name = self.token[k].decode("latin-1")
            starts = (name[:n] for n in range(len(name) - 1, 0, -1))
            self.prefix[k] = next((self.automaton.get(s) for s in starts if s in self.automaton), None)
        return self.prefix[k]

    def ids(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (own := self.ranks.get(data)) is not None:
            return [own]
        n, size, pairs = len(data), self.size, self.pairs
        longest: list[int | None] = [None] * (n + 1)
        for end, k in self.automaton.iter(data.decode("latin-1")):
            longest[end - size[k] + 1] = k  # ends rise, so the last is the longest
        given_up = bytearray(n + 1)
        out: list[int] = []
        at, last, k = 0, None, longest[0]
        while at < n:
            while k is not None:
                if not given_up[at + size[k]]:
                    if last is None:
                        break
                    if (fits := pairs.get((last, k))) is None:
                        fits = self.compatible(last, k)
                    if fits:
                        break
                k = self.shorter(k)
            if k is None:
                given_up[at] = 1
                at, k = at - size[last], self.shorter(out.pop())
                last = out[-1] if out else None
            else:
                out.append(k)
                at, last = at + size[k], k
                k = longest[at]
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_TEXT or self.pattern.groups:
            pieces = map(self.match, self.pattern.finditer(text))
        else:
            pieces = self.pattern.findall(text)
        return b"".join(map(self.__getitem__, pieces))


class Decoder:
    """Bytes of ids."""

    def __init__(self, lines: bytes):
        self.token = {rank: token for token, rank in read_ranks(lines).items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, f"<u{ID_BYTES}").tolist()))


_made: dict[tuple, Encoder | Decoder] = {}


def _once(make, digest: str, *of):
    """This worker's encoder or decoder."""
    key = (make, digest, *of[1:])
    if key not in _made:
        _made[key] = make(*of)
    return _made[key]


def _lines(spark: SparkSession, vocabulary: str):
    """The rank file as a broadcast, and its digest."""
    store, path = open_fs(vocabulary)
    with store.open_input_stream(path) as f:
        lines = f.read()
    return spark.sparkContext.broadcast(lines), hashlib.sha256(lines).hexdigest()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the ids of a text column, as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    held, digest = _lines(docs.sparkSession, vocabulary)

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        encoder = _once(Encoder, digest, held.value, pattern)
        return pa.array([encoder.encode(t) if t else b"" for t in column.to_pylist()], pa.binary())

    # else the optimiser evaluates it anew inside each Python function that reads it
    return docs.withColumn(out, ids.asNondeterministic()(F.col(text)))


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that a column of ids stands for."""
    bounded_batches(rows.sparkSession)
    held, digest = _lines(rows.sparkSession, vocabulary)

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        decoder = _once(Decoder, digest, held.value)
        return pa.array([decoder.decode(x) if x else b"" for x in column.to_pylist()], pa.binary())

    return rows.withColumn(out, decoded(F.col(ids)))


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / ID_BYTES).cast("long")


def as_array(ids: Column) -> Column:
    """The ids as an array of long."""
    big_endian = F.transform(F.sequence(F.lit(1), F.lit(ID_BYTES)), lambda k: k)

    def number(i: Column) -> Column:
        digits = F.transform(big_endian, lambda k: F.hex(F.substring(ids, (i + 1) * ID_BYTES + 1 - k, F.lit(1))))
        return F.conv(F.array_join(digits, ""), 16, 10).cast("long")

    n = n_ids(ids).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), number)).otherwise(F.array().cast("array<bigint>"))
