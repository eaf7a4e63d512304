"""Line dedup by sharded minimal perfect hashing.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Each document gives its distinct keys
as 128-bit hashes; their document counts are summed, and the hashes that reach the minimum go to shards by hash. A
shard is a minimal perfect hash (levels of bit arrays; a key takes the first level at which it is alone) over its line
hashes, with a 64-bit fingerprint and a count at each index: some 13 bytes a key. Documents probe those arrays: no lines
are joined. Keys are told apart by all 128 bits, so keys that share half of them are both in the index.

Shards are files in the shared folder, of about SHARD_KEYS keys each. Up to CACHE_BYTES of them, a worker holds all that
it probes, each read once. A larger index is probed shard by shard: line hashes are dealt to the shards, with the hash of
their text and the line's number, each shard is read by its own tasks only, and the numbers of common lines come back
to the texts. A shard has as many parts as its lines' counts ask for, so a line that every document has is probed by many
tasks; the lines of a text that a task met lately aren't given again. Copies of one text meet in the join with the numbers
of its common lines, a left join that adaptive execution splits where it is skewed. Both forms drop the same lines.

A null or empty text is one empty line; its key has no code points, so it stays where min_chars is 1. Repeated rows
count as documents of their own. Extra columns are kept; text is replaced, and so are n_lines and n_dropped.
"""

from __future__ import annotations

import io
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.names import own_names
from ..session import bounded_batches, materialise, scratch, shuffle_partitions
from .common import open_fs, texts, write_atomically

SHARD_KEYS, CACHE_BYTES = 1 << 18, 128 << 20
#: Bytes that a key takes in memory, about; line hashes of a part of a shard's probes, about.
KEY_BYTES, PART_LINES = 14, 1 << 20
#: Least parts of a shard; texts that a task remembers to have given the lines of.
LEAST_PARTS, MET_TEXTS = 8, 1 << 16
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(b" \t\n\x0b\x0c\r").lower() for line in text.split(b"\n")]


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit: where a key is found, and its fingerprint."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


def _mixed(h: np.ndarray, p: np.ndarray, level: int) -> np.ndarray:
    """Another hash of each key, of both its halves, for each level."""
    with np.errstate(over="ignore"):
        h = (h + np.uint64(level + 1) * np.uint64(_MIX[0])) * np.uint64(_MIX[1]) ^ p * np.uint64(_MIX[2])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
        return h ^ (h >> np.uint64(32))


class Level:
    """A bit array in words of 64, with the number of set bits before each word."""

    def __init__(self, size: int, words: np.ndarray, base: int):
        self.size, self.words = size, words
        ones = np.bitwise_count(words).astype(np.uint64)
        self.before = (np.cumsum(ones) - ones + np.uint64(base)).astype(np.uint32)
        self.end = base + int(ones.sum())

    @classmethod
    def of(cls, bits: np.ndarray, base: int) -> Level:
        padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        return cls(len(bits), np.packbits(padded, bitorder="little").view("<u8"), base)

    def find(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bit is set, and how many are before it."""
        word, bit = self.words[slot >> 6], (slot & 63).astype(np.uint64)
        rank = self.before[slot >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return (word >> bit & np.uint64(1)).astype(bool), rank


class PerfectHash:
    """Minimal perfect hash over distinct keys of two 64-bit halves; the second is kept as a fingerprint, beside a count."""

    def __init__(self, levels: list[Level], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectHash:
        left, levels = np.arange(len(keys)), []
        while len(left):
            size = len(left) + len(left) // 2 + 1
            slot = (_mixed(keys[left], prints[left], len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(slot, minlength=size) == 1
            levels.append(Level.of(bits, levels[-1].end if levels else 0))
            left = left[~bits[slot]]
        wide = np.uint64 if len(counts) and int(counts.max()) >> 32 else np.uint32
        out = cls(levels, np.zeros(len(keys), np.uint64), np.zeros(len(keys), wide))
        at = out.index(keys, prints)
        out.prints[at], out.counts[at] = prints, counts
        return out

    def index(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """0 to n - 1 for each of the n keys; -1 or any index for others."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            slot = (_mixed(keys[open_], prints[open_], k) % np.uint64(level.size)).astype(np.int64)
            hit, rank = level.find(slot)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Counts of the keys; 0 for those that the fingerprint shows to be others."""
        at = self.index(keys, prints)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64)
        return np.where((at >= 0) & (self.prints[at] == prints), self.counts[at], 0).astype(np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        words = {f"w{k}": v.words for k, v in enumerate(self.levels)}
        np.savez(out, sizes=np.array([v.size for v in self.levels], np.int64), prints=self.prints, counts=self.counts, **words)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        z, levels = np.load(io.BytesIO(data)), []
        for k, n in enumerate(z["sizes"]):
            levels.append(Level(int(n), z[f"w{k}"], levels[-1].end if levels else 0))
        return cls(levels, z["prints"], z["counts"])

    def nbytes(self) -> int:
        return self.prints.nbytes + self.counts.nbytes + sum(v.words.nbytes + v.before.nbytes for v in self.levels)


class Shards:
    """The shards of an index, loaded as they are probed; the least recently probed go first."""

    def __init__(self, folder: str, n: int, cache_bytes: int = CACHE_BYTES):
        self.folder, self.n, self.cache_bytes, self.held, self.loads = folder, n, cache_bytes, OrderedDict(), 0

    def _get(self, k: int) -> PerfectHash:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        store, path = open_fs(f"{self.folder}/{k:06d}.npz")
        self.loads += 1
        with store.open_input_stream(path) as f:
            self.held[k] = PerfectHash.load(f.read())
        while len(self.held) > 1 and sum(s.nbytes() for s in self.held.values()) > self.cache_bytes:
            self.held.popitem(last=False)
        return self.held[k]

    def count(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        of = shard_of(h[:, 0], self.n)
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(self.n + 1))
        for k in range(self.n):
            own = order[cut[k] : cut[k + 1]]
            if len(own):
                out[own] = self._get(k).count(h[own, 0], h[own, 1])
        return out


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def _distinct_keys(min_chars: int):
    def run(batches):
        for b in batches:
            rows = []
            for t in texts(b.column("text")):
                keys = {k for k in line_keys(t) if k or not min_chars}
                rows += [k for k in keys if min_chars <= 1 or len(k.decode()) >= min_chars]
            h = key_hashes(rows)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))], names=["h", "p"])

    return run


def _build(folder: str, n: int):
    def run(batches):
        """Rows come sorted by shard; each shard is built once it is whole."""
        shard, parts = None, []

        def done():
            h, p, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            data = PerfectHash.build(h.view(np.uint64), p.view(np.uint64), c).dump()
            attempt = str(TaskContext.get().taskAttemptId())
            write_atomically(f"{folder}/{shard:06d}.npz", attempt, lambda out: out.write(data))
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([int(c.sum())], pa.int64())], names=["shard", "lines"])

        for b in batches:
            s, h, p, c = (b.column(x).to_numpy() for x in ("shard", "h", "p", "n"))
            cuts = np.flatnonzero(np.diff(s, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(s)], strict=True):
                if s[a] != shard and parts:
                    yield done()
                    parts = []
                shard = int(s[a])
                parts.append((h[a:z].copy(), p[a:z].copy(), c[a:z].copy()))
        if parts:
            yield done()

    return run


def line_index(docs: DataFrame, min_docs: int, min_chars: int = 1, shard_keys: int = SHARD_KEYS) -> tuple[str, list[int], int]:
    """Folder, the sum of each shard's counts, and number of keys of the index over keys found in at least min_docs documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lines = docs.select("text").mapInArrow(_distinct_keys(min_chars), "h long, p long")
    counts = materialise(lines.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs), "lines")
    keys = counts.count()
    n = max(1, -(-keys // shard_keys))
    folder = scratch(spark, "line-index")
    rows = counts.withColumn("shard", _shard(n)).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "p")
    built = rows.mapInArrow(_build(folder, n), "shard long, lines long").collect()
    lines = dict(built)
    empty = PerfectHash.build(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))).dump()
    for k in set(range(n)) - set(lines):
        write_atomically(f"{folder}/{k:06d}.npz", "driver", lambda out: out.write(empty))
    return folder, [lines.get(k, 0) for k in range(n)], keys


def _shard(n: int) -> Column:
    """shard_of() of a column h; an unsigned remainder."""
    return F.pmod(F.pmod(F.shiftrightunsigned("h", 1), F.lit(n)) * 2 + F.col("h").bitwiseAND(1), F.lit(n)).cast("long")


def _cut(lines: list[list[bytes]], common: np.ndarray) -> pa.StructArray:
    """Texts without their common lines, which are marked for all lines one after another."""
    out, counts, dropped, at = [], [], [], 0
    for own in lines:
        gone = common[at : at + len(own)]
        at += len(own)
        counts.append(len(own))
        dropped.append(int(gone.sum()))
        out.append(b"\n".join([x for x, g in zip(own, gone, strict=True) if not g]))
    text = pa.array(out, pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([text, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])


KIND = "struct<text string, n_lines long, n_dropped long>"


def _probed_in_place(docs: DataFrame, folder: str, shard_lines: list[int], min_docs: int) -> DataFrame:
    """Append _c: each worker probes the whole index."""
    n = len(shard_lines)

    @F.arrow_udf(KIND)
    def cleaned(text: pa.Array) -> pa.Array:
        global _shards
        if _shards is None or _shards.folder != folder:
            _shards = Shards(folder, n)
        lines = [t.split(b"\n") for t in texts(text)]
        flat = [line.strip(b" \t\n\x0b\x0c\r").lower() for own in lines for line in own]
        return _cut(lines, _shards.count(key_hashes(flat)) >= min_docs)

    return docs.withColumn("_c", cleaned(F.col("text")))


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, i, h, p): the text's hash, the line's number and its key's hash; copies met lately are passed over."""
    met: OrderedDict[tuple[int, int], None] = OrderedDict()
    for b in batches:
        new = []
        for at, name in enumerate(zip(b.column("t").to_pylist(), b.column("u").to_pylist(), strict=True)):
            if name not in met:
                new.append(at)
                met[name] = None
            met.move_to_end(name)
            if len(met) > MET_TEXTS:
                met.popitem(last=False)
        b = b.take(pa.array(new, pa.int64()))
        own = [line_keys(t) for t in texts(b.column("text"))]
        sizes = [len(x) for x in own]
        h = key_hashes([k for x in own for k in x])
        t, u = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("t", "u"))
        i = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]) if sizes else np.zeros(0, np.int32)
        for at in range(0, len(i), 1 << 16):
            z = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[z]) for x in (t, u, i, h[:, 0].view(np.int64), h[:, 1].view(np.int64))], names=["t", "u", "i", "h", "p"])


def _probe(folder: str, n: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, so one shard is held at a time."""
        shards = Shards(folder, n, cache_bytes=0)
        for b in batches:
            h = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("h", "p")], 1)
            common = pa.array(shards.count(h) >= min_docs)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("t", "u", "i")], names=["t", "u", "i"]).filter(common)

    return run


def _parts(shard_lines: list[int]) -> list[int]:
    """Into how many parts the probes of each shard are dealt: common lines by their counts, others are spread evenly."""
    return [LEAST_PARTS + n // PART_LINES for n in shard_lines]


def _probed_by_shard(docs: DataFrame, folder: str, shard_lines: list[int], min_docs: int) -> DataFrame:
    """Append _c: the hashes of lines go to the shards."""
    n = len(shard_lines)
    parts = F.get(F.from_json(F.lit(json.dumps(_parts(shard_lines))), "array<int>"), F.col("shard").cast("int"))
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumns({"_t": F.xxhash64(text), "_u": F.xxhash64(F.lit("line"), text)})
    lines = named.select(F.col("_t").alias("t"), F.col("_u").alias("u"), "text").mapInArrow(_lines_of, "t long, u long, i int, h long, p long")
    # a hot line is in one shard, so each shard's probes are dealt by their texts as well
    lines = lines.withColumn("shard", _shard(n)).withColumn("part", F.pmod(F.xxhash64("t", "i"), parts))
    lines = lines.repartition(shuffle_partitions(docs.sparkSession), "shard", "part").sortWithinPartitions("shard", "part")
    found = lines.select("t", "u", "i", "h", "p").mapInArrow(_probe(folder, n, min_docs), "t long, u long, i int")
    # a text has its lines once, however many documents have it
    found = found.groupBy(F.col("t").alias("_t2"), F.col("u").alias("_u2")).agg(F.collect_set("i").alias("_gone"))
    found = materialise(found, "common-lines")

    @F.arrow_udf(KIND)
    def cleaned(text: pa.Array, gone: pa.Array) -> pa.Array:
        lines = [t.split(b"\n") for t in texts(text)]
        common = np.zeros(sum(map(len, lines)), bool)
        at = 0
        for own, k in zip(lines, gone.to_pylist(), strict=True):
            common[at + np.array(k or [], np.int64)] = True
            at += len(own)
        return _cut(lines, common)

    out = named.join(found, (F.col("_t") == F.col("_t2")) & (F.col("_u") == F.col("_u2")), "left")
    return out.withColumn("_c", cleaned(F.col("text"), F.col("_gone"))).drop("_t", "_u", "_t2", "_u2", "_gone")


@own_names
def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, held_bytes: int = CACHE_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """`docs` without the lines whose key is in at least min_docs documents; n_lines and n_dropped are appended.

    Keys of fewer than min_chars code points always stay. An index over held_bytes is probed shard by shard.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    folder, shard_lines, keys = line_index(docs, min_docs, min_chars, shard_keys)
    probed = _probed_in_place if keys * KEY_BYTES <= held_bytes else _probed_by_shard
    out = probed(docs.select(*[F.col(f"`{c}`") for c in columns]), folder, shard_lines, min_docs)
    return out.withColumns({c: F.col(f"_c.{c}") for c in ("text", "n_lines", "n_dropped")}).drop("_c")


#: The shards that this worker holds.
_shards: Shards | None = None
