"""Token ids as binary files: each document compressed by itself with one trained zstandard dictionary.

File format, a file for each range of doc_id, named in ascending order:

    b"ZIDS1" | dictionary hash, 32 bytes (SHA-256) | frame, frame, ... | index | index bytes, 8 | b"ZIDX"

A frame is a zstandard frame of the document's ids as little-endian unsigned integers of WIDTH bytes. The index is an
Arrow stream with doc_id, start (ids before the document in this file), n_tokens, offset and length of its frame, so
one short document costs two small reads. The dictionary lies beside the files, and manifest.json lists them.

The dictionary is trained on SAMPLE_DOCS documents at most, the first by md5 of doc_id, SAMPLE_TOKENS ids of each, from
a place in the text that depends on doc_id; what is written never depends on it but in size. The vocabulary file is a
parameter.

A null text counts as empty: it has the end id only. Documents with one doc_id are in order of their ids' checksum;
those without doc_id come first. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import range_bounds, range_bucket
from ..session import bounded_batches, scratch, shuffle_partitions
from .common import open_fs, write_atomically

MAGIC, TAIL = b"ZIDS1", b"ZIDX"
WIDTH = 2
SAMPLE_DOCS, SAMPLE_TOKENS, DICT_BYTES, LEVEL = 512, 4096, 64 << 10, 3
#: Chunks whose ids a worker remembers at most, and then anew.
REMEMBERED = 1_000_000
#: A byte-level vocabulary splits text before each single space or line break between other characters, and merges
#: only within what it has split. Texts that have white space in any other place, or marks of special tokens, are
#: encoded whole.
ODD = ["  ", "\n\n", " \n", "\n ", "<|", "\0", *map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 0x1680, *range(0x2000, 0x200C)])]
ODD += map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])
MARK = "\0"


def splits_at_white_space(vocabulary: str) -> bool:
    """Whether the vocabulary file is byte-level with its usual split, no normaliser and no marks of white space.

    Texts of any other are encoded whole.
    """
    store, path = open_fs(vocabulary)
    with store.open_input_stream(path) as f:
        said = json.loads(f.read())
    split = said.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    marks = all(a.get("special") and not a.get("normalized") and "<|" in a.get("content", "") for a in said.get("added_tokens") or [])
    model = said.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(usual and marks and plain and not said.get("normalizer"))


class Encoder:
    """Ids of texts, as bytes; remembers the ids of chunks (a line break or space with the word after it)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = self.tokenizer.get_vocab()
        if max(words.values()) >= 1 << (8 * WIDTH):
            raise ValueError(f"ids of {vocabulary} need more than {WIDTH} bytes")
        #: Bytes that each id stands for: one for each character of its name.
        self.length = np.zeros(max(words.values()) + 1, np.int64)
        self.in_chunks = splits_at_white_space(vocabulary)
        for word, k in words.items():
            self.length[k] = len(word)
        self._renew()

    def _renew(self) -> None:
        self.code = defaultdict(count().__next__)
        self.code[""]
        self.arrays = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, f"<u{WIDTH}"))

    def _encode(self, texts_: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{WIDTH}") for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all codes after another, and how many each has."""
        start, size, flat = self.arrays
        n = size[codes]
        return flat[np.repeat(start[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def _learn(self, known: int) -> None:
        """Ids of the chunks with codes from `known` on.

        Punctuation after a letter is split from it, so a chunk that ends in such has the ids of the rest, then its own
        (its key has MARK before it). The others are encoded together, and cut where each chunk's bytes end.
        """
        new = list(islice(reversed(self.code), len(self.code) - known))[::-1]
        ended, halves, code = [], [], self.code
        for k, c in enumerate(new, known):
            if not c[-1].isalpha():
                rest = c.rstrip(string.punctuation)
                if len(rest) < len(c) and rest and rest[-1].isalpha():
                    ended.append(k)
                    halves += (code[rest], code[MARK + c[len(rest) :]])
        new += list(islice(reversed(code), len(code) - known - len(new)))[::-1]
        tails = [k for k, c in enumerate(new, known) if c[0] == MARK]
        plain = np.setdiff1d(np.arange(known, len(code)), np.array(ended + tails, np.int64), assume_unique=True)
        start, size, flat = self.arrays
        start, size = (np.concatenate([x, np.zeros(len(code) - known, np.int64)]) for x in (start, size))
        chunks = [new[k - known] for k in plain.tolist()]
        ids = self._encode(["".join([c if c[0] == "\n" else " " + c for c in chunks])])[0]
        ends = np.cumsum([(len(c) if c.isascii() else len(c.encode())) + (c[0] != "\n") for c in chunks])
        cut = np.concatenate([[0], np.searchsorted(np.cumsum(self.length[ids]), ends) + 1]).astype(np.int64)
        start[plain], size[plain] = cut[:-1] + len(flat), np.diff(cut)
        flat = np.concatenate([flat, ids])
        own = self._encode([new[k - known][1:] for k in tails])
        for k, x in zip(tails, own, strict=True):
            start[k], size[k] = len(flat), len(x)
            flat = np.concatenate([flat, x])
        self.arrays = start, size, flat
        if ended:
            ids, n = self._ids(np.array(halves, np.int64))
            n = n.reshape(-1, 2).sum(1)
            start[ended], size[ended] = np.cumsum(n) - n + len(flat), n
            self.arrays = start, size, np.concatenate([flat, ids])

    def __call__(self, texts_: list[str]) -> Iterator[bytes]:
        odd = [not self.in_chunks or not t or t[0].isspace() or t[-1].isspace() or any(x in t for x in ODD) for t in texts_]
        whole = iter(self._encode([t for t, o in zip(texts_, odd, strict=True) if o]))
        # each text after a line break of its own, whose id is dropped again
        parts = [("\n" + t).replace("\n", " \n").split(" ") for t, o in zip(texts_, odd, strict=True) if not o]
        if len(self.code) > REMEMBERED:
            self._renew()
        known = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(parts)), np.int64)
        if len(self.code) > known:
            self._learn(known)
        ids, n = self._ids(codes)
        ends = iter(np.cumsum(n)[np.cumsum([len(p) for p in parts], dtype=np.int64) - 1].tolist() if parts else ())
        at = 0
        for o in odd:
            if o:
                yield next(whole).tobytes()
            else:
                z = next(ends)
                yield ids[at + 1 : z].tobytes()
                at = z


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _ids(vocabulary: str, end_id: int, column: pa.Array) -> Iterator[bytes]:
    end = int(end_id).to_bytes(WIDTH, "little")
    rows = column.to_pylist()
    for k in range(0, len(rows), 2048):
        for ids in encoder(vocabulary)([t or "" for t in rows[k : k + 2048]]):
            yield ids + end


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """A dictionary trained on the ids of a bounded sample; without enough to train on, the sample's own ids."""

    def sample(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[: SAMPLE_TOKENS * WIDTH] for x in _ids(vocabulary, end_id, b.column("text"))], pa.binary())], names=["x"])

    # ids first: each task orders ids, not texts, and at most SAMPLE_DOCS of them are broadcast
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"))
    own = own.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(SAMPLE_DOCS).distinct()
    # a stretch from anywhere in the text
    start = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.greatest(F.char_length("text") - SAMPLE_TOKENS, F.lit(0)) + 1)
    stretch = F.substring("text", (start + 1).cast("int"), F.lit(16 * SAMPLE_TOKENS))
    few = docs.join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", stretch.alias("text"))
    # repeated rows of one id may be many: again no more than SAMPLE_DOCS, of what is small by now
    ids = few.mapInArrow(sample, "x binary").orderBy(F.md5("x")).limit(SAMPLE_DOCS)
    rows = [bytes(r["x"]) for r in ids.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[:DICT_BYTES] or b"\0" * 8


def _frames(vocabulary: str, end_id: int, dictionary: bytes):
    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        for b in batches:
            frames, n, crc = [], [], []
            for ids in _ids(vocabulary, end_id, b.column("text")):
                frames.append(press.compress(ids))
                n.append(len(ids) // WIDTH)
                crc.append(zlib.crc32(ids))
            columns = [b.column("_b"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "doc_id", "n", "crc", "frame"])

    return run


class _Writer:
    """One file, frame by frame; it gets its name once it is whole."""

    def __init__(self, uri: str, dict_hash: bytes):
        self.uri, self.attempt = uri, f"{uri}.{TaskContext.get().taskAttemptId()}.part"
        store, path = open_fs(self.attempt)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC + dict_hash)
        self.at, self.start, self.rows = len(MAGIC) + len(dict_hash), 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.column("n").to_numpy()
        frames = batch.column("frame").to_pylist()
        length = np.fromiter(map(len, frames), np.int64, len(frames))
        self.out.write(b"".join(frames))
        starts, offsets = np.cumsum(n) - n + self.start, np.cumsum(length) - length + self.at
        self.rows.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(n), pa.array(offsets), pa.array(length)], names=["doc_id", "start", "n_tokens", "offset", "length"]))
        self.start, self.at = self.start + int(n.sum()), self.at + int(length.sum())

    def close(self) -> dict:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows[0].schema) as s:
            for r in self.rows:
                s.write_batch(r)
        index = sink.getvalue().to_pybytes()
        self.out.write(index + len(index).to_bytes(8, "little") + TAIL)
        self.out.close()
        store, path = open_fs(self.uri)
        store.move(open_fs(self.attempt)[1], path)
        return {"docs": sum(map(len, self.rows)), "tokens": self.start}


def _write(folder: str, dict_hash: bytes):
    def run(batches):
        """Rows come sorted by bucket, then doc_id; each bucket is a file."""
        own, done, bucket = None, [], None
        for batch in batches:
            b = batch.column("b").to_numpy()
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            if not len(cuts) or cuts[0]:
                cuts = np.concatenate([[0], cuts])
            for a, z in zip(cuts, [*cuts[1:], len(b)], strict=True):
                if a == z:
                    continue
                if bucket != b[a]:
                    if own:
                        done.append((bucket, own.close()))
                    bucket = int(b[a])
                    own = _Writer(f"{folder}/ids-{bucket:06d}.zids", dict_hash)
                own.add(batch.slice(a, z - a))
        if own:
            done.append((bucket, own.close()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], pa.int64()), *[pa.array([x[c] for _, x in done], pa.int64()) for c in ("docs", "tokens")]],
            names=["file", "docs", "tokens"],
        )

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> dict:
    """Write the ids of all documents in ascending order of doc_id; returns the manifest, which lists the files."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dictionary = train_dictionary(docs, vocabulary, end_id)
    write_atomically(f"{folder}/dictionary", "driver", lambda out: out.write(dictionary))
    bounds = range_bounds(docs, "doc_id", 2 * shuffle_partitions(spark))
    frames = docs.withColumn("_b", range_bucket(F.col("doc_id"), bounds).cast("long")).mapInArrow(
        _frames(vocabulary, end_id, dictionary), "b long, doc_id long, n long, crc long, frame binary"
    )
    frames = frames.repartitionById(max(1, len(bounds)), F.col("b").cast("int")).sortWithinPartitions("b", F.col("doc_id").asc_nulls_first(), "crc")
    files = frames.mapInArrow(_write(folder, hashlib.sha256(dictionary).digest()), "file long, docs long, tokens long").collect()
    out, start = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "width": WIDTH, "files": []}, 0
    for r in sorted(files, key=lambda r: r["file"]):
        out["files"].append({"name": f"ids-{r['file']:06d}.zids", "start": start, "docs": r["docs"], "tokens": r["tokens"]})
        start += r["tokens"]
    write_atomically(f"{folder}/manifest.json", "driver", lambda f: f.write(json.dumps(out).encode()))
    return out


class IdFile:
    """A file of ids, read by document."""

    def __init__(self, folder: str, name: str):
        self.store, path = open_fs(f"{folder}/{name}")
        with self.store.open_input_stream(open_fs(f"{folder}/dictionary")[1]) as f:
            dictionary = f.read()
        self.file = self.store.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was not written with this dictionary")
        end = self.file.size()
        n = int.from_bytes(self.file.read_at(8, end - 12), "little")
        self.index = pa.ipc.open_stream(self.file.read_at(n, end - 12 - n)).read_all()
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def frames(self, offset: np.ndarray, length: np.ndarray) -> Iterator[bytes]:
        """Ids of consecutive documents, as bytes, by reads of a few MB."""
        at = 0
        while at < len(offset):
            z = max(at + 1, int(np.searchsorted(offset, offset[at] + (4 << 20))))
            block = self.file.read_at(int(offset[z - 1] + length[z - 1] - offset[at]), int(offset[at]))
            for k in range(at, z):
                o = int(offset[k] - offset[at])
                yield self.open.decompress(block[o : o + int(length[k])])
            at = z

    def ids(self, row: int) -> np.ndarray:
        """The ids of one document."""
        o, n = self.index["offset"][row].as_py(), self.index["length"][row].as_py()
        return np.frombuffer(self.open.decompress(self.file.read_at(n, o)), f"<u{WIDTH}")


def read_ids(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files that the manifest lists."""
    store, path = open_fs(f"{folder}/manifest.json")
    with store.open_input_stream(path) as f:
        files = json.loads(f.read())["files"]

    def run(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                f = IdFile(folder, name)
                for part in f.index.to_batches(max_chunksize=8192):
                    offset, length = part.column("offset").to_numpy(), part.column("length").to_numpy()
                    crc = [zlib.crc32(np.frombuffer(x, f"<u{WIDTH}").astype("<u4").tobytes()) for x in f.frames(offset, length)]
                    starts = part.column("start").to_numpy() + base
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts), part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(f["name"], f["start"]) for f in files]
    names = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), 4096)), "name")
    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_folder(spark) -> str:
    return scratch(spark, "token-ids")
