"""SimHash near-duplicates by an inverted index on the bytes of fingerprints.

A fingerprint bit is set if it is in over half of the text's shingle hashes. Equal fingerprints are one node.

Exact grouping, `components()`: 64 bits, links at 2 or fewer differing bits. Such a pair has at least 6 of 8 bytes
equal. The posting list of one position and byte would have a 256th of all nodes, so it is split by four more positions:
a list is named by five positions and their bytes. LISTS has so many choices of five positions that two nodes with 6 or
more equal bytes share a list with each of these bytes. Pairs of a list are tallied for their shared positional bytes
over all lists; those that reach the guaranteed 6 are kept, and verified by their bits. A list of over LIST nodes is
split by a further position, of which such a pair has one more equal in any case, and then by two of the four half
bytes left, of which it has two equal; lists have 256 nodes at most by then. Splitting loses no pair that is verified,
and pairs of split lists are tallied like all others.

Similarity grouping, `keep_one()`: documents are linked at an exact Jaccard similarity of 0.8 of their distinct five-word
shingles (48 bits of each hash). All shingles have one order; if two texts have that similarity, they share one of the
first fifth of theirs, so posting lists under these have every pair: none is lost, whatever the edit. Shingles that are
common in a sample come last in the order, which only keeps lists short. The index on the bytes of fingerprints proposes
first: texts whose fingerprints are linked as in `components()` are compared with the smallest of their group. Texts of a
list are compared with its smallest beside that, then all those that no link connects yet; long lists are compared in
pairs of blocks. The rows written are sets,
lists and spanning links; a list of many texts that are not alike costs its square.

Null and empty texts have no words: fingerprint 0, linked like any other. Rows of equal fingerprints are one group
however many; a null doc_id is never a component's id while another is there. Extra columns are kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.names import own_names
from ..session import bounded_batches, discard, materialise, shuffle_partitions
from .common import texts

SEED = 42
#: Longer posting lists are split further.
LIST = 256
MOST_BITS, LEAST_BYTES = 2, 6


def _five_of_eight() -> list[tuple[int, ...]]:
    """Choices of five byte positions: any two positions are both left out by at least two of them.

    Then of any six positions, each is in a choice of five among the six. Three positions at a time are left out, those
    first that leave most pairs out which are still to be.
    """
    left = dict.fromkeys(combinations(range(8), 2), 2)
    triples, out = list(combinations(range(8), 3)), []
    while any(left.values()):
        best = max(triples, key=lambda t: sum(left[x] > 0 for x in combinations(t, 2)))
        triples.remove(best)
        for x in combinations(best, 2):
            left[x] = max(0, left[x] - 1)
        out.append(tuple(p for p in range(8) if p not in best))
    return out


LISTS = _five_of_eight()

SHINGLE_WORDS = 5
#: Jaccard similarity of the distinct shingles from which documents are linked.
SIMILARITY = 0.8
#: Up to so many links are joined up in one task.
ONE_TASK = 1_000_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every shingle of k words, repeats included; of fewer words, of the whole sequence; none for none."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:z], SEED) for a, z in spans], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash; the hashes themselves for 0."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ (np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def simhash(rows: list[np.ndarray], words: int = 1) -> np.ndarray:
    """(documents, words) unsigned 64-bit: the majority of each bit over a document's hashes; 0 without hashes.

    Bits are counted in eight byte lanes of a 64-bit sum at a time, over at most 255 hashes, all documents together.
    """
    out = np.zeros((len(rows), words), np.uint64)
    size = np.array([len(r) for r in rows], np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    h, size = np.concatenate([rows[k] for k in some]), size[some]
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(size) - size, parts) + 255 * within
    for k in range(words):
        own = _mixed(h, k)
        bits = np.zeros((len(some), 64), bool)
        for b in range(8):
            lanes = np.add.reduceat((own >> np.uint64(b)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            bits[:, b::8] = 2 * np.add.reduceat(lanes.astype(np.int64), first, axis=0) > size[:, None]
        out[some, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, k: int = 3) -> DataFrame:
    """`docs` with fp: the 64-bit SimHash of the shingles of k words, as a signed number."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(simhash([shingle_hashes(t, k) for t in texts(text)])[:, 0].view(np.int64))

    return docs.withColumn("fp", fp(F.col("text")))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _mask(positions: Iterable[int], bits: int = 8) -> int:
    return _signed(sum(((1 << bits) - 1) << (bits * p) for p in positions))


def _finer(level: int) -> Column:
    """Masks that split a list's mask: by one more byte, then by two more half bytes."""
    more = [_mask((p,)) for p in range(8)] if level == 0 else [_mask(x, 4) for x in combinations(range(16), 2)]
    free = F.filter(F.array(*[F.lit(m) for m in more]), lambda m: m.bitwiseAND(F.col("mask")) == 0)
    return F.transform(free, lambda m: m.bitwiseOR(F.col("mask")))


def postings(nodes: DataFrame, most: int = LIST) -> DataFrame:
    """mask, key, fp: lists of two nodes or more, long ones split."""
    masks = F.array(*[F.lit(_mask(p)) for p in LISTS])
    posts, out = nodes.select("fp", F.explode(masks).alias("mask")), None
    for level in range(3):
        posts = posts.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        posts = posts.distinct() if level else posts
        shared = posts.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kept = materialise(posts.join(shared, ["mask", "key"]), "postings")
        done = kept if level == 2 else kept.where(F.col("n") <= most)
        out = done if out is None else out.unionByName(done)
        posts = kept.where(F.col("n") > most)
        if level == 2 or posts.isEmpty():
            return out.drop("n")
        posts = posts.select("fp", F.explode(_finer(level)).alias("mask"))


def links(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp with at most MOST_BITS differing bits: all such pairs."""
    posts = postings(nodes, LIST if most is None else most)
    a, b = posts.withColumnRenamed("fp", "a"), posts.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["mask", "key"]).where("a < b")
    # the positional bytes that a pair's lists have, each once
    tally = pairs.groupBy("a", "b").agg(F.bit_or("mask").alias("shared"))
    n = sum((F.when(F.col("shared").bitwiseAND(_mask((p,))) == _mask((p,)), 1).otherwise(0) for p in range(8)), F.lit(0))
    return tally.where((n >= LEAST_BYTES) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b")


def components(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of fingerprints."""
    rows = materialise(with_fingerprint(docs.select("doc_id", "text"), k).select("doc_id", "fp"), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = connected_components(links(nodes))
    own = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = own.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, rows.fp == named._fp).select("doc_id", "fp", "component_id")


#: Bytes of a shingle hash that sets are written and compared with.
HASH_BYTES = 6
#: Texts that the common shingles are counted in, the texts from which a shingle is common, and the most that are kept.
SAMPLE, COMMON_TEXTS, MOST_COMMON = 8192, 4, 1 << 16
#: Cells of a set's counts: a power of two near a quarter of its size, at least and at most so many.
LEAST_CELLS, MOST_CELLS = 32, 1 << 16
#: A verified group holds about so many texts and shingles.
GROUP, GROUP_SHINGLES = 256, 1 << 17
#: Added where a ratio of whole numbers meets `least`.
TINY = 1e-9


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, ascending, cut to HASH_BYTES."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS) >> np.uint64(64 - 8 * HASH_BYTES))


def packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8")[:, 0]


def shingle_sets(text: pa.Array) -> pa.Array:
    """The packed set of each text, sig, which names it, check, which shows if another has the same sig, and its counts in cells."""
    own = [shingle_set(t) for t in texts(text)]
    sets = [packed(h) for h in own]
    cells = [cell_counts(h).tobytes() for h in own]
    both = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(sets, pa.binary()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(cells, pa.binary())], names=["set", "sig", "check", "cells"]
    )


def cell_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes are in each of equal ranges, as bytes; all 255, which bounds nothing, if one has more."""
    bits = min(max(int(len(h) // 4).bit_length(), LEAST_CELLS.bit_length() - 1), MOST_CELLS.bit_length() - 1)
    n = np.bincount((h >> np.uint64(8 * HASH_BYTES - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(n, 255).astype(np.uint8) if n.max() <= 255 else np.full(1 << bits, 255, np.uint8)


def _folded(cells: np.ndarray, size: int) -> np.ndarray:
    return cells.reshape(size, -1).sum(1, dtype=np.uint16)


def may_be_alike(a: bytes, b: bytes, na: int, nb: int, least: float) -> bool:
    """False only for sets under `least`: what they share is at most the sum over cells of the lesser count."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    most = int(np.minimum(_folded(x, size), _folded(y, size)).sum())
    return most >= least * (na + nb - most) - TINY


def candidates(cells: list[bytes], n: np.ndarray, part: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets, by rising size, may be alike to one of another part."""
    rows = [np.frombuffer(c, np.uint8) for c in cells]
    length = np.array([len(r) for r in rows])
    out, at = np.zeros(len(n), bool), 0
    end = np.searchsorted(n * least - TINY, n, side="right")
    while at < len(n):
        # all sets of one length, and those that rows of it may be alike to, in its cells
        z = int(np.searchsorted(length, length[at], side="right"))
        m = np.stack([_folded(r, length[at]) for r in rows[at : int(end[z - 1])]])
        for i in range(at, z):
            j = slice(i + 1, int(end[i]))
            most = np.minimum(m[i - at], m[i + 1 - at : int(end[i]) - at]).sum(1, dtype=np.int64)
            near = (most >= least * (n[i] + n[j] - most) - TINY) & (part[j] != part[i])
            out[i] |= near.any()
            out[j] |= near
        at = z
    return out


def prefix_length(n: int, least: float) -> int:
    """Of n shingles in an order that all texts share, how many of the first two texts at `least` or more share one in."""
    return n - int(np.ceil(least * n - TINY)) + 1 if n else 0


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles: those that aren't common by hash, then the common ones by rank."""
    k = prefix_length(len(h), least)
    if not len(common):
        return h[:k]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    often = common[at] == h
    own = h[~often]
    if len(own) >= k:
        return own[:k]
    late = h[often]
    return np.concatenate([own, late[np.argsort(rank[at[often]], kind="stable")][: k - len(own)]])


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a bounded sample of texts have, ascending, and their ranks, the rarest first.

    Only the order of shingles depends on them, so that no posting list is long without need; any order loses no pair.
    """
    some = rows.select("sig").distinct().orderBy(F.xxhash64("sig")).limit(SAMPLE)
    sets = rows.join(F.broadcast(some), "sig").groupBy("sig").agg(F.first("set").alias("set"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        for b in batches:
            for x in b.column("set").to_pylist():
                yield (unpacked(x).view(np.int64),)

    counts = sets.select("set").mapInArrow(_batched(each, ["h"]), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= COMMON_TEXTS).orderBy(F.col("n").desc(), "h").limit(MOST_COMMON).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], (len(h) - np.arange(len(h)))[by]


def _posts(common: np.ndarray, rank: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n, sig) for each shingle of the prefix."""
        for b in batches:
            keys, n = [], []
            for x in b.column("set").to_pylist():
                h = unpacked(x)
                keys.append(prefix(h, common, rank, least).view(np.int64))
                n.append(len(h))
            if not keys:
                continue
            sizes = [len(k) for k in keys]
            key, n = np.concatenate(keys), np.repeat(np.array(n, np.int32), sizes)
            sig = np.repeat(b.column("sig").to_numpy(), sizes)
            for at in range(0, len(key), 1 << 16):
                z = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(n[z]), pa.array(sig[z])], names=["key", "n", "sig"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: str, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each whole run of equal values of `by` with two rows or more, from rows sorted by it."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in [by, *columns]]
        edge = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        if held and held[0][0][0] != now[0][0]:
            edge = np.concatenate([[0], edge])
        at = 0
        for z in (int(e) for e in edge):
            if held or z - at > 1:
                part = [*held, [c[at:z] for c in now]]
                whole = [np.concatenate(c) for c in zip(*part, strict=True)]
                if len(whole[0]) > 1:
                    yield whole[1:]
            held, at = [], z
        held.append([c[at:] for c in now])
    if held:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(whole[0]) > 1:
            yield whole[1:]


def _lists(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posting lists of two texts or more, cut where lengths are too far apart: list's name, sigs and sizes."""
        names, sigs, ns, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(ns, pa.binary())], names=["list", "sigs", "ns"]
            )

        for n, sig in _runs(batches, "key", ["n", "sig"]):
            # rows of equal texts lie side by side
            own = np.concatenate([[True], sig[1:] != sig[:-1]])
            n, sig = n[own], sig[own]
            if len(sig) < 2:
                continue
            cuts = [0, *(np.flatnonzero(n[1:] * least > n[:-1] + TINY) + 1).tolist(), len(n)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z - a > 1:
                    names.append(xxhash.xxh3_64_intdigest(sig[a:z].tobytes()))
                    sigs.append(sig[a:z].tobytes())
                    ns.append(n[a:z].tobytes())
                    size += z - a
            if size > 1 << 16:
                yield out()
                names, sigs, ns, size = [], [], [], 0
        yield out()

    return run


def _batched(run, names: list[str]):
    """Rows of many short arrays in batches."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for arrays in run(batches):
            held.append(arrays)
            size += len(arrays[0])
            if size >= 1 << 16:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                for at in range(0, size, 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in whole], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    return out


def _of_lists(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k, s, m in zip(*(b.column(c).to_pylist() for c in ("list", "sigs", "ns")), strict=True):
        yield k, np.frombuffer(s, np.int64), np.frombuffer(m, np.int32)


def _to_first(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(first, sig, n): each text of a list beside the list's smallest sig, where lengths allow."""
        for b in batches:
            for _, sig, n in _of_lists(b):
                k = int(np.argmin(sig))
                near = np.minimum(n, n[k]) >= np.maximum(n, n[k]) * least - TINY
                near[k] = False
                yield np.full(int(near.sum()), sig[k]), sig[near], n[near]

    return _batched(run, ["first", "sig", "n"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for k, sig, n in _of_lists(b):
            yield np.full(len(sig), k), sig, n


def _groups(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(g, sig, part): of each two blocks of a list, the texts that may be alike to one of another part."""
        for n, sig, part, cells in _runs(batches, "list", ["n", "sig", "part", "cells"]):
            if (part == part[0]).all():
                continue
            cell = np.maximum((np.cumsum(n, dtype=np.int64) - n) // GROUP_SHINGLES, 0)
            starts, at = [0], 0
            for k in range(1, len(n)):
                if k - at >= GROUP or cell[k] != cell[at]:
                    starts.append(k)
                    at = k
            blocks = [slice(a, z) for a, z in zip(starts, [*starts[1:], len(n)], strict=True)]
            for i, u in enumerate(blocks):
                # a block's own pairs are met beside its neighbour
                for v in blocks[i + 1 :] or ([u] if not i else []):
                    if n[v.start] * least > n[u.stop - 1] + TINY:
                        break
                    s, p, m, c = (x[u] if v is u else np.concatenate([x[u], x[v]]) for x in (sig, part, n, cells))
                    near = candidates(c, m, p, least) if (p != p[0]).any() else np.zeros(len(s), bool)
                    if near.any():
                        s, p = s[near], p[near]
                        yield np.full(len(s), np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64)), s, p

    return _batched(run, ["g", "sig", "part"])


def linked(sets: list[np.ndarray], part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links by exact Jaccard similarity that span a group's texts; texts in one part already aren't compared."""
    n = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(n) - n
    root = np.unique(part, return_inverse=True)[1].reshape(-1)
    hashes, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, mark, out = ids.reshape(-1), np.zeros(len(hashes), np.int32), []
    for i in range(len(sets) - 1):
        if (root == root[i]).all():
            break
        own = ids[starts[i] : starts[i] + n[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        near = shared >= least * (n[i] + n[i + 1 :] - shared) - TINY
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root[i] != root[j]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group ends where g changes."""
        g, sig, part, sets = None, [], [], []

        def links_of() -> list[tuple[int, int]]:
            found = linked(sets, np.array(part), least) if len(sig) > 1 else []
            return [(sig[i], sig[j]) for i, j in found]

        for b in batches:
            found = []
            for k, s, p, x in zip(*(b.column(c).to_pylist() for c in ("g", "sig", "part", "set")), strict=True):
                if k != g:
                    found += links_of()
                    g, sig, part, sets = k, [], [], []
                sig.append(s)
                part.append(p)
                sets.append(unpacked(x))
            yield _pairs(found)
        yield _pairs(links_of())

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _verified(groups: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among the texts (sig, part) of each group g; only the sets of these texts are moved."""
    groups = materialise(groups, "groups")
    some = materialise(groups.select("sig").distinct(), "group-texts")
    sets = rows.select("sig", "set").join(some, "sig", "left_semi").dropDuplicates(["sig"])
    out = groups.join(sets, "sig").repartition(shuffle_partitions(groups.sparkSession), "g").sortWithinPartitions("g", "sig")
    found = materialise(out.select("g", "sig", "part", "set").mapInArrow(_verify(least), "a long, b long").distinct(), "links")
    discard(groups, some)
    return found


def proposals(rows: DataFrame) -> DataFrame:
    """(first, sig): each text (sig, fp) beside the smallest sig of those that links of fingerprints connect it to."""
    nodes = materialise(rows.select("sig", "fp").distinct(), "fingerprints")
    found = connected_components(links(nodes.select("fp").distinct()), one_task=ONE_TASK)
    own = nodes.join(found, F.col("fp") == F.col("node"), "left").select("sig", F.coalesce("component", "fp").alias("g"))
    own = materialise(own.distinct(), "fingerprint-groups")
    first = own.groupBy("g").agg(F.min("sig").alias("first"))
    return own.join(first, "g").where("sig <> first").select("first", "sig")


def similar(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between sets (sig, set, cells, fp) of exact Jaccard similarity `least` or more; enough to connect all such.

    First each text is compared with the smallest that its fingerprint proposes and with that of its lists, then the lists whose texts aren't all connected by that
    are compared in full, but for pairs that are. Pairs that the counts in cells rule out aren't compared.
    """
    n = shuffle_partitions(rows.sparkSession)
    common, rank = common_shingles(rows)
    posts = rows.select("set", "sig").mapInArrow(_posts(common, rank, least), "key long, n int, sig long")
    lists = posts.repartition(n, "key").sortWithinPartitions("key", "n", "sig").mapInArrow(_lists(least), "list long, sigs binary, ns binary")
    lists = materialise(lists.dropDuplicates(["list"]), "lists")
    members = lists.mapInArrow(_batched(_members, ["list", "sig", "n"]), "list long, sig long, n int")
    cells = rows.select("sig", (F.octet_length("set") / HASH_BYTES).cast("int").alias("size"), "cells")
    cells = materialise(cells.join(members.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"]), "cells")

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        return pa.array([may_be_alike(*x, least) for x in zip(*(c.to_pylist() for c in (a, b, na, nb)), strict=True)], pa.bool_())

    pairs = lists.mapInArrow(_batched(_to_first(least), ["first", "sig", "n"]), "first long, sig long, n int").select("first", "sig")
    pairs = pairs.unionByName(proposals(rows)).distinct()
    first = cells.select(F.col("sig").alias("first"), F.col("size").alias("m"), F.col("cells").alias("others"))
    pairs = pairs.join(cells, "sig").join(first, "first").where(may("cells", "others", "size", "m")).select("first", "sig", F.col("size").alias("n"))
    pairs = materialise(pairs, "pairs")
    sizes = pairs.groupBy("first").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("parts"))
    dealt = pairs.join(sizes, "first").select("first", "sig", F.pmod(F.xxhash64("sig"), F.col("parts")).alias("k"))
    both = dealt.unionByName(dealt.select("first", F.col("first").alias("sig"), "k").distinct())
    near = _verified(both.select(F.xxhash64("first", "k").alias("g"), "sig", F.col("sig").alias("part")), rows, least)
    discard(pairs)

    found = connected_components(near, one_task=ONE_TASK).select(F.col("node").alias("sig"), "component")
    rest = members.join(found, "sig", "left").join(cells, "sig")
    rest = rest.select("list", "n", "sig", F.coalesce("component", "sig").alias("part"), "cells")
    rest = rest.repartition(n, "list").sortWithinPartitions("list", "n", "sig")
    rest = rest.mapInArrow(_batched(_groups(least), ["g", "sig", "part"]), "g long, sig long, part long").distinct()
    rest = _verified(rest, rows, least)
    discard(lists, cells)
    return near.unionByName(rest)


@own_names
def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all columns of `docs`.

    Where two sets have one sig, the one with the smaller check is compared with others, and the other one's documents
    are a group of their own: nothing unlike is dropped.
    """
    bounded_batches(docs.sparkSession)
    sets = F.arrow_udf(shingle_sets, "struct<set binary, sig long, check long, cells binary>")
    last = (1 << 63) - 1
    who = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    rows = with_fingerprint(docs.select("doc_id", "text")).select(who.alias("who"), "fp", sets(F.col("text")).alias("s"))
    rows = materialise(rows.select("who", "fp", "s.*"), "shingle-sets")
    nodes = materialise(rows.groupBy("sig", "check").agg(F.min("who").alias("who")), "nodes")
    clash = nodes.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("named")).where("n > 1").select(F.col("sig").alias("twice"), "named")
    nodes = nodes.join(clash, F.col("sig") == F.col("twice"), "left")
    links_found = similar(rows, least)
    # nothing beyond reads the shingle sets, the largest of the written tables
    discard(rows)
    found = connected_components(links_found, one_task=ONE_TASK)
    own = nodes.join(found, F.col("sig") == F.col("node"), "left")
    group = F.when(F.col("named").isNull() | (F.col("check") == F.col("named")), F.struct(F.coalesce("component", "sig").alias("g"), F.lit(0).cast("long").alias("c")))
    group = group.otherwise(F.struct(F.col("sig").alias("g"), F.col("check").alias("c")))
    kept = own.groupBy(group.alias("g")).agg(F.min("who").alias("who")).select("who.id", "who.text")
    kept = kept.select(F.col("id").alias("_kept_id"), F.col("text").alias("_kept_text"))
    marked = docs.withColumns({"_id": who["id"], "_text": who["text"]})
    out = marked.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_text") == F.col("_kept_text")))
    # of rows of one doc_id and text, the first by a hash of what else they have
    columns = [F.col(f"`{c}`") for c in docs.columns]
    other = F.xxhash64(F.to_json(F.struct(F.lit(0), *[c for c, n in zip(columns, docs.columns, strict=True) if n != "text"])))
    return out.groupBy("_id", "_text").agg(F.min_by(F.struct(*columns), other).alias("_row")).select("_row.*")
