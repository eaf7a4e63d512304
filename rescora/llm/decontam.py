"""Benchmark decontamination with a generalised suffix automaton.

Test items are lower-cased in A-Z and cut into words; an automaton over all items, joined by separators that no
document has, tracks for each training word the longest match that ends there. Where it reaches `window` words, or a
whole item of fewer, the matched words are hit. Hit spans are removed from the text; a document of which more than
`most_share` of the words are hit can be dropped by the caller, who gets the counts.

Automata hold about BLOCK_WORDS item words each, however large the benchmark; an item of more is cut into pieces that
share window - 1 words, so that each of its windows is in one. They are files in the shared folder, built side by side
by tasks. With each go the hashes of all its windows and whole short items. A gate is these hashes of many automata,
sorted, with the automaton of each: one search of a text's window hashes names the automata that the text is streamed
through, and no text that an item matches is kept out. A worker holds the HELD_GATES gates (of about GATE_WINDOWS hashes
each, 12 bytes a hash) and HELD_BLOCKS automata used last; a benchmark of more is gone through gate by gate for each batch
of texts.

Null or empty texts have no words. A null item_id hits like any other but isn't listed; items of one id are one item.
Items without words never match. Repeated documents are treated alike. Extra columns are kept; those named like a
result are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import own_names
from ..operators.ordering import in_order, running_sum
from ..session import bounded_batches, materialise, scratch
from .common import open_fs, texts, write_atomically

BLOCK_WORDS, HELD_BLOCKS = 100_000, 4
#: Window hashes of a gate, about, and the gates that a worker holds.
GATE_WINDOWS, HELD_GATES = 1 << 22, 2
WINDOW, MOST_SHARE = 10, 0.5
_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Each byte lower-cased, or a space where it isn't part of a word.
_FOLD = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPOTS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """Suffix automaton over item words. arcs: state * number of words + word -> state."""

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    shortest: int = 0
    span: int = 0
    arcs: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items with a window at a state, whole short items as (length, item) on its chain of suffixes.
    windows: dict[int, set] = field(default_factory=dict)
    short: dict[int, list] = field(default_factory=dict)

    @classmethod
    def build(cls, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        items = [(k, w) for k, w in items if w]
        out = cls(window)
        for _, words in items:
            for w in words:
                out.words.setdefault(w, len(out.words))
        coded = [(k, [out.words[w] for w in words]) for k, words in items]
        span = len(out.words) + len(items)
        last, out_edges = 0, [{}]
        for n, (_, ids) in enumerate(coded):
            for c in [*ids, len(out.words) + n]:
                last = out._extend(out_edges, last, c)
        out.arcs = {s * span + c: t for s, own in enumerate(out_edges) for c, t in own.items() if c < len(out.words)}
        out.span = span
        found = {a * len(out.words) + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        out.pairs = np.array(sorted(found), np.int64)
        out.shortest = min((min(len(ids), window) for _, ids in coded), default=window)
        whole: dict[int, list] = {}
        for key, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = out.arcs[state * span + c]
                if i + 1 >= window:
                    out.windows.setdefault(out.at(state, window), set()).add(key)
            if len(ids) < window:
                whole.setdefault(out.at(state, len(ids)), []).append((len(ids), key))
        if whole:
            for s in sorted(range(len(out.link)), key=out.length.__getitem__):
                chain = whole.get(s, []) + out.short.get(out.link[s], []) if s else []
                if chain:
                    out.short[s] = chain
        return out

    def _extend(self, edges: list[dict], last: int, c: int) -> int:
        new = self._state(self.length[last] + 1, edges, {})
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
            return new
        q = edges[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[p] + 1, edges, dict(edges[q]))
        self.link[copy] = self.link[q]
        while p != -1 and edges[p].get(c) == q:
            edges[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _state(self, length: int, edges: list[dict], own: dict) -> int:
        self.length.append(length)
        self.link.append(-1)
        edges.append(own)
        return len(self.length) - 1

    def at(self, state: int, n: int) -> int:
        """The state of the last n words of a match."""
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a match: all words known, all neighbouring pairs known."""
        if self.shortest < 2:
            good = ids >= 0
            extra, least = 0, 1
        else:
            codes = ids[:-1] * len(self.words) + ids[1:]
            good = (ids[:-1] >= 0) & (ids[1:] >= 0)
            some = np.flatnonzero(good)
            if len(some):
                spot = np.minimum(np.searchsorted(self.pairs, codes[some]), len(self.pairs) - 1)
                good[some] = self.pairs[spot] == codes[some]
            extra, least = 1, self.shortest - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z - a >= least:
                yield a, z + extra

    def match(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the hit words of a document and gather the items."""
        ids = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        if len(ids) < max(self.shortest, 1):
            return
        arcs, link, length, window = self.arcs, self.link, self.length, self.window
        for a, z in self.runs(ids):
            state, n = 0, 0
            for i, c in enumerate(ids[a:z].tolist(), a):
                while (to := arcs.get(state * self.span + c)) is None and state:
                    state = link[state]
                    n = length[state]
                state, n = (to, n + 1) if to is not None else (0, 0)
                if n >= window:
                    hit[i - window + 1 : i + 1] = True
                    items |= self.windows[self.at(state, window)]
                for m, key in self.short.get(state, ()):
                    if m <= n:
                        hit[i - m + 1 : i + 1] = True
                        items.add(key)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def own_windows(items: Iterable[list[bytes]], window: int) -> dict[int, np.ndarray]:
    """By number of words, the distinct hashes of the windows and whole short items."""
    found: dict[int, list[np.ndarray]] = {}
    for words in items:
        n = min(window, len(words))
        if n:
            found.setdefault(n, []).append(window_hashes(word_hashes(words), n))
    return {n: np.unique(np.concatenate(own)) for n, own in found.items()}


class Gate:
    """By number of words, the window hashes of several blocks in ascending order, and the block of each."""

    def __init__(self, blocks: dict[int, dict[int, np.ndarray]]):
        self.windows = {}
        for n in sorted({n for own in blocks.values() for n in own}):
            parts = [(k, own[n]) for k, own in blocks.items() if n in own]
            h = np.concatenate([x for _, x in parts])
            order = np.argsort(h, kind="stable")
            self.windows[n] = h[order], np.repeat(np.array([k for k, _ in parts], np.uint32), [len(x) for _, x in parts])[order]

    def named(self, h: np.ndarray) -> set[int]:
        """The blocks that have a window, or a whole short item, of the words with these hashes."""
        out: set[int] = set()
        for n, (known, block) in self.windows.items():
            own = window_hashes(h, n)
            at = np.searchsorted(known, own)
            own = own[known[np.minimum(at, len(known) - 1)] == own]
            if len(own):
                own = np.unique(own)
                for a, z in zip(np.searchsorted(known, own), np.searchsorted(known, own, "right"), strict=True):
                    out.update(block[a:z].tolist())
        return out


def _pieces(window: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, part, words, n): items in pieces of at most block_words words; neighbours share window - 1."""
        most = max(block_words, 2 * window)
        for b in batches:
            rows = []
            for k, t in zip(b.column("k").to_pylist(), texts(b.column("text")), strict=True):
                words = item_words(t)
                for part, at in enumerate(range(0, max(len(words) - window + 1, 1), most - window + 1)):
                    own = words[at : at + most]
                    if own:
                        rows.append((k, part, b" ".join(own), len(own)))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "part", "words", "n"])

    return run


def _build(folder: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a file for each."""
        block, own = None, []

        def write() -> pa.RecordBatch:
            attempt = str(TaskContext.get().taskAttemptId())
            windows = own_windows((w for _, w in own), window)
            for name, what in (("block", Automaton.build(own, window)), ("windows", windows)):
                data = pickle.dumps(what, 5)
                write_atomically(f"{folder}/{name}-{block:06d}", attempt, lambda out, data=data: out.write(data))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sum(map(len, windows.values()))], pa.int64())], names=["block", "n"])

        for b in batches:
            for k, words, at in zip(*(b.column(c).to_pylist() for c in ("k", "words", "block")), strict=True):
                if at != block:
                    if own:
                        yield write()
                    block, own = at, []
                own.append((k, words.split()))
        if own:
            yield write()

    return run


def build_blocks(
    benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS, gate_windows: int = GATE_WINDOWS
) -> tuple[str, list[list[int]]]:
    """Folder of the automata over (item_id, text), each of about block_words words, and their numbers by gate."""
    spark = benchmark.sparkSession
    folder = scratch(spark, "benchmark")
    rows = benchmark.select(F.col("item_id").cast("string").alias("k"), "text").where("text is not null")
    rows = materialise(rows.mapInArrow(_pieces(window, block_words), "k string, part int, words binary, n long"), "items")
    items, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-words // block_words))
    if blocks == 1:
        dealt = rows.withColumn("block", F.lit(0).cast("long")).coalesce(1)
    else:
        order = [F.col("k"), F.col("part"), F.col("words")]
        dealt = running_sum(in_order(rows, order, items), {"upto": F.col("n")}, [], "_b", order)
        dealt = dealt.withColumn("block", F.floor((F.col("upto") - 1) / block_words)).repartitionById(blocks, F.col("block").cast("int"))
        dealt = dealt.sortWithinPartitions("block")
    built = dealt.select("k", "words", "block").mapInArrow(_build(folder, window), "block long, n long").collect()
    gates, size = [], gate_windows
    for block, n in sorted((r["block"], r["n"]) for r in built):
        if size + n > gate_windows:
            gates.append([])
            size = 0
        gates[-1].append(block)
        size += n
    return folder, gates


def _load(folder: str, name: str, block: int):
    store, path = open_fs(f"{folder}/{name}-{block:06d}")
    with store.open_input_stream(path) as f:
        return pickle.loads(f.read())


class Held:
    """The gates and the automata that were used last."""

    def __init__(self, folder: str, gates: list[list[int]]):
        self.folder, self.of, self.loads = folder, gates, 0
        self.gates, self.automata = OrderedDict(), OrderedDict()

    @staticmethod
    def _kept(held: OrderedDict, key: int, load, most: int):
        if key not in held:
            while len(held) >= most:
                held.popitem(last=False)
            held[key] = load()
        held.move_to_end(key)
        return held[key]

    def gate(self, g: int) -> Gate:
        return self._kept(self.gates, g, lambda: Gate({k: _load(self.folder, "windows", k) for k in self.of[g]}), HELD_GATES)

    def get(self, block: int) -> Automaton:
        def load() -> Automaton:
            self.loads += 1
            return _load(self.folder, "block", block)

        return self._kept(self.automata, block, load, HELD_BLOCKS)

    def match(self, rows: list[bytes]) -> Iterator[tuple[bytes, int, int, list[str]]]:
        """Texts without their hit spans, number of words, of hit words, and items; block by block over all texts."""
        # a batch keeps 8 bytes a word; the words of texts that may match are cut out again for each automaton
        hashes = [word_hashes(item_words(t)) for t in rows]
        lengths, wanted = [len(h) for h in hashes], {}
        for g in sorted(range(len(self.of)), key=lambda g: g not in self.gates):
            gate = self.gate(g)
            for i, h in enumerate(hashes):
                for k in gate.named(h):
                    wanted.setdefault(k, []).append(i)
        del hashes
        found: dict[int, tuple[np.ndarray, set]] = {}
        for k in sorted(wanted, key=lambda k: k not in self.automata):
            own = self.get(k)
            for i in wanted[k]:
                own.match(item_words(rows[i]), *found.setdefault(i, (np.zeros(lengths[i], bool), set())))
        for i, t in enumerate(rows):
            hit, items = found.get(i, (None, set()))
            n = int(hit.sum()) if hit is not None else 0
            yield without(t, hit) if n else t, lengths[i], n, sorted(items - {None})


#: What this worker holds of a benchmark.
_held: Held | None = None


def _worker(folder: str, gates: list[list[int]]) -> Held:
    global _held
    if _held is None or _held.folder != folder:
        _held = Held(folder, gates)
    return _held


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit spans, from the first word of each to the last."""
    spots = [m.span() for m in _SPOTS.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : spots[a][0]])
        at = spots[z - 1][1]
    return b"".join([*out, text[at:]])


def _struct(rows: Iterable[tuple[bytes, int, int, list[str]]]) -> pa.StructArray:
    clean, n_words, n_hit, items = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(clean, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))],
        names=["text", "n_words", "n_hit", "items"],
    )


KIND = "struct<text string, n_words long, n_hit long, items array<string>>"


@own_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with hit spans removed from text, and n_words, n_hit, and items (sorted ids) of the text as it was."""
    bounded_batches(docs.sparkSession)
    folder, gates = build_blocks(benchmark, window, block_words)

    @F.arrow_udf(KIND)
    def cleaned(text: pa.Array) -> pa.Array:
        return _struct(_worker(folder, gates).match(list(texts(text))))

    out = docs.withColumn("_c", cleaned(F.col("text")))
    return out.withColumns({c: F.col(f"_c.{c}") for c in ("text", "n_words", "n_hit", "items")}).drop("_c")


def mostly_clean(cleaned: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """Documents of which at most most_share of the words were hit."""
    return cleaned.where(F.col("n_hit") <= most_share * F.col("n_words"))
