"""Folds, caps and permutations: ranks by md5 of seed, purpose and key, alike in any partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import bounded_batches, discard, materialise
from .names import key_of, own_names
from .ordering import by_short_ids, running_sum, tasks_of

#: Turns of the network that shuffles ranks, and the prime that its products are reduced by.
FEISTEL_TURNS, PRIME = 6, 2**31 - 1
#: Hexadecimal digits of a draw that cut rows into cells.
CELL_DIGITS = 3
#: Bits of a place in a block of neighbouring ranks, and rows that a task deals out to such blocks at once.
PLACE_BITS, DEALT_ROWS = 16, 1 << 20


def drawn(seed: int, purpose: str, *key: Column) -> Column:
    """The draw of a key: its md5 in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key]))


def draw_rank(df: DataFrame, draw: Column, keys: Sequence[str] = (), tie: Sequence[str] = ("row_id",), out: str = "rank", size: str | None = None) -> DataFrame:
    """Append the rank of each row's draw within keys (without nulls), from 1, then by `tie`; and the keys' rows as `size`.

    Draws are cut into cells by their first digits, so no task has all rows: ranks in a cell, plus what is before it.
    Rows are dealt out by cell, about CELL_ROWS to a task; draws are worked out again there, so that none is shuffled.
    """
    df = df.withColumn("_cell", F.conv(F.substring(draw, 1, CELL_DIGITS), 16, 10).cast("int"))
    n = tasks_of(df, df.count())
    dealt = by_short_ids(df, lambda rows, _: rows.repartition(n, *keys, "_cell")).withColumn("_draw", draw)
    order = [F.col("_draw"), *[F.col(t) for t in tie]]
    return running_sum(df, {out: F.lit(1).cast("long")}, keys, "_cell", order, {size: out} if size else {}, dealt).drop("_draw", "_cell")


@own_names
def assign_folds(df: DataFrame, k: int = 3, seed: int = 1, out: str = "fold") -> DataFrame:
    """Folds 0 to k - 1 whose sizes differ by one at most."""
    rows = draw_rank(df, drawn(seed, "fold", F.col("row_id")), out="_r")
    return rows.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


@own_names
def assign_grouped_folds(df: DataFrame, keys: Sequence[str], k: int = 3, seed: int = 1, out: str = "fold") -> DataFrame:
    """Folds over the distinct keys; rows of one key are together."""
    groups = df.select(*keys).distinct()
    groups = draw_rank(groups, drawn(seed, "fold", *[F.col(c) for c in keys]), tie=keys, out="_r")
    named = groups.select(*[F.col(c).alias(f"_{c}") for c in keys], ((F.col("_r") - 1) % k).cast("int").alias(out))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return df.join(named, same).drop(*[f"_{c}" for c in keys])


def training_cap(df: DataFrame, cap: int, seed: int = 1) -> DataFrame:
    """At most cap / 2 rows of label +1, and the rest of the cap of label -1, drawn without replacement."""
    if cap < 2:
        raise ValueError("a cap below 2 leaves a class empty")
    half = cap // 2
    draw = [drawn(seed, "cap", F.col("row_id")), F.col("row_id")]
    pos = df.where("label > 0").orderBy(*draw).limit(half)
    neg = df.where("label <= 0").orderBy(*draw).limit(cap - min(half, df.where("label > 0").limit(half).count()))
    return pos.unionByName(neg)


def shuffled_rank(rank: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each rank of 0 to n - 1 another of them, one to one for each (n, key); keys are of 60 bits.

    A Feistel network permutes the whole numbers of an even number of bits that n fits in; a result that is not under n
    is put in again, until it is.
    """
    out = rank.astype(np.int64)
    half = np.zeros(len(out), np.int64)
    while (low := (np.int64(1) << (2 * half)) < n).any():
        half += low
    mask = (np.int64(1) << half) - 1
    open_ = np.flatnonzero(n > 1)
    while len(open_):
        left, right, m, k = out[open_] >> half[open_], out[open_] & mask[open_], mask[open_], key[open_]
        for turn in range(FEISTEL_TURNS):
            v = (right + ((k >> (6 * turn)) & (2**30 - 1))) * (1 + (k >> (4 * turn)) % (PRIME - 1)) % PRIME
            left, right = right, left ^ ((v ^ (v >> 11)) & m)
        out[open_] = left << half[open_] | right
        open_ = open_[out[open_] >= n[open_]]
    return out


def _ranked(df: DataFrame, within: Sequence[str], seed: int, purpose: str) -> DataFrame:
    """Append _key, _k, the row's rank in its group from 0, and _n, the group's rows."""
    rows = draw_rank(df.withColumn("_key", key_of(within)), drawn(seed, purpose, F.col("row_id")), ["_key"], out="_k", size="_n")
    return rows.withColumn("_k", F.col("_k") - 1)


@own_names
def permute(df: DataFrame, column: str, within: Sequence[str] = ("fold",), seed: int = 1, out: str = "permuted") -> DataFrame:
    """Append the column as shuffled over the rows of each group: one draw's order is laid beside another's. Null groups are groups."""
    df = df.withColumn("_key", key_of(within))
    a = draw_rank(df, drawn(seed, f"{column}:to", F.col("row_id")), ["_key"], out="_k")
    b = draw_rank(df.select("_key", "row_id", column), drawn(seed, column, F.col("row_id")), ["_key"], out="_k")
    return a.join(b.select("_key", F.col(column).alias(out), "_k"), ["_key", "_k"]).drop("_key", "_k")


@own_names
def permute_each(df: DataFrame, features: str = "features", within: Sequence[str] = ("fold",), seed: int = 1) -> DataFrame:
    """A row for each row and feature: feature, x, permuted, and the columns of `df` but the features.

    Rows are ranked in their groups once, and each feature has a bijection of the ranks of its own. Rows, and the values
    that go to them, are dealt to blocks of neighbouring ranks as compressed Arrow batches, so the long table is never
    shuffled. Null groups are groups.
    """
    bounded_batches(df.sparkSession)
    own = [f for f in df.schema.fields if f.name != features]
    kind = df.schema[features].dataType.elementType
    # the groups may be costly, and ranks read them three times
    given = materialise(df, "given", "zstd")
    rows = materialise(_ranked(given, within, seed, features).drop("_cell"), "ranked", "zstd")
    discard(given)
    packs = rows.mapInArrow(_dealt_to_blocks(seed, features), "_key string, _block long, _values boolean, _pack binary")
    packs = packs.repartition(tasks_of(rows, rows.count()), "_key", "_block").sortWithinPartitions("_key", "_block", "_values")
    schema = StructType([*own]).add("feature", IntegerType()).add("permuted", kind).add("x", kind)
    return packs.mapInArrow(_laid_out([f.name for f in own], features), schema)


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _places(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each value in the lists: its list, its place in there, and the value."""
    of = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return of, np.arange(len(of)) - np.searchsorted(of, of), lists.flatten()


def _by_block(t: pa.Table, block: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block, in `order`, which has those of one block side by side."""
    t, block = t.take(pa.array(order)).combine_chunks(), block[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
    for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
        yield int(block[a]), t.slice(a, b - a)


def _dealt_to_blocks(seed: int, features: str):
    """Rows, and their features' values where they go, as packs of the blocks of ranks that they are in."""
    bit = (1 << PLACE_BITS) - 1

    def packs(t: pa.Table) -> Iterator[tuple[str, int, bool, bytes]]:
        for key in t["_key"].unique().to_pylist():
            own = t.filter(pa.compute.equal(t["_key"], key)).combine_chunks()
            k, n = (own[c].to_numpy() for c in ("_k", "_n"))
            rows = own.drop_columns(["_key", "_k", "_n"]).append_column("_at", pa.array((k & bit).astype(np.uint16)))
            for block, part in _by_block(rows, k >> PLACE_BITS, np.argsort(k, kind="stable")):
                yield key, block, False, _ipc(part)
            if not own.num_rows:
                continue
            of, feature, values = _places(own[features].combine_chunks())
            to = np.zeros(len(of), np.int64)
            for f in np.unique(feature):
                at = feature == f
                draw = int(hashlib.md5(f"{seed}:{f}:{key}".encode()).hexdigest()[:15], 16)
                to[at] = shuffled_rank(k[of[at]], n[of[at]], np.full(int(at.sum()), draw, np.int64))
            sent = pa.table({"feature": pa.array(feature.astype(np.int32)), "_at": pa.array((to & bit).astype(np.uint16)), "permuted": values})
            for block, part in _by_block(sent, to >> PLACE_BITS, np.lexsort((to, feature, to >> PLACE_BITS))):
                yield key, block, True, _ipc(part)

    def out(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, values, pack in packs(pa.Table.from_batches(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block]), pa.array([values]), pa.array([pack], pa.binary())], names=["_key", "_block", "_values", "_pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= DEALT_ROWS:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return run


def _laid_out(own: Sequence[str], features: str):
    """The rows of each block beside the values that came to it; the packs of a block come side by side, rows first."""

    def lay(rows: list[bytes], values: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not values:
            return
        read = lambda packs: pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks()
        table = read(rows)
        table = table.take(pa.compute.sort_indices(table["_at"])).combine_chunks()  # a block's ranks have no gaps
        sent = read(values)
        at, feature = (sent[c].to_numpy().astype(np.int64) for c in ("_at", "feature"))
        order = np.lexsort((feature, at))
        at, feature, permuted = at[order], feature[order], sent["permuted"].take(pa.array(order))
        lists = table[features].combine_chunks()
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
        place = (np.cumsum(sizes) - sizes)[at] + feature
        x = lists.flatten().take(pa.array(place, mask=feature >= sizes[at]))
        step = 1 << 14
        for k in range(0, len(at), step):
            part = table.select(own).take(pa.array(at[k : k + step]))
            cells = [*part.columns, pa.array(feature[k : k + step].astype(np.int32)), permuted.slice(k, step), x.slice(k, step)]
            yield from pa.table(cells, names=[*own, "feature", "permuted", "x"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for b in batches:
            for r in b.to_pylist():
                if (r["_key"], r["_block"]) != now:
                    yield from lay(*held)
                    now, held = (r["_key"], r["_block"]), ([], [])
                held[r["_values"]].append(r["_pack"])
        yield from lay(*held)

    return run
