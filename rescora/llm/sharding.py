"""K-d tree sharding by bytes.

Rows are points in a few metadata dimensions with their bytes as weights. A node that should hold k target leaves is cut
along its widest dimension (range as a share of the whole table's range) at the weighted quantile floor(k/2)/k, found by
distributed histograms: each pass adds 12 bits of the ordering key (dimension, hash of the text, hash of the row), sums
them up by node and digit, and gives the driver the one digit of each node in which its cut lies. All nodes of a level
are cut in the same passes, which end when what straddles the cut is under `tolerance` of a leaf. After each level rows
are written with their node; cuts are joined as a table. What the driver and each worker hold is the tree: a few numbers
for each shard.

Equal texts have equal coordinates and equal text hashes, so a group of copies stays in one shard; only where one group
straddles a cut with more than `cohesion` of a leaf, and more than the largest row, is it cut by row hash, as near-equal
bytes come first. With cohesion=inf no group is ever cut; shards then differ by up to the bytes of the largest group.

Nulls: a null text weighs 1 byte and sits at the origin; ties are ordered by hash, then doc_id. Rows that agree in
everything are interchangeable. An empty table gives no rows. Extra columns are kept; those named like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.names import own_names
from ..operators.ordering import running_sum
from ..session import bounded_batches, discard, materialise
from .common import utf8_bytes

#: Bits of the key: of a coordinate, of each hash, and those that a pass adds.
VALUE_BITS, HASH_BITS, STEP = 24, 48, 12
#: Sums of a pass that the driver looks through itself.
SUMS = 1 << 18
DIGITS = (VALUE_BITS + 2 * HASH_BITS) // STEP
#: Parts of a leaf's bytes: at most so much lies on the wrong side of a cut; groups of copies up to this stay whole.
TOLERANCE, COHESION = 0.002, 0.08
#: Rows of one shard are numbered in so many cells.
CELLS = 256


@dataclass(frozen=True)
class Cut:
    """Rows whose (dimension, text hash, row hash) is below the bound go to the left child."""

    dim: int
    bound: tuple[int, int, int]


def points(docs: DataFrame) -> DataFrame:
    """Bytes, checksum, coordinates and hashes of each row, beside what `docs` has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars, size = F.char_length(text), utf8_bytes(F.col("text")) + 1
    lines = chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.withColumns(
        {
            "size": size,
            "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long"),
            "_d0": F.log1p(chars.cast("double")),
            "_d1": size.cast("double") / (chars + 1),
            "_d2": F.log1p(lines.cast("double")),
            "_g": F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS),
            "_i": F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col("doc_id"), text), 64 - HASH_BITS),
        }
    )


DIMS = ("_d0", "_d1", "_d2")


def _ranges(rows: DataFrame) -> tuple[list[tuple[float, float]], int, int]:
    """Least value and scale of each dimension over all rows; bytes of all and of the largest row."""
    row = rows.agg(F.sum("size").alias("w"), F.max("size").alias("m"), *[f(d).alias(f"{n}{d}") for d in DIMS for n, f in (("a", F.min), ("b", F.max))]).first()
    out = []
    for d in DIMS:
        low, high = row[f"a{d}"] or 0.0, row[f"b{d}"] or 0.0
        out.append((low, ((1 << VALUE_BITS) - 1) / (high - low) if high > low else 0.0))
    return out, row["w"] or 0, row["m"] or 0


def _grid(ranges: list[tuple[float, float]]) -> dict[str, Column]:
    """Each dimension as a whole number of VALUE_BITS bits over its range in all rows."""
    return {f"_x{k}": F.floor((F.col(d) - F.lit(low)) * F.lit(scale)).cast("long") for k, (d, (low, scale)) in enumerate(zip(DIMS, ranges, strict=True))}


def _along(dim: Column) -> Column:
    return F.when(dim == 0, F.col("_x0")).when(dim == 1, F.col("_x1")).otherwise(F.col("_x2"))


def _top(x: Column, bits: int, kept: int) -> Column:
    """The highest `kept` of `bits` bits."""
    return F.shiftright(x, bits - kept)


def _digit(p: int) -> tuple[Column, Column]:
    """Digit p of the ordering key along _dim, and whether the digits before it are those of (_pv, _pg, _pi)."""
    value, at = _along(F.col("_dim")), STEP * p
    if at < VALUE_BITS:
        same = _top(value, VALUE_BITS, at) == _top(F.col("_pv"), VALUE_BITS, at)
        return _top(value, VALUE_BITS, at + STEP).bitwiseAND((1 << STEP) - 1), same
    same, at = value == F.col("_pv"), at - VALUE_BITS
    if at < HASH_BITS:
        return _top(F.col("_g"), HASH_BITS, at + STEP).bitwiseAND((1 << STEP) - 1), same & (_top(F.col("_g"), HASH_BITS, at) == _top(F.col("_pg"), HASH_BITS, at))
    same, at = same & (F.col("_g") == F.col("_pg")), at - HASH_BITS
    return _top(F.col("_i"), HASH_BITS, at + STEP).bitwiseAND((1 << STEP) - 1), same & (_top(F.col("_i"), HASH_BITS, at) == _top(F.col("_pi"), HASH_BITS, at))


def _bound(prefix: list[int]) -> tuple[int, int, int]:
    """The least key that begins with these digits; a digit may be one too many, which carries."""
    n = 0
    for d in [*prefix, *[0] * (DIGITS - len(prefix))]:
        n = (n << STEP) + d
    mask = (1 << HASH_BITS) - 1
    return n >> (2 * HASH_BITS), (n >> HASH_BITS) & mask, n & mask


_STATE = ("_dim", "_goal", "_before", "_pv", "_pg", "_pi")


def _with_state(rows: DataFrame, state: dict[int, tuple]) -> DataFrame:
    """Rows of the nodes in `state` with its values: as expressions for a few nodes, joined as a table for many."""
    if len(state) > 1 << 6:
        table = rows.sparkSession.createDataFrame([(n, *v) for n, v in state.items()], "_at long, _dim int, _goal double, _before long, _pv long, _pg long, _pi long")
        return rows.join(F.broadcast(table), F.col("_node") == F.col("_at")).drop("_at")
    out = {}
    for k, name in enumerate(_STATE):
        value = F.lit(None).cast("double" if name == "_goal" else "int" if name == "_dim" else "long")
        for n, v in state.items():
            value = F.when(F.col("_node") == n, F.lit(v[k])).otherwise(value)
        out[name] = value
    return rows.where(F.col("_node").isin(*state)).withColumns(out)


def _where_reached(sums: DataFrame, few: bool) -> list[tuple[int, int, int, int, int]]:
    """By node: the first digit at which the sum so far reaches the goal, or the last; its sum and rows, and the sum before it.

    A few sums are looked through here; many in Spark, and one row of each node is collected.
    """
    if few:
        out, so_far = {}, {}
        for n, d, w, c, goal, before in sorted(map(tuple, sums.collect())):
            less = so_far.get(n, 0)
            if n not in out or before + less < goal:
                out[n] = (n, d, w, c, less)
            so_far[n] = less + w
        return list(out.values())
    upto = F.sum("w").over(Window.partitionBy("_node").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("_node", "d", "w", "c", (upto - F.col("w")).alias("less"), (F.col("before") + upto >= F.col("goal")).alias("over"))
    first = F.min(F.when(F.col("over"), F.struct("d", "w", "c", "less")))
    found = sums.groupBy("_node").agg(F.coalesce(first, F.max(F.struct("d", "w", "c", "less"))).alias("x"))
    return [tuple(r) for r in found.select("_node", "x.*").collect()]


def _cuts(rows: DataFrame, leaves: dict[int, int], leaf: float, whole: float) -> dict[int, Cut]:
    """Cuts of all nodes in `leaves` (node: leaves below it), found together. whole: groups up to so many bytes stay whole."""
    spread = rows.groupBy("_node").agg(F.sum("size").alias("w"), *[(F.max(f"_x{k}") - F.min(f"_x{k}")).alias(f"s{k}") for k in range(len(DIMS))]).collect()
    spread = [r for r in spread if r["_node"] in leaves]
    dim = {r["_node"]: max(range(len(DIMS)), key=lambda k: (r[f"s{k}"], -k)) for r in spread}
    goal = {r["_node"]: r["w"] * (leaves[r["_node"]] // 2) / leaves[r["_node"]] for r in spread}
    prefix, done, before = {n: [] for n in dim}, {}, dict.fromkeys(dim, 0)
    for p in range(DIGITS):
        open_ = [n for n in dim if n not in done]
        if not open_:
            break
        state = {n: (dim[n], float(goal[n]), before[n], *_bound(prefix[n])) for n in open_}
        digit, inside = _digit(p)
        at = _with_state(rows, state).where(inside)
        sums = at.groupBy("_node", digit.alias("d")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c"), F.first("_goal").alias("goal"), F.first("_before").alias("before"))
        for n, d, w, c, less in _where_reached(sums, len(open_) << STEP <= SUMS):
            before[n] += less
            group_whole = STEP * (p + 1) == VALUE_BITS + HASH_BITS and w <= whole
            if w <= TOLERANCE * leaf or c == 1 or group_whole or p == DIGITS - 1:
                after = before[n] + w - goal[n] < goal[n] - before[n]
                done[n] = Cut(dim[n], _bound([*prefix[n], d + after]))
            else:
                prefix[n].append(d)
    return done


def _descended(rows: DataFrame, cuts: dict[int, Cut], all_cut: bool) -> DataFrame:
    """Rows with the children's numbers in place of those of nodes that were cut."""
    few = {n: (c.dim, 0.0, 0, *c.bound) for n, c in cuts.items()}
    both = _with_state(rows, few)
    value = _along(F.col("_dim"))
    tie = (F.col("_g") < F.col("_pg")) | ((F.col("_g") == F.col("_pg")) & (F.col("_i") < F.col("_pi")))
    below = (value < F.col("_pv")) | ((value == F.col("_pv")) & tie)
    out = both.withColumn("_node", F.col("_node") * 2 + F.when(below, 0).otherwise(1)).drop(*_STATE)
    if all_cut:
        return out
    rest = rows.where(~F.col("_node").isin(*few)) if len(few) <= 1 << 6 else rows.join(F.broadcast(_numbers(rows, few)), F.col("_node") == F.col("_at"), "left_anti")
    return out.unionByName(rest)


def _numbers(rows: DataFrame, nodes: Iterable[int]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(n,) for n in nodes], "_at long")


@dataclass(frozen=True)
class Tree:
    """Cuts by node (children of n are 2n and 2n + 1), shard numbers by leaf, and the dimensions' ranges."""

    cuts: dict[int, Cut]
    shards: dict[int, int]
    ranges: list[tuple[float, float]]

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut, left and right child, and shard of each node; made once by each worker that holds the tree."""
        nodes = sorted({*self.cuts, *self.shards})
        place = {n: k for k, n in enumerate(nodes)}
        cut = np.array([(self.cuts[n].dim, *self.cuts[n].bound) if n in self.cuts else (-1, 0, 0, 0) for n in nodes], np.int64).reshape(-1, 4)
        left, right = (np.array([place.get(2 * n + k, 0) for n in nodes], np.int64) for k in (0, 1))
        return cut, left, right, np.array([self.shards.get(n, -1) for n in nodes], np.int32)

    def walk(self, points_: list[np.ndarray]) -> np.ndarray:
        """The shard of each point (_x0, _x1, _x2, _g, _i), level by level."""
        cut, left, right, shard_ = self.arrays
        x, g, i = np.stack(points_[:-2]), *points_[-2:]
        at = np.zeros(len(g), np.int64)
        while len(open_ := np.flatnonzero(cut[at, 0] >= 0)):
            dim, v, cg, ci = cut[at[open_]].T
            value, hg, hi = x[dim, open_], g[open_], i[open_]
            below = (value < v) | ((value == v) & ((hg < cg) | ((hg == cg) & (hi < ci))))
            at[open_] = np.where(below, left[at[open_]], right[at[open_]])
        return shard_[at]


def kd_tree(rows: DataFrame, shards: int, cohesion: float = COHESION) -> tuple[Tree, DataFrame]:
    """The tree over rows of points(), and those rows with the node that they have reached."""
    ranges, total, largest = _ranges(rows)
    leaf = total / shards
    whole = max(cohesion * leaf, largest)
    cuts: dict[int, Cut] = {}
    leaves, final = {1: shards}, []
    rows = rows.withColumns(_grid(ranges)).drop(*DIMS).withColumn("_node", F.lit(1).cast("long"))
    while leaves:
        final += [n for n, k in leaves.items() if k == 1]
        leaves = {n: k for n, k in leaves.items() if k > 1}
        now = _cuts(rows, leaves, leaf, whole) if leaves and total else {}
        final += [n for n in leaves if n not in now]
        cuts |= now
        if now:
            last, rows = rows, materialise(_descended(rows, now, not final), "nodes")
            discard(last)
        leaves = {c: k for n in now for c, k in ((2 * n, leaves[n] // 2), (2 * n + 1, leaves[n] - leaves[n] // 2))}
    # left to right: compare nodes as paths
    order = sorted(final, key=lambda n: bin(n)[3:])
    return Tree(cuts, {n: k for k, n in enumerate(order)}, ranges), rows


def target_shards(total_bytes: int, target_bytes: int) -> int:
    """Leaves of about target_bytes each."""
    return max(1, -(-total_bytes // max(1, target_bytes)))


@own_names
def shard(docs: DataFrame, shards: int, compact: bool = False, cohesion: float = COHESION) -> DataFrame:
    """Every row of `docs` with size, text_crc32, shard and slot (gapless in its shard, in an order by hash).

    The tree is found on a written table of coordinates. compact: give doc_id and the results only, from that table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = ["doc_id", "size", "text_crc32", *DIMS, "_g", "_i"]
    rows = materialise(points(docs).select(*kept), "points")
    tree, reached = kd_tree(rows, shards, cohesion)
    if compact:
        # a row for each shard
        names = spark.createDataFrame(list(tree.shards.items()), "_leaf long, shard int")
        out = reached.join(F.broadcast(names), F.col("_node") == F.col("_leaf")).drop("_leaf", "_node")
    else:
        held = spark.sparkContext.broadcast(tree)

        @F.arrow_udf("int")
        def shard_of(x0: pa.Array, x1: pa.Array, x2: pa.Array, g: pa.Array, i: pa.Array) -> pa.Array:
            return pa.array(held.value.walk([a.to_numpy(zero_copy_only=False) for a in (x0, x1, x2, g, i)]), pa.int32())

        out = points(docs).withColumns(_grid(tree.ranges)).withColumn("shard", shard_of("_x0", "_x1", "_x2", "_g", "_i"))
    out = out.withColumn("_cell", F.col("_i") % CELLS)
    order = [F.col("_i"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    out = running_sum(out, {"slot": F.lit(1).cast("long")}, ["shard"], "_cell", order)
    return out.withColumn("slot", F.col("slot") - 1).drop(*DIMS, "_x0", "_x1", "_x2", "_g", "_i", "_cell")


def write_shards(docs: DataFrame, path: str, target_bytes: int) -> DataFrame:
    """Write `docs` as Parquet by shard, each of about target_bytes, rows in slot order; returns what was written.

    An empty table is written without shards, its columns as they would be.
    """
    total = docs.agg(F.sum(utf8_bytes(F.col("text")) + 1)).first()[0] or 0
    n = target_shards(total, target_bytes)
    out = shard(docs, n)
    if total:
        out.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    else:
        out.write.parquet(path)
    return docs.sparkSession.read.parquet(path)
