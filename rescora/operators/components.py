"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


#: A node's links are dealt to so many parts, since a hub may have a third of all.
PARTS = 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: neighbours (smaller ones, or larger ones) move to the smallest of all.

    Links meet the smallest neighbour by (node, part of the neighbours), so that no task has all links of a hub.
    """
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = near.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    parts = near.groupBy("u", "part").agg(F.min("v").alias("w"))
    least = parts.groupBy("u").agg(F.min("w").alias("w")).select(F.col("u").alias("c"), F.least("u", "w").alias("m"))
    named = parts.join(least, parts.u == least.c).select("c", F.col("part").alias("p"), "m")
    joined = near.join(named, (near.u == named.c) & (near.part == named.p))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _parted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v), u > v, of parts that are stars around their smallest node, and all others; one written table.

    A node is settled if it has one edge to a smaller one and none to larger ones, or only edges to larger ones; a star
    whose nodes are all settled has no further edges.
    """
    ends = [edges.select(F.col(a).alias("node"), F.lit(int(a == "u")).alias("down"), F.lit(int(a == "v")).alias("up")) for a in ("u", "v")]
    nodes = ends[0].unionByName(ends[1]).groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    bad = materialise(nodes.where("down > 1 OR down > 0 AND up > 0").select("node"), "unsettled")
    hubs = edges.join(bad, edges.u == bad.node, "left_semi").unionByName(edges.join(bad, edges.v == bad.node, "left_semi"))
    hubs = hubs.select(F.col("v").alias("hub")).distinct().withColumn("open", F.lit(True))
    marked = materialise(edges.join(hubs, edges.v == hubs.hub, "left").select("u", "v", F.col("open").isNotNull().alias("open")), "parted")
    discard(bad)
    return marked.where("NOT open").select("u", "v"), marked.where("open").select("u", "v")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges (u, v)."""
    top: dict = {}

    def find(x):
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                top[max(u, v)] = min(u, v)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(list(top), kind), pa.array([find(x) for x in list(top)], kind)], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = 0) -> DataFrame:
    """Nodes of `links` with the smallest node that each reaches: columns node, component.

    Null ends and self links are ignored; nodes without links to others don't appear. Rounds grow with the logarithm
    of the graph's size; each is a table in the shared folder. Only a count and a checksum reach the driver. Up to
    one_task distinct links are joined up by union-find in a single task instead. Parts that are stars already take no
    part in further rounds.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = materialise(edges.distinct(), "edges")
    before = _digest(edges)
    if before[0] <= one_task:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}")
    done: list[DataFrame] = []
    while before[0]:
        stars, rest = _parted(edges)
        discard(edges)
        done.append(stars)
        if rest.isEmpty():
            break
        edges = materialise(_star(_star(rest, True), False), "edges")
        before = _digest(edges)
    edges = reduce(DataFrame.unionByName, done, edges.limit(0) if not done else done[0].limit(0))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
