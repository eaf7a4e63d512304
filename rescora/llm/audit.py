"""How filters interact: what each one removes in every order of applying them.

Each document gets a mask with a bit for each filter that it fails. The counts of documents by part and mask, 32 cells
with five filters, hold everything: a filter at a step removes the cells with its bit and none of an earlier filter's.
So the table is reduced to cells once, and the orders are enumerated from the cells of each part, beside each other.

The filters here, on whole texts: A has too few words, B too few distinct words, C too many capitals, D a character of
DOUBTFUL, E is identical to the text of a smaller doc_id anywhere in the table. E comes from the smallest doc_id of
each text, by SHA-256 of the text, and a join on text and doc_id, so many copies of one text are dealt out by doc_id.
Native expressions only.

Nulls and ties: a null text is empty, a null source is the part "" as an empty one is. A null doc_id fails no E and has
no labels. Rows of one doc_id and text don't fail E by each other. A document is good or toxic if any of its rows in
labels says so. An empty table has no parts and no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, DOUBTFUL = 50, 65, 5, r"[#$%&*|]"
#: Of a document: how many there are, and how many of them are marked.
COUNTS = ("n", "good", "toxic")


def _bits(conditions: dict[str, Column]) -> Column:
    bits = [F.when(v, 1 << FILTERS.index(k)).otherwise(0) for k, v in conditions.items()]
    return sum(bits[1:], bits[0]).cast("int")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, text digest and the mask of the filters that a text fails by itself (A to D)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_w", F.array_remove(F.split("text", WORD.replace("^", "")), ""))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_distinct", F.size(F.array_distinct("_w")))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    mask = _bits(
        {
            "A": F.col("_n") < LEAST_WORDS,
            "B": F.col("_distinct").cast("long") * 100 < F.col("_n").cast("long") * LEAST_DISTINCT,
            "C": capitals.cast("long") * 100 > F.char_length("text").cast("long") * MOST_CAPITALS,
            "D": F.col("text").rlike(DOUBTFUL),
        }
    )
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: part, mask of all five filters, good and toxic."""
    rows = materialise(failures(docs), "audit-rows")
    no_id, rows = rows.where("doc_id IS NULL"), rows.where("doc_id IS NOT NULL")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    again = F.when(F.col("_first"), 0).otherwise(1 << FILTERS.index("E"))
    rows = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    rows = rows.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return rows.unionByName(no_id.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def cells(masked: DataFrame) -> DataFrame:
    """For each part, arrays of n, good and toxic by mask."""
    per = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # at most 32 rows for each part
    held = per.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("_cells"))
    all_masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def column(name: str) -> Column:
        return F.transform(all_masks, lambda m: F.coalesce(F.try_element_at("_cells", m)[name], F.lit(0)).cast("long")).alias(name)

    return held.select("part", *[column(c) for c in COUNTS])


def _passing(counts: Column) -> Column:
    """For each set of filters, how many documents fail none of them."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)),
        lambda s: F.aggregate(
            F.transform(counts, lambda n, m: F.when(m.bitwiseAND(s) == 0, n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b
        ),
    )


def orders() -> Column:
    """Every order of the filters, as text."""
    return F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])


def enumerated(by_mask: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the cells."""
    rows = by_mask.select("part", "n", *[_passing(F.col(c)).alias(f"_{c}") for c in COUNTS])
    n_orders = 1
    for k in range(2, len(FILTERS) + 1):
        n_orders *= k
    # a failing document is removed by the first of the filters that it fails, each in as many of the orders
    shares = F.array(*[F.lit(n_orders // max(1, m.bit_count())).cast("long") for m in range(1 << len(FILTERS))])
    bits = [F.lit(1 << k) for k in range(len(FILTERS))]

    def shapley(bit: Column) -> Column:
        own = F.transform("n", lambda n, m: F.when(m.bitwiseAND(bit) > 0, n * F.get(shares, m)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    rows = rows.withColumn("_shapley", F.array(*[shapley(b) for b in bits]))
    rows = rows.withColumn("filter_order", F.explode(orders())).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("_k", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    rows = rows.withColumn("_bit", F.get(F.array(*bits), F.col("_k")))
    letters = F.array_remove(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), "")
    earlier = F.transform(letters, lambda c: F.get(F.array(*bits), F.instr(F.lit(FILTERS), c) - 1))
    rows = rows.withColumn("_before", F.aggregate(earlier, F.lit(0), lambda a, b: a.bitwiseOR(b)))
    both = F.col("_before").bitwiseOR(F.col("_bit"))

    def removed(name: str) -> Column:
        return F.get(f"_{name}", F.col("_before")) - F.get(f"_{name}", both)

    fails = F.get("_n", F.lit(0)) - F.get("_n", F.col("_bit"))
    return rows.select(
        "part", "filter_order", "step",
        F.get("_n", both).alias("kept"), removed("n").alias("removed"), (fails - removed("n")).alias("redundant"),
        F.get("n", F.col("_bit")).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"),
        F.get("_shapley", F.col("_k")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter keeps and removes at each step of each order, for each part."""
    return enumerated(cells(masks(docs, labels)))
