"""Threshold-scaled sketches: keep every shingle hash below a fixed fraction of the hash range.

A text's words, lower-cased in A-Z, give shingles of five words (fewer words: the whole sequence, so every text has at
least one). Each is hashed to 64 bits; hashes under FRACTION of the range are kept, and where none is, the smallest.
Sketches of parts merge by union (then dropping what a whole sketch would not keep), and the share of kept hashes of
one text found in another estimates containment, however unequal their lengths. Native expressions only.

Nulls and ties: a null text counts as empty; equal texts have equal sketches. Documents are in descending order of
doc_id, null last, equal ids by text; each one's next wraps around at the end. A single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.ordering import range_bounds, range_bucket
from ..session import shuffle_partitions

SHINGLE_WORDS = 5
FRACTION = 0.25
#: Bits of each kept hash in a fingerprint; the top ones, so order is kept.
DIGITS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signed hashes run from -2**63 on.
_LEAST = -(1 << 63)


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _LOWER + " " * 5)
    return F.array_remove(F.split(plain, " "), "")


def _kept(h: Column, fraction: float) -> Column:
    """Sorted distinct hashes under the bound."""
    bound = F.lit(_LEAST + int(fraction * (1 << 64)))
    return F.array_sort(F.array_distinct(F.filter(h, lambda x: x < bound)))


def add_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, k: int = SHINGLE_WORDS) -> DataFrame:
    """Append the sketch of a text column. Step by step, so that no step is evaluated twice."""
    df = df.withColumn("_e", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    many = F.transform(F.sequence(F.lit(1), F.size("_e") - (k - 1)), lambda i: F.xxhash64(F.slice("_e", i, k)))
    df = df.withColumn("_h", F.when(F.size("_e") > k, many).otherwise(F.array(F.xxhash64("_e"))))
    df = df.withColumn("_l", _kept(F.col("_h"), fraction))
    return df.withColumn(out, F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array(F.array_min("_h")))).drop("_e", "_h", "_l")


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two parts together."""
    both = F.array_union(a, b)
    low = _kept(both, fraction)
    return F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of `a` that `b` has."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(a)


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller in the larger: 1 for equal sketches, 0 for disjoint ones."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.least(F.size(a), F.size(b))


def as_text(sk: Column) -> Column:
    """Kept hashes, moved to count from 0, as hexadecimal digits each."""
    flip = F.lit(_LEAST)
    return F.array_join(F.transform(sk, lambda x: F.substring(F.lpad(F.lower(F.hex(x.bitwiseXOR(flip))), 16, "0"), 1, DIGITS)), "")


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id and sketch (array of kept hashes) of every document."""
    return add_sketch(docs.select("doc_id", "text"), "text", "sketch", fraction).select("doc_id", "sketch")


def in_ranges(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """doc_id, text, a guest mark, and a window in which each row is followed by its next document.

    Documents are dealt to ranges of doc_id, and the first of each range is sent to the range before it as well, as a
    guest, so that the windows see every next row and nothing is ordered in one task. Drop guests after use.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_.alias("_id"))
    bounds = range_bounds(docs, "_id", buckets or 4 * shuffle_partitions(spark)) or [0]
    n = len(bounds)
    docs = docs.withColumn("_b", range_bucket(F.col("_id"), bounds))
    # the highest id of bucket b is bounds[b]; those rows follow bucket b + 1, and the highest of all follow bucket 0
    here = F.struct(F.lit(0).alias("guest"), F.col("_b").alias("b"))
    there = F.struct(F.lit(1).alias("guest"), ((F.col("_b") + 1) % n).alias("b"))
    top = F.col("_id") == F.get(F.array(*[F.lit(b) for b in bounds]), F.col("_b"))
    rows = docs.withColumn("_to", F.explode(F.when(top, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("doc_id", "text", "_id", F.col("_to.guest").alias("_guest"), F.col("_to.b").alias("_b"))
    return rows, Window.partitionBy("_b").orderBy("_guest", F.col("_id").desc(), F.col("text"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points, or all, of another's start."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
