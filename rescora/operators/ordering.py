"""Global order without a single task: range buckets and two-pass running sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import as_bytes, as_text
from ..session import materialise

#: Rows of a cell of in_order(), and the most cells.
CELL_ROWS, MOST_CELLS = 250_000, 1 << 16
#: More buckets than this are never asked for; the bounds go to the driver.
MOST_BUCKETS = 4096
#: Up to so many partitions a task writes rows as they come; beyond, Spark holds and sorts them (spark.shuffle.sort.bypassMergeThreshold).
MOST_UNSORTED = 200


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """Ascending distinct values of `column` that cut its rows into about `buckets` parts; the last is the maximum.

    The bounds are values that occur. An empty or all-null column has none.
    """
    buckets = max(1, min(buckets, MOST_BUCKETS))
    at = [k / buckets for k in range(1, buckets)] + [1.0]
    row = df.select(
        F.percentile_approx(column, at, buckets * 20).alias("q"), F.max(column).alias("top")
    ).first()
    return sorted({*(row["q"] or ()), row["top"]} - {None})


def range_bucket(column: Column, bounds: Sequence) -> Column:
    """How many bounds lie below the value: 0 for the first bucket; null counts as below all bounds."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds[:-1]]) if len(bounds) > 1 else None
    if array is None:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(array, lambda b: b < column)), F.lit(0))


def running_sum(
    df: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    wholes: dict[str, str] | None = None,
    dealt: DataFrame | None = None,
) -> DataFrame:
    """Append inclusive running sums over (keys, bucket, order), in two passes; `wholes` names columns for sums over all of a key.

    `bucket` must not decrease along `order` within the keys, and keys have no nulls. One task holds the rows of one
    (keys, bucket); the second pass adds what lies in earlier buckets, from a table with a row for each (keys, bucket),
    joined in the same partitioning. `dealt` has the rows of `df` as dealt out by (keys, bucket) already; totals are those
    of `df` then, and `order` may name columns that only `dealt` has.
    """
    cells = [*keys, bucket]
    total = df.groupBy(*cells).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(
        *[F.col(c).alias(f"_k_{c}") for c in cells],
        *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(Window.partitionBy(*keys)).alias(f"_w_{k}") for k in (wholes or {}).values()],
    )
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = (df if dealt is None else dealt).withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    on = [F.col(c) == F.col(f"_k_{c}") for c in cells]
    out = out.join(base, on, "left")
    out = out.withColumns({k: F.col(f"_w_{v}") for k, v in (wholes or {}).items()})
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop(*[c for c in base.columns])


def by_short_ids(df: DataFrame, deal: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """What `deal` gives for the rows and their id to order by; text ids are shuffled as bytes, half as long where they are hexadecimal."""
    if "row_id" not in df.columns or df.schema["row_id"].dataType != StringType():
        return deal(df, F.col("row_id"))
    text = as_text(F.col("row_id"))
    return deal(df.withColumn("row_id", as_bytes(F.col("row_id"))), text).withColumn("row_id", text)


def tasks_of(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows: a task has about CELL_ROWS of them, whatever the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_CELLS, -(-rows // CELL_ROWS)))


def dealt_out(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows in `n` partitions by their keys, as repartition() deals them.

    A task that writes to more than MOST_UNSORTED partitions holds what it reads, which for a split of a well compressed file
    is many million rows. So rows go to MOST_UNSORTED tasks first, and those deal out an equal share each.
    """
    if n > MOST_UNSORTED:
        # repartition() of repartition() is one, but not with a column dropped between; small numbers take few bytes
        df = df.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(1 << 16))).repartition(MOST_UNSORTED, "_deal").drop("_deal")
    return df.repartition(n, *keys)


def in_order(df: DataFrame, order: Sequence[Column], rows: int, cell: str = "_b") -> DataFrame:
    """A written table with `cell`, rising along `order` over all rows; cells have about CELL_ROWS of the `rows` rows.

    Cells are cut in the whole order, so where `order` ends in a key, rows of one hot value are cut as well.
    """
    n = max(1, min(MOST_CELLS, -(-rows // CELL_ROWS)))
    dealt = df.repartitionByRange(n, *order) if n > 1 else df
    return materialise(dealt.withColumn(cell, F.spark_partition_id() if n > 1 else F.lit(0)), "in-order")
