"""Time-varying curriculum mixing of sources.

Each source has a weight schedule over training time 0..1, piecewise linear. Its integral is the source's share of all
words; a target stops at `most_repeats` times the source's words and the excess is shared again by weight. The
source's cumulative token demand is its target times the integral so far; the inverse of that curve gives each
document copy the time at which its words are due, and range-sorting by that position yields the training order.

Nulls and ties: a null source is a source of its own, last; a null text has no words; equal documents are ordered by
md5 of doc_id, doc_id and size, and rows that agree in all of these are interchangeable. A document without words is
in the mix as often as its source is passed over, once more if it lies in the last partial pass, and fills nothing. Extra columns are kept; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.names import own_names
from ..operators.ordering import running_sum
from ..session import materialise, shuffle_partitions
from .common import word_count

Knots = Sequence[tuple[float, float]]

#: Schedules dealt to the sources in order, repeating; their integrals are 5, 2 and 1.
CURRICULUM: tuple[Knots, ...] = (
    ((0.0, 7.0), (1.0, 3.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
)
MOST_REPEATS = 3
#: Hexadecimal digits of the hash that cut each source into cells for running sums.
CELL_DIGITS = 3


def integral(knots: Knots) -> float:
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))


def due(share: Column, knots: Knots) -> Column:
    """The time by which `share` (0..1) of the whole integral has passed: the inverse of cumulative demand."""
    total, done, out = integral(knots), 0.0, None
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        area = (b - a) * (u + v) / 2
        if area > 0:
            left = F.greatest(share * F.lit(float(total)) - F.lit(float(done)), F.lit(0.0))
            slope = (v - u) / (b - a)
            root = F.sqrt(F.greatest(F.lit(float(u * u)) + F.lit(2.0 * slope) * left, F.lit(0.0)))
            low = F.lit(float(u)) + root
            time = F.lit(float(a)) + F.when(low > 0, F.lit(2.0) * left / low).otherwise(F.lit(0.0))
            inside = share * F.lit(float(total)) <= F.lit(float(done + area))
            out = F.when(inside, time) if out is None else out.when(inside, time)
            done += area
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0)) if out is not None else F.lit(1.0)


def prepared(docs: DataFrame) -> DataFrame:
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # a key that no null is in, so that windows and joins share one partitioning
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.withColumns(
        {"_key": key, "size": word_count(F.col("text")), "_h": h, "_cell": F.conv(F.substring(h, 1, CELL_DIGITS), 16, 10).cast("int")}
    )


def source_targets(
    sizes: DataFrame, schedules: Sequence[Knots] = CURRICULUM, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """source, source_size, target, _class: a row for each source, from rows (source, size).

    With sources in ascending order of (cap / weight), the level at which demand meets supply is the first at which a
    source isn't above its cap; this is what sharing the excess again and again arrives at.
    """
    weights = F.array(*[F.lit(float(integral(k))) for k in schedules])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_class", ((F.row_number().over(named) - 1) % F.lit(len(schedules))).cast("int"))
    per = per.withColumn("_w", F.get(weights, F.col("_class")))
    per = per.withColumn("_cap", (F.col("source_size") * most_repeats).cast("double"))
    per = per.withColumn("_full", F.try_divide(F.col("_cap"), F.col("_w")))
    order = Window.orderBy(F.col("_full").asc_nulls_last(), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    supply = F.sum("source_size").over(all_rows).cast("double")
    left = supply - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", F.try_divide(left, weight))
    per = per.withColumn("_at", F.row_number().over(order))
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_at", "_level"))).over(all_rows)["_level"]
    target = F.least(F.coalesce(level, F.lit(0.0)) * F.col("_w"), F.col("_cap"))
    return per.select("source", "source_size", F.when(F.col("_w") > 0, target).otherwise(0.0).alias("target"), "_class")


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their source's figures, the words up to each row in the source's order, full passes and the rest."""
    t = targets.withColumnRenamed("source", "_source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = running_sum(
        rows, {"_end": F.col("size")}, ["_key"], "_cell", [F.col("_h"), F.col("doc_id"), F.col("size")]
    )
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    return rows.withColumn("_full", full).withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))


def _filled(placed: DataFrame) -> DataFrame:
    """The rows (_k, _e) beyond the last partial pass that fill what is missing, until no row that is left fits.

    Each round takes, of the rows that aren't larger than the gap, the first by hash up to it.
    """
    fits = F.col("_end") <= F.col("_rest")
    gaps = placed.groupBy("_key").agg((F.first("_rest") - F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0))).alias("_gap"))
    left = placed.where(~fits & (F.col("size") > 0)).select("_key", "_cell", "_h", "doc_id", "size", "_end")
    out = None
    while True:
        left = materialise(left.join(gaps, "_key").where("size <= _gap"), "mix-left")
        taken = running_sum(left, {"_sum": F.col("size")}, ["_key"], "_cell", [F.col("_h"), F.col("doc_id"), F.col("size")])
        taken = materialise(taken.where("_sum <= _gap").select(F.col("_key").alias("_k"), F.col("_end").alias("_e"), "size", "_gap"), "mix-taken")
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out.select("_k", "_e")
        gaps = materialise(taken.groupBy("_k").agg((F.first("_gap") - F.sum("size")).alias("_gap")), "mix-gaps").withColumnRenamed("_k", "_key")
        left = left.drop("_gap").join(taken, (F.col("_key") == F.col("_k")) & (F.col("_end") == F.col("_e")), "left_anti")


@own_names
def mix(
    docs: DataFrame, schedules: Sequence[Knots] = CURRICULUM, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """Every row of `docs` with size, source_size, target, taken, repeats and positions (one for each copy, ascending).

    The last partial pass stops at the first row by hash that is too long. Then rows beyond it are added by hash, of those
    that fit, again and again until what is missing is below the smallest left, so a source misses its target by less
    than that. The plan is made on a written table without the texts; only the small tables that come of it join the documents.
    """
    compact = materialise(prepared(docs).select("doc_id", "source", "_key", "size", "_h", "_cell"), "mix-rows")
    targets = materialise(source_targets(compact, schedules, most_repeats), "mix-targets")
    placed = materialise(_placed(compact, targets), "mix-placed")
    fills = _filled(placed)
    bare = set(docs.columns) == {"doc_id", "source", "text"}
    rows = _placed(compact if bare else prepared(docs), targets)
    # a row with words is alone at its end; those without take no part in filling
    found = fills.select("_k", F.col("_e").alias("_fill"))
    rows = rows.join(found, (F.col("_key") == F.col("_k")) & (F.col("_end") == F.col("_fill")) & (F.col("size") > 0), "left")
    extra = (F.col("_end") <= F.col("_rest")) | F.col("_fill").isNotNull()
    rows = rows.withColumn("repeats", F.least(F.col("_full") + extra.cast("int"), F.lit(most_repeats)))
    start = F.col("_end") - F.col("size")

    def place(copy: Column) -> Column:
        share = F.coalesce(F.try_divide(copy * F.col("source_size") + start, F.col("target")), F.lit(0.0))
        out = due(share, schedules[0])
        for k in range(1, len(schedules)):
            out = F.when(F.col("_class") == k, due(share, schedules[k])).otherwise(out)
        return F.coalesce(out, F.lit(1.0))

    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.col("repeats") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.transform(copies, place))
    rows = rows.withColumn("taken", F.col("size") * F.col("repeats"))
    return rows.drop("_key", "_h", "_cell", "_class", "_end", "_full", "_rest", "_k", "_fill")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by its position."""
    rows = mixed.withColumn("position", F.explode("positions"))
    return rows.repartitionByRange(shuffle_partitions(mixed.sparkSession), "position", "doc_id").sortWithinPartitions(
        "position", "doc_id"
    )
