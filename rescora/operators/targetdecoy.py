"""Target-decoy statistics: pi0, q-values, isotonic error probabilities, yields.

Tables have label (+1 target, -1 decoy), score and row_id, the tie-breaker. Up to ONE_TASK rows a window in one task
ranks them; beyond that, score ranges are ranked side by side and put together through a table of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bounded_batches, discard, ipc_bytes, materialise
from .names import key_of, own_names
from .ordering import by_short_ids, in_order, running_sum, tasks_of

ONE_TASK = 1_000_000
#: Hulls of neighbouring score ranges that are merged at once.
FAN_IN = 64
TEST_FDR = 0.01


def pi0_of(label: Column) -> Column:
    """Aggregate: decoys / targets, at most 1; 1 without targets."""
    return _share(F.count_if(label > 0), F.count_if(label < 0))


def _share(targets: Column, decoys: Column) -> Column:
    return F.when(targets > 0, F.least(decoys.cast("double") / targets, F.lit(1.0))).otherwise(F.lit(1.0))


def label_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col("label") > 0).alias("targets"), F.count_if(F.col("label") < 0).alias("decoys"), pi0_of(F.col("label")).alias("pi0")
    )


def _fdr(targets: Column, decoys: Column, pi0: Column) -> Column:
    return F.when(targets > 0, F.least(pi0 * decoys / targets, F.lit(1.0))).otherwise(F.lit(1.0))


def _in_ranges(df: DataFrame, keys: Sequence[str], score: str, rows: int) -> DataFrame:
    """A written table with _g, a hash of the keys, and _b, cells along (keys, falling score, row_id)."""
    df = df.withColumn("_g", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    return in_order(df, [F.col("_g"), F.col(score).desc(), F.col("row_id")], rows)


def _counted(df: DataFrame, keys: Sequence[str], score: str, pi0: Column | float | None, one_task: int, rows: int | None = None) -> tuple[DataFrame, bool]:
    """Append _pi0, and _t and _d, targets and decoys down to each rank; whether by score ranges.

    One aggregation over the rows gives their number, where it isn't known with pi0, and pi0.
    """
    known = pi0 is not None
    if known:
        df = df.withColumn("_pi0", F.lit(float(pi0)) if isinstance(pi0, (int, float)) else pi0)
    if known and rows is not None:
        pass
    elif not keys:
        row = df.agg(F.count(F.lit(1)).alias("n"), pi0_of(F.col("label")).alias("p")).first()
        rows = row["n"]
        df = df if known else df.withColumn("_pi0", F.lit(float(row["p"])))
    elif known:
        rows = df.count()
    else:
        own = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), pi0_of(F.col("label")).alias("_pi0")), "label-counts")
        rows = own.agg(F.sum("_n")).first()[0] or 0
        own = own.select("_pi0", *[F.col(k).alias(f"_p_{k}") for k in keys])
        df = df.join(own, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]).drop(*[f"_p_{k}" for k in keys])
    best = [F.col(score).desc(), F.col("row_id").asc()]
    ones = {"_t": (F.col("label") > 0).cast("long"), "_d": (F.col("label") < 0).cast("long")}
    if rows <= one_task:
        down = Window.partitionBy(*keys).orderBy(*best).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(v).over(down) for k, v in ones.items()}), False
    return running_sum(_in_ranges(df, keys, score, rows), ones, ["_g"], "_b", best), True


@own_names
def qvalues(
    df: DataFrame,
    keys: Sequence[str] = (),
    pi0: Column | float | None = None,
    score: str = "score",
    out: str = "q",
    one_task: int = ONE_TASK,
    rows: int | None = None,
) -> DataFrame:
    """Append the q-value of every row, targets and decoys, within `keys`.

    Over falling score, the false discovery rate at a rank is pi0 * decoys / targets so far (1 before any target, at
    most 1); q is its minimum from the worst rank up. pi0: a number, a column equal within keys, or None to estimate.
    `rows` is the number of rows where it is known.
    """
    if not keys and not isinstance(pi0, Column) and _portable(df):
        if rows is None or pi0 is None:
            row = df.agg(F.count(F.lit(1)).alias("n"), pi0_of(F.col("label")).alias("p")).first()
            rows, pi0 = row["n"], float(row["p"] if pi0 is None else pi0)
        if rows > one_task:
            return _qvalues_of_pieces(df, rows, pi0, score, out)
    df, ranges = _counted(df, keys, score, pi0, one_task, rows)
    df = df.withColumn("_f", _fdr(F.col("_t"), F.col("_d"), F.col("_pi0")))
    cells = ["_g", "_b"] if ranges else list(keys)
    up = Window.partitionBy(*cells).orderBy(F.col(score).asc(), F.col("row_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    low = F.min("_f").over(up)
    if not ranges:
        return df.withColumn(out, low).drop("_f", "_t", "_d", "_pi0")
    later = Window.partitionBy("_g").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    worse = df.groupBy("_g", "_b").agg(F.min("_f").alias("_m"))
    worse = worse.select(F.col("_g").alias("_kg"), F.col("_b").alias("_kb"), F.min("_m").over(later).alias("_later"))
    df = df.join(worse, (F.col("_g") == F.col("_kg")) & (F.col("_b") == F.col("_kb")))
    return df.withColumn(out, F.least(low, F.col("_later"))).drop("_f", "_t", "_d", "_pi0", "_g", "_b", "_kg", "_kb", "_later")


def _portable(df: DataFrame) -> bool:
    """Whether all columns travel as Arrow."""
    try:
        return bool(to_arrow_schema(df.schema))
    except PySparkTypeError:
        return False


def _rates(labels: bytes, targets: int, decoys: int, pi0: float) -> np.ndarray:
    """The false discovery rate at each rank of a piece, after so many targets and decoys."""
    label = np.frombuffer(labels, np.int8)
    t, d = targets + np.cumsum(label > 0), decoys + np.cumsum(label < 0)
    return np.where(t > 0, np.minimum(pi0 * d / np.maximum(t, 1), 1.0), 1.0)


def _qvalues_of_pieces(df: DataFrame, rows: int, pi0: float, score: str, out: str) -> DataFrame:
    """qvalues() without keys: rows are shuffled once, to score ranges, and written as pieces of an Arrow batch each.

    What lies before and after a piece comes from a table with a row for each piece, so no row is shuffled again.
    """
    bounded_batches(df.sparkSession)
    best = [F.col(score).desc(), F.col("row_id").asc()]
    at = df.columns.index("label")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId()
        for k, own in enumerate(x for x in batches if x.num_rows):
            label = np.sign(own.column(at).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int8)
            cells = [b, k, int((label > 0).sum()), int((label < 0).sum()), label.tobytes(), ipc_bytes(own)]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["_b", "_k", "_t", "_d", "_labels", "_rows"])

    dealt = by_short_ids(df, lambda own, row_id: own.repartitionByRange(tasks_of(df, rows), F.col(score).desc(), row_id.asc()))
    dealt = dealt.sortWithinPartitions(*best)
    pieces = materialise(dealt.mapInArrow(packed, "_b long, _k long, _t long, _d long, _labels binary, _rows binary"), "pieces", "zstd")
    counts = {"_ut": F.col("_t"), "_ud": F.col("_d")}
    places = running_sum(pieces.select("_b", "_k", "_t", "_d"), counts, [], "_b", [F.col("_k")])
    places = places.select("_b", "_k", (F.col("_ut") - F.col("_t")).alias("_ut"), (F.col("_ud") - F.col("_d")).alias("_ud"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [_rates(r["_labels"], r["_ut"], r["_ud"], pi0).min() for r in b.select(["_labels", "_ut", "_ud"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_b", "_k", "_ut", "_ud")], pa.array(low, pa.float64())], names=["_b", "_k", "_ut", "_ud", "_m"])

    lows = pieces.select("_b", "_k", "_labels").join(F.broadcast(places), ["_b", "_k"])
    lows = materialise(lows.mapInArrow(least, "_b long, _k long, _ut long, _ud long, _m double"), "piece-lows")
    behind = Window.partitionBy("_b").orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = lows.groupBy("_b").agg(F.min("_m").alias("_m")).select("_b", F.min("_m").over(later).alias("_rest"))
    after = F.least(F.min("_m").over(behind), F.col("_rest"), F.lit(1.0))  # no rate is above 1
    places = lows.join(ranges, "_b").select("_b", "_k", "_ut", "_ud", after.alias("_after"))
    schema = StructType([f for f in df.schema.fields if f.name != out]).add(out, "double")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low = np.minimum.accumulate(_rates(r["_labels"], r["_ut"], r["_ud"], pi0)[::-1])[::-1]
                own = pa.ipc.open_stream(r["_rows"]).read_all()
                own = own.select([c for c in own.column_names if c != out])
                yield from own.append_column(out, pa.array(np.minimum(low, r["_after"]))).to_batches()

    return pieces.join(F.broadcast(places), ["_b", "_k"]).select("_labels", "_ut", "_ud", "_after", "_rows").mapInArrow(unpacked, schema)


def accepted(df: DataFrame, fdr: float = TEST_FDR, q: str = "q") -> DataFrame:
    """Targets with q strictly under the limit."""
    return df.where((F.col("label") > 0) & (F.col(q) < fdr))


def yield_at(fdr: float = TEST_FDR, q: str = "q") -> Column:
    """Aggregate: how many targets are accepted."""
    return F.count_if((F.col("label") > 0) & (F.col(q) < fdr))


@own_names
def yields_of(
    df: DataFrame, keys: Sequence[str], pi0: Column | float | None, fdr: float = TEST_FDR, score: str = "score", one_task: int = ONE_TASK
) -> DataFrame:
    """keys and n: how many targets of each group are accepted, without q-values.

    A rank's q-value is under the limit if a rate at it or a worse rank is, so all targets down to the last such rank
    are accepted, and one ordering is enough.
    """
    rows, _ = _counted(df, keys, score, pi0, one_task)
    passed = F.when(_fdr(F.col("_t"), F.col("_d"), F.col("_pi0")) < fdr, F.col("_t"))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(passed), F.lit(0)).alias("n"))


def yield_sweep(df: DataFrame, cuts: Sequence[float], q: str = "q") -> DataFrame:
    """cut and targets under it, all cuts in one pass."""
    counts = df.agg(*[yield_at(c, q).alias(f"y{k}") for k, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"y{k}").alias("targets")) for k, c in enumerate(cuts)])
    return counts.select(F.explode(rows).alias("r")).select("r.cut", "r.targets")


def pool(sums: Sequence[int], weights: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Non-decreasing least-squares fit of the means sums / weights: sum, weight and number of inputs of each level.

    The levels are the edges of the lower convex hull of the running sums, so fits of neighbouring stretches pool to the
    fit of both. Whole numbers are compared without rounding.
    """
    s: list[int] = []
    w: list[int] = []
    n: list[int] = []
    for x, y in zip(sums, weights, strict=True):
        k = 1
        while s and s[-1] * y >= x * w[-1]:
            x, y, k = s.pop() + x, w.pop() + y, k + n.pop()
        s.append(x), w.append(y), n.append(k)
    return s, w, n


def _hulls(ranked: DataFrame, highest: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The levels of the fit of each key over all its cells, and each cell's own, from rows (_key, _b, _r, label).

    A level is where it starts (_b, _r), its decoys and its rows. Hulls of fan_in neighbouring cells are merged at a
    time, so a task has a cell's rows, or what is left of so many hulls; a hull of n rows has about n ** (1 / 3) edges,
    n ** (2 / 3) at most.
    """
    schema = "_key string, _b int, _r long, _s long, _w long"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        s, w, n = pool((pdf["label"] < 0).astype(int).tolist(), [1] * len(pdf))
        return pd.DataFrame({"_key": pdf["_key"].iloc[0], "_b": pdf["_b"].iloc[0], "_r": np.cumsum([1, *n[:-1]]), "_s": s, "_w": w})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_b", "_r"]).reset_index(drop=True)
        s, w, n = pool(pdf["_s"].tolist(), pdf["_w"].tolist())
        starts = pdf.iloc[np.cumsum([0, *n[:-1]])]
        return pd.DataFrame({"_key": starts["_key"], "_b": starts["_b"], "_r": starts["_r"], "_s": s, "_w": w})

    own = levels = materialise(ranked.select("_key", "_b", "_r", "label").groupBy("_key", "_b").applyInPandas(first, schema), "levels")
    cells = 1
    while cells <= highest:
        cells *= fan_in
        node = F.floor(F.col("_b") / cells)
        levels = materialise(levels.groupBy("_key", node.alias("_node")).applyInPandas(merge, schema), "levels")
    return levels, own


@own_names
def peps(
    df: DataFrame, keys: Sequence[str] = (), pi0: Column | float | None = None, score: str = "score", out: str = "pep", fan_in: int = FAN_IN
) -> DataFrame:
    """Append the error probability: min(1, 2 * pi0 * isotonic fit of the decoy share along worsening score).

    The fit is the lower convex hull of the running number of decoys: that of each score range by itself, then merged.
    Rows with null keys are a group as others are.
    """
    df = df.withColumn("_key", key_of(keys))
    estimated = df.groupBy("_key").agg(pi0_of(F.col("label")).alias("_pi0")) if pi0 is None else None
    order = [F.col(score).desc(), F.col("row_id").asc()]
    df = in_order(df, order, df.count())
    cells = ["_key", "_b"]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)).cast("long"))
    levels, own = _hulls(ranked, df.agg(F.max("_b")).first()[0] or 0, fan_in)
    marks = levels.select(*cells, "_r", (F.col("_s") / F.col("_w")).alias("_fit"))
    # a level that began in an earlier cell is marked at the start of each further one
    last = marks.groupBy(*cells).agg(F.max_by("_fit", "_r").alias("_last"), F.min("_r").alias("_first"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = own.where("_r = 1").select(*cells).join(last, cells, "left").withColumn("_fit", F.last("_last", ignorenulls=True).over(before))
    carried = every.where("_first IS NULL OR _first > 1").select(*cells, F.lit(1).cast("long").alias("_r"), "_fit")
    marks = marks.unionByName(carried)
    if estimated is not None:
        marks = marks.join(estimated, "_key").withColumn("_fit", F.col("_fit") * F.col("_pi0")).drop("_pi0")
    rows = ranked.join(marks, [*cells, "_r"], "left")
    upto = Window.partitionBy(*cells).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    fit = F.last("_fit", ignorenulls=True).over(upto)
    if pi0 is not None:
        fit = fit * (F.lit(float(pi0)) if isinstance(pi0, (int, float)) else pi0)
    return rows.withColumn("_fit", fit).withColumn(out, F.least(F.lit(2.0) * F.col("_fit"), F.lit(1.0))).drop("_key", "_b", "_r", "_fit")


@own_names
def bayes_qvalues(df: DataFrame, keys: Sequence[str] = ("is_decoy",), pep: str = "pep", out: str = "q") -> DataFrame:
    """Append the mean error probability of all rows up to this one's, ties included, over rising probability.

    Sums and counts of each probability are summed up cell by cell; rows get those of their own.
    """
    per = df.groupBy(*keys, pep).agg(F.sum(pep).alias("_s"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_g", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    unsorted = materialise(per, "probabilities")
    per = in_order(unsorted, [F.col("_g"), F.col(pep)], unsorted.count())
    discard(unsorted)
    upto = running_sum(per, {"_us": F.col("_s"), "_un": F.col("_n")}, ["_g"], "_b", [F.col(pep)])
    upto = upto.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, pep)], (F.col("_us") / F.col("_un")).alias("_q"))
    rows = df.join(upto, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, pep)])
    return rows.withColumn(out, F.col("_q")).drop("_q", *[f"_k_{k}" for k in (*keys, pep)])
