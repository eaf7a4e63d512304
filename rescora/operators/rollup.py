"""Best row of each group, engine agreement, and pooling of runs and engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import core_peptide, one_hot
from .names import own_names
from .ordering import by_short_ids, dealt_out, in_order, running_sum, tasks_of
from .targetdecoy import yield_at

#: What tells candidates apart.
CANDIDATE = ["scan", "label", "peptide"]
#: Rows beyond which one task doesn't count engines.
HOT_ROWS = 1_000_000


@own_names
def best_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the highest score of each key, the first by row_id on ties."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("row_id").asc())
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_psm_of_peptide(df: DataFrame) -> DataFrame:
    """One row for each label and core peptide."""
    return best_of(df.withColumn("core", core_peptide(F.col("peptide"))), ["label", "core"])


def best_report_of_candidate(df: DataFrame) -> DataFrame:
    """One row for each spectrum, label and peptide as reported."""
    return best_of(df, ["scan", "label", "peptide"])


@own_names
def engine_support(df: DataFrame) -> DataFrame:
    """Append how many engines report the spectrum, and the candidate. A null source is no engine; null keys are groups.

    Rows are dealt out by spectrum once, about CELL_ROWS to a task, and counted in windows. Spectra of tasks that would
    get more than HOT_ROWS are counted by aggregates and joined instead, so that no hot one is a task's.
    """
    n = tasks_of(df, df.count())
    part = F.pmod(F.hash("scan"), F.lit(n))  # as repartition() deals
    hot = [r["_part"] for r in df.groupBy(part.alias("_part")).count().where(F.col("count") > HOT_ROWS).collect()]
    if not hot:
        return _counted_in_windows(df, n)
    return _counted_in_windows(df.where(~part.isin(hot)), n).unionByName(_counted_by_joins(df.where(part.isin(hot))))


def _counted_in_windows(df: DataFrame, n: int) -> DataFrame:
    own = {"candidate_engines": CANDIDATE, "scan_engines": ["scan"]}  # in this order one sort does for both

    def counted(rows: DataFrame, _) -> DataFrame:
        rows = dealt_out(rows, n, "scan")
        for name, keys in own.items():
            rows = rows.withColumn(name, F.size(F.collect_set("source").over(Window.partitionBy(*keys))).cast("long"))
        return rows

    return by_short_ids(df, counted).select(*df.columns, *reversed(own))


def _counted_by_joins(df: DataFrame) -> DataFrame:
    reports = df.select(*CANDIDATE, "source").distinct()
    candidates = reports.groupBy(*CANDIDATE).agg(F.count("source").alias("candidate_engines"))
    spectra = reports.select("scan", "source").distinct().groupBy("scan").agg(F.count("source").alias("scan_engines"))
    for found, own in ((spectra, ["scan"]), (candidates, CANDIDATE)):
        found = found.withColumnsRenamed({k: f"_k_{k}" for k in own})
        df = df.join(found, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in own]).drop(*[f"_k_{k}" for k in own])
    return df


def join_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """All runs together; columns are matched by name and must agree."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def join_engines(df: DataFrame, engines: Sequence[str], widths: dict[str, int]) -> DataFrame:
    """Features as engine marks, one block for each engine (zeros for others), then the two agreement counts."""
    df = engine_support(df)
    blocks = [
        F.when(F.col("source") == e, F.col("features")).otherwise(F.array_repeat(F.lit(0.0), widths[e])) for e in engines
    ]
    agreement = F.array(F.col("scan_engines").cast("double"), F.col("candidate_engines").cast("double"))
    features = F.concat(one_hot(F.col("source"), engines), *blocks, agreement)
    return df.withColumn("features", features).drop("scan_engines", "candidate_engines")


def yield_of_sources(df: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Accepted targets by source; a source without any has 0."""
    return df.groupBy("source").agg(yield_at(fdr).alias("accepted"))


@own_names
def interleaved_by_size(df: DataFrame, size: str = "size", name: str = "name") -> DataFrame:
    """Largest, smallest, second largest, ...: position 1 on."""
    n = df.count()
    order = [F.col(size).desc(), F.col(name)]
    rows = running_sum(in_order(df, order, n), {"_d": F.lit(1).cast("long")}, [], "_b", order)
    first = F.col("_d") * 2 - 1
    place = F.when(first <= n, first).otherwise((F.lit(n) - F.col("_d") + 1) * 2)
    return rows.withColumn("position", place).drop("_d", "_b")
