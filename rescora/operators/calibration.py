"""Calibration: null relabelling, entrapment false discovery proportions, residue budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import drawn
from .names import own_names
from .ordering import in_order, running_sum
from .targetdecoy import qvalues, yield_at

# The limits that reports use, and the normal quantile of a 95 % interval.
CUTS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1)
Z = 1.959963984540054


def null_relabelled(df: DataFrame, seed: int = 1) -> DataFrame:
    """Decoys only, half of them, by draw, as targets: no target is right."""
    half = F.substring(drawn(seed, "null", F.col("row_id")), 1, 1).isin(*"89abcdef")
    return df.where(F.col("label") < 0).withColumn("label", F.when(half, 1).otherwise(-1))


def null_yield(df: DataFrame, fdr: float = 0.01, seed: int = 1) -> DataFrame:
    """How many wrong targets pass."""
    return qvalues(null_relabelled(df, seed)).agg(F.count(F.lit(1)).alias("rows"), yield_at(fdr).alias("accepted"))


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """Interval of a proportion; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p, zz = F.try_divide(k, n), F.lit(z * z)
    middle = p + F.try_divide(zz, 2 * n)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(zz, 4 * n * n))
    scale = 1 + F.try_divide(zz, n)
    return F.struct(F.try_divide(middle - half, scale).alias("low"), F.try_divide(middle + half, scale).alias("high"))


def entrapment(df: DataFrame, cuts: Sequence[float] = CUTS, fraction: float | None = None) -> DataFrame:
    """By method and cut (q at most the cut): accepted, foreign, mixed, and the false discovery proportion with its interval.

    Foreign targets are certainly wrong; the share of passing decoys that are foreign, those with mixed proteins left
    out, estimates how much of the wrong matches they are, so the proportion is foreign / accepted / that share. Without
    such decoys the share is `fraction`, the foreign part of the searched residues; null if that isn't given. Without
    accepted targets the proportion is 0. Columns mixed and method may be missing; all rows are one method then, named "".
    """
    if "mixed" not in df.columns:
        df = df.withColumn("mixed", F.lit(False))
    if "method" not in df.columns:
        df = df.withColumn("method", F.lit(""))
    target, foreign, mixed = F.col("label") > 0, F.col("foreign"), F.col("mixed")
    counts = []
    for k, c in enumerate(cuts):
        here = F.col("q") <= float(c)
        counts += [
            F.count_if(here & x).alias(f"{n}{k}")
            for n, x in (("a", target), ("f", target & foreign), ("m", target & mixed), ("d", ~target & ~mixed), ("e", ~target & ~mixed & foreign))
        ]
    rows = [
        F.struct(F.lit(float(c)).alias("cut"), *[F.col(f"{n}{k}").alias(name) for n, name in (("a", "accepted"), ("f", "foreign"), ("m", "mixed"), ("d", "decoys"), ("e", "foreign_decoys"))])
        for k, c in enumerate(cuts)
    ]
    agg = df.groupBy("method").agg(*counts).select("method", F.explode(F.array(*rows)).alias("r")).select("method", "r.*")
    share = F.when(F.col("decoys") > 0, F.col("foreign_decoys") / F.col("decoys")).otherwise(F.lit(fraction).cast("double"))
    bounds = wilson(F.col("foreign"), F.col("accepted"))
    none = F.col("accepted") == 0
    scaled = lambda x: F.when(none, 0.0).otherwise(F.try_divide(x, F.col("foreign_share")))
    return agg.withColumn("foreign_share", share).select(
        "method", "cut", "accepted", "foreign", "mixed", "foreign_share",
        scaled(F.try_divide(F.col("foreign").cast("double"), F.col("accepted").cast("double"))).alias("fdp"),
        scaled(F.greatest(bounds["low"], F.lit(0.0))).alias("fdp_low"), scaled(F.least(bounds["high"], F.lit(1.0))).alias("fdp_high"),
    )


@own_names
def residue_budget(foreign: DataFrame, budget: int, order: Sequence[Column]) -> DataFrame:
    """Sequences in order until their residues reach the budget; the one that reaches it is taken.

    `order` ends in a key; columns, or their names.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = in_order(foreign, order, foreign.count())
    rows = running_sum(rows, {"_upto": F.length("sequence").cast("long")}, [], "_b", order)
    return rows.where(F.col("_upto") - F.length("sequence") < budget).drop("_upto", "_b")
