"""Feature statistics over an array column `features`, one row for each feature and never a pass for each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import linear_score
from .blocks import Block, Blocks, accepting
from .names import own_names
from .targetdecoy import ONE_TASK, TEST_FDR, pi0_of, yields_of

LEAST_SD = 1e-12


def unpivoted(df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    return df.select(*keep, F.posexplode("features").alias("feature", "x"))


def width(df: DataFrame) -> int:
    row = df.select(F.size("features").alias("n")).limit(1).collect()
    return row[0]["n"] if row else 0


def feature_stats(df: DataFrame) -> DataFrame:
    """feature, mean and population standard deviation (1 for a constant), by one aggregation over columns."""
    n = width(df)
    stats = []
    for k in range(n):
        x = F.get("features", F.lit(k))
        stats += [F.avg(x).alias(f"m{k}"), F.stddev_pop(x).alias(f"s{k}")]
    if not n:
        return df.sparkSession.createDataFrame([], "feature int, mean double, sd double")
    rows = [F.struct(F.lit(k).alias("feature"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("sd")) for k in range(n)]
    out = df.agg(*stats).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("sd", F.when(F.col("sd") <= LEAST_SD, 1.0).otherwise(F.col("sd")))


def as_arrays(stats: DataFrame) -> DataFrame:
    """One row with arrays means and sds."""
    both = F.array_sort(F.collect_list(F.struct("feature", "mean", "sd")))
    return stats.agg(both.alias("b")).select(F.col("b.mean").alias("means"), F.col("b.sd").alias("sds"))


def label_correlation(df: DataFrame) -> DataFrame:
    """feature and its correlation with the label; the floor under the denominator makes it 0 for a constant."""
    long = unpivoted(df)
    y = F.col("label").cast("double")
    agg = long.groupBy("feature").agg(
        F.covar_pop("x", y).alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop(y).alias("sy")
    )
    sx = F.when(F.col("sx") <= LEAST_SD, 1.0).otherwise(F.col("sx"))
    sy = F.when(F.col("sy") <= LEAST_SD, 1.0).otherwise(F.col("sy"))
    return agg.select("feature", (F.col("c") / F.greatest(sx * sy, F.lit(LEAST_SD))).alias("correlation"))


def single_feature_yield(df: DataFrame, fdr: float = TEST_FDR, one_task: int = ONE_TASK) -> DataFrame:
    """feature, sign and how many targets that feature alone accepts; all features side by side.

    Tables whose rows, features and signs come to more than one_task are counted over blocks, where a row is written once
    whatever its features. Null and non-finite features have a place in Spark's order only, so such tables are ranked as
    rows of each feature and sign.
    """
    x = F.col("features")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n = width(df)
    row = df.agg(pi0_of(F.col("label")).alias("pi0"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or(F.coalesce(odd | (F.size(x) != n), F.lit(True))), F.lit(False)).alias("odd")).first()
    if row["rows"] * 2 * n > one_task and not row["odd"]:
        return _yields_by_counts(df, n, fdr)
    signs = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    long = unpivoted(df).select("*", signs).withColumn("score", F.col("x") * F.col("sign"))
    # each feature and sign has as many rows as the table
    return yields_of(long, ["feature", "sign"], row["pi0"], fdr, one_task=ONE_TASK * 2 * n)


def _yields_by_counts(df: DataFrame, n: int, fdr: float) -> DataFrame:
    blocks = Blocks(df.select("row_id", "label", F.lit(0).alias("fold"), F.col("features").cast("array<double>").alias("features")), 1)

    def ranked(feature: int, sign: int):
        def scorer(block: Block) -> tuple[np.ndarray, np.ndarray]:
            return -sign * block.x[:, feature], np.where(block.label > 0, 1, np.where(block.label < 0, 0, -1))

        return scorer

    both = [(k, s) for k in range(n) for s in (1, -1)]
    try:
        found = accepting(blocks, [ranked(*b) for b in both], fdr)
    finally:
        blocks.close()
    rows = [(k, s, cut.accepted) for (k, s), (cut, _) in zip(both, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature int, sign int, n long")


def rank_features(yields: DataFrame) -> DataFrame:
    """The better sign of each feature (+ on ties), in order of yield, then feature."""
    best = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("sign").desc())
    one = yields.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    return one.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "feature")))


def initial_direction(yields: DataFrame) -> DataFrame:
    """The one feature and sign that accepts most; the first feature, then +, on ties."""
    return yields.orderBy(F.col("n").desc(), F.col("feature").asc(), F.col("sign").desc()).limit(1)


def top_features(yields: DataFrame, k: int) -> DataFrame:
    return rank_features(yields).where(F.col("rank") <= k)


@own_names
def standardise_scores(df: DataFrame, train: Column, score: str = "score", out: str = "standard") -> DataFrame:
    """Score minus the mean, over the deviation, of training decoys; of all training rows with under two decoys."""
    decoy = train & (F.col("label") < 0)
    few = df.agg(
        F.count_if(decoy).alias("n"), F.avg(F.when(decoy, F.col(score))).alias("dm"), F.stddev_pop(F.when(decoy, F.col(score))).alias("ds"),
        F.avg(F.when(train, F.col(score))).alias("tm"), F.stddev_pop(F.when(train, F.col(score))).alias("ts"),
    )
    enough = F.col("n") >= 2
    few = few.select(F.when(enough, F.col("dm")).otherwise(F.col("tm")).alias("_m"), F.greatest(F.when(enough, F.col("ds")).otherwise(F.col("ts")), F.lit(LEAST_SD)).alias("_s"))
    return df.crossJoin(F.broadcast(few)).withColumn(out, (F.col(score) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def with_linear_score(df: DataFrame, weights: Sequence[float]) -> DataFrame:
    return df.withColumn("score", linear_score(F.col("features"), weights))
