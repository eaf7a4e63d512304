"""Retention-time features: a linear fit of the scan number on predicted hydrophobicity, for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import retention
from .names import own_names


def line_fit(x: Column, y: Column, use: Column) -> Column:
    """Aggregate: struct of slope and intercept over the rows in use; (1, 0) for under two, (0, mean y) for no spread."""
    x, y = F.when(use, x), F.when(use, y)
    n = F.count_if(use).cast("double")
    # in central moments, which are exactly 0 for equal values
    spread = n * n * F.var_pop(x)
    flat = F.coalesce(spread < 1e-9, F.lit(True))
    slope = F.when(n < 2, 1.0).when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.var_pop(x)))
    intercept = F.when(n < 2, 0.0).otherwise(F.avg(y) - slope * F.avg(x))
    return F.struct(slope.alias("slope"), intercept.alias("intercept"))


def fits(df: DataFrame) -> DataFrame:
    """source, slope and intercept: fitted on targets, or on all rows of a source without targets."""
    df = df.select("source", "label", retention(F.col("peptide")).alias("x"), F.col("scan").cast("double").alias("y"))
    target = F.col("label") > 0
    agg = df.groupBy("source").agg(
        line_fit(F.col("x"), F.col("y"), target).alias("t"), line_fit(F.col("x"), F.col("y"), F.lit(True)).alias("a"), F.count_if(target).alias("n")
    )
    pick = F.when(F.col("n") > 0, F.col("t")).otherwise(F.col("a"))
    return agg.select("source", pick["slope"].alias("slope"), pick["intercept"].alias("intercept"))


@own_names
def with_retention(df: DataFrame) -> DataFrame:
    """Append rt_predicted, rt_abs_error and rt_sq_error; fitted for each source by itself."""
    fit = fits(df).select(F.col("source").alias("_source"), F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    out = df.join(fit, F.col("source").eqNullSafe(F.col("_source")))
    expected = F.col("_slope") * retention(F.col("peptide")) + F.col("_intercept")
    out = out.withColumn("rt_predicted", expected).drop("_slope", "_intercept", "_source")
    off = F.col("scan").cast("double") - F.col("rt_predicted")
    return out.withColumns({"rt_abs_error": F.abs(off), "rt_sq_error": off * off})
