"""Comparison of two recorded runs over the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_change, ratio


def per_input(candidate: DataFrame, baseline: DataFrame, count: str = "psms") -> DataFrame:
    """input, both counts and candidate minus baseline, for the inputs of both."""
    a = candidate.select("input", F.col(count).alias("candidate"))
    b = baseline.select("input", F.col(count).alias("baseline"))
    return a.join(b, "input").withColumn("difference", F.col("candidate") - F.col("baseline"))


def unmatched_inputs(candidate: DataFrame, baseline: DataFrame, most: int = 3) -> DataFrame:
    """The first inputs that only one run has."""
    a = candidate.select("input").distinct().join(baseline.select("input").distinct(), "input", "left_anti")
    b = baseline.select("input").distinct().join(candidate.select("input").distinct(), "input", "left_anti")
    sides = [x.orderBy("input").limit(most).withColumn("only_in", F.lit(s)) for x, s in ((a, "candidate"), (b, "baseline"))]
    return sides[0].unionByName(sides[1])


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def differences(rows: DataFrame) -> DataFrame:
    """One row: wins, ties, losses, median difference, the worst loss and the best gain (null for none)."""
    d = F.col("difference")
    return rows.agg(
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"),
        F.median(d).alias("median_difference"), F.min(F.when(d < 0, d)).alias("worst"), F.max(F.when(d > 0, d)).alias("best"),
    )


def lower_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the middle of the repeats; the lower of the two middle ones for an even number."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias(value))


def totals(files: DataFrame) -> DataFrame:
    """Sums of a run, null unless every file succeeded; the largest memory of those that have one."""
    every = F.bool_and("ok")
    return files.agg(
        F.when(every, F.sum("wall_s")).alias("wall_s"), F.when(every, F.sum("psms")).alias("psms"),
        F.when(every, F.sum("peptides")).alias("peptides"), F.max("rss_kb").alias("rss_kb"), F.count_if(~F.col("ok")).alias("failed"),
    )


def compare(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: speed-up, memory ratio, changes of yields in percent, and the differences over inputs.

    Runs must have the same inputs, each once.
    """
    for name, df in (("candidate", candidate), ("baseline", baseline)):
        twice = [r["input"] for r in duplicates(df, "input").limit(3).collect()]
        if twice:
            raise ValueError(f"{name} has inputs twice: {', '.join(twice)}")
    odd = unmatched_inputs(candidate, baseline).collect()
    if odd:
        raise ValueError("inputs of one run only: " + ", ".join(f"{r['input']} ({r['only_in']})" for r in odd))
    a, b = (totals(x).select(*[F.col(c).alias(f"{c}_{s}") for c in ("wall_s", "psms", "peptides", "rss_kb")]) for x, s in ((candidate, "a"), (baseline, "b")))
    both = a.crossJoin(b).select(
        ratio(F.col("wall_s_b"), F.col("wall_s_a")).alias("speed_up"), ratio(F.col("rss_kb_a"), F.col("rss_kb_b")).alias("memory_ratio"),
        percent_change(F.col("psms_a"), F.col("psms_b")).alias("psm_change"), percent_change(F.col("peptides_a"), F.col("peptides_b")).alias("peptide_change"),
    )
    return both.crossJoin(differences(per_input(candidate, baseline)))
