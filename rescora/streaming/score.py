"""Scoring of match streams with a fixed model.

q-values are statistics of a whole ranking, so a stream carries scores, and accepted matches are those above the score
that a finished run accepts from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_score


def with_fixed_model(stream: DataFrame, weights: Sequence[float], means: Sequence[float], sds: Sequence[float]) -> DataFrame:
    """Append score; a plain expression, so batches and streams share it."""
    raw = [w / s for w, s in zip(weights, sds, strict=False)]
    bias = (weights[len(sds)] if len(weights) > len(sds) else 0.0) - sum(w * m for w, m in zip(raw, means, strict=True))
    return stream.withColumn("score", linear_score(F.col("features"), raw) + F.lit(float(bias)))


def accepting_score(finished: DataFrame, fdr: float = 0.01) -> float | None:
    """The lowest score of an accepted target in a finished run."""
    return finished.where((F.col("label") > 0) & (F.col("q") < fdr)).agg(F.min("score")).first()[0]


def accepted_stream(scored: DataFrame, least: float) -> DataFrame:
    return scored.where((F.col("label") > 0) & (F.col("score") >= least))
