"""The corpus pipeline: quality, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it back for the next. All but the last return the columns of documents; the last adds shard and slot.

Nulls and ties: a null text is an empty one in every stage. The classifier gives empty texts a score as any other. Of
documents that are empty, or alike in any other way, the one with the smallest doc_id stays, a null doc_id last; of rows
of one doc_id and text, the first by a hash of their other columns. Documents without benchmark words stay as they are,
and what is left of others has their n_chars counted anew. A null source is a source of its own. Each copy that the mix
takes is a row. Repeated rows are scored and cleaned each. An empty table gives an empty table with the same columns.
Columns beyond those of documents are carried along; the last stage replaces columns named shard and slot.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rescora.llm import decontam, mixing, quality, sharding, simhash
from rescora.session import materialise

FIELDS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 16
LEAST_SCORE = 0.5


def carried(stage):
    """The stage on tables with further columns, whatever their names: they are put aside by other names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in FIELDS}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


@carried
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of these documents, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model).where(f"score >= {LEAST_SCORE}").select(*docs.columns)


@carried
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


@carried
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that consist of them for the most part go."""
    cleaned = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    cleaned = decontam.mostly_clean(cleaned)
    # the table's own count of code points follows the text that is left
    return cleaned.selectExpr(*[f"if(n_hit > 0, char_length(text), {c}) AS {c}" if c == "n_chars" else c for c in docs.columns])


@carried
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the curriculum takes it, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(*docs.columns)


@carried
def _sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS).select(*docs.columns, "shard", "slot")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return _sharded(spark, docs.drop("shard", "slot"), sf_dir)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: Training a classifier isn't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
