"""Match tables over the driver's tables. Expressions are such that any SQL engine gives the same values."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as matches: half decoys by hash, a quarter targets with a planted signal."""
    h = F.md5(F.concat(F.lit("psm:"), F.col("event_id").cast("string")))
    digit = F.substring(h, 1, 1)
    label = F.when(digit.isin(*"01234567"), -1).otherwise(1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        label.alias("label"),
        (F.col("value") + F.when(digit.isin(*"89ab"), 300).otherwise(0)).alias("score"),
        F.col("user_id").cast("long").alias("scan"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("K."), F.upper("event_type"), F.col("user_id").cast("string"), F.lit(".R")).alias("peptide"),
        F.concat(F.when(label < 0, "DECOY_").otherwise(""), F.lit("P"), (F.col("user_id") % 37).cast("string")).alias("proteins"),
    )


def _line_key() -> Column:
    """Lines have no unique number; six columns together tell them apart."""
    names = [F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    price = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    return F.md5(F.concat_ws("|", *names, F.date_format("l_shipdate", "yyyy-MM-dd"), price))


def psm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as matches of three engines with four features; row_id is a text key."""
    return table(spark, sf_dir, "lineitem").select(
        _line_key().alias("row_id"),
        F.when(F.col("l_linestatus") == "O", -1).otherwise(1).alias("label"),
        F.col("l_returnflag").alias("source"),
        F.col("l_orderkey").cast("long").alias("scan"),
        F.col("l_partkey").cast("string").alias("peptide"),
        F.col("l_extendedprice").cast("double").alias("score"),
        F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("features"),
    )


def psm_emb(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    """embeddings as matches with 64 features; planted: one more that half the targets stand out in."""
    label = F.when(F.col("label") < 5, 1).otherwise(-1)
    x = F.col("embedding").cast("array<double>")
    if planted:
        x = F.concat(x, F.array(F.when((F.col("label") < 5) & (F.col("vec_id") % 2 == 0), 5.0).otherwise(0.0)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), label.alias("label"), x.alias("features"))


def psm_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as matches: the whole text, a-z in capitals, is the sequence."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"),
        F.col("doc_id").alias("scan"), "source",
        F.translate(F.coalesce("text", F.lit("")), ascii_lowercase, ascii_uppercase).alias("peptide"),
    )


def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as peptide-level entries: a line's order is its protein, and large lines share the next order's.

    Lines of suppliers with odd numbers are decoys of the same orders.
    """
    prefix = F.when(F.col("l_suppkey") % 2 == 1, "DECOY_").otherwise("")
    own = F.concat(prefix, F.lit("O"), F.col("l_orderkey").cast("string"))
    next_ = F.concat(prefix, F.lit("O"), (F.col("l_orderkey") + 1).cast("string"))
    base = table(spark, sf_dir, "lineitem")
    return base.select(
        _line_key().alias("row_id"),
        F.col("l_extendedprice").cast("double").alias("score"),
        (1 / (1 + F.col("l_extendedprice").cast("double") / 5000)).alias("pep"),
        F.concat_ws(";", own, F.when(F.col("l_quantity") >= 49, next_)).alias("proteins"),
    )


# The same views as SQL, for the oracles.
_ROW = "md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, strftime(l_shipdate, '%Y-%m-%d'), CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR))"
SQL = {
    "psm_events": """
  SELECT event_id AS row_id, substr(md5('psm:' || event_id), 1, 1) AS digit,
    CASE WHEN digit IN ('0','1','2','3','4','5','6','7') THEN -1 ELSE 1 END AS label,
    value + CASE WHEN digit IN ('8','9','a','b') THEN 300 ELSE 0 END AS score, CAST(user_id AS BIGINT) AS scan, event_type AS source,
    'K.' || upper(event_type) || user_id || '.R' AS peptide, CASE WHEN label < 0 THEN 'DECOY_' ELSE '' END || 'P' || (user_id % 37) AS proteins
  FROM events""",
    "psm_lines": f"""
  SELECT {_ROW} AS row_id, CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END AS label, l_returnflag AS source, CAST(l_orderkey AS BIGINT) AS scan,
    l_partkey::VARCHAR AS peptide, l_extendedprice::DOUBLE AS score,
    [l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS features
  FROM lineitem""",
    "psm_emb": """
  SELECT CAST(vec_id AS BIGINT) AS row_id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS label, embedding::DOUBLE[] AS features FROM embeddings""",
    "psm_docs": f"""
  SELECT d.doc_id AS row_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label, d.doc_id AS scan, source,
    translate(coalesce(text, ''), '{ascii_lowercase}', '{ascii_uppercase}') AS peptide
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "graph_lines": f"""
  SELECT {_ROW} AS row_id, l_extendedprice::DOUBLE AS score, 1 / (1 + l_extendedprice::DOUBLE / 5000) AS pep,
    CASE WHEN l_suppkey % 2 = 1 THEN 'DECOY_' ELSE '' END || 'O' || l_orderkey
      || CASE WHEN l_quantity >= 49 THEN ';' || CASE WHEN l_suppkey % 2 = 1 THEN 'DECOY_' ELSE '' END || 'O' || (l_orderkey + 1) ELSE '' END AS proteins
  FROM lineitem""",
}
