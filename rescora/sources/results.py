"""Result tables, run records and reports as files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed, split_proteins
from .lines import write_ordered

# The columns of result files and the fields of run records.
MATCH_COLUMNS = ("PSMId", "score", "q-value", "posterior_error_prob", "peptide", "proteinIds")
PROTEIN_COLUMNS = ("ProteinGroupId", "q-value", "posterior_error_prob", "score", "numPeptides", "proteinIds")

RUN_SCHEMA = (
    "schema_version int, benchmark_timestamp_unix_seconds long, dataset_id string, implementation string, random_seed long, wall_seconds double,"
    " peak_rss_kb long, files_attempted int, files_successful int, psms_q_lt_0_01 long, peptides_q_lt_0_01 long, proteins_q_lt_0_01 long,"
    " failed_files array<struct<input string, exit_status int, reason string>>,"
    " per_file_results array<struct<input string, exit_status int, wall_seconds double, peak_rss_kb long, psms_q_lt_0_01 long, peptides_q_lt_0_01 long, proteins_q_lt_0_01 long, failure string>>"
)


def _text(df: DataFrame, header: str, fields: list[Column], order: list[Column], path: str, one_file: bool) -> None:
    """Lines in order under one header; names may hold raw tabs, so lines are put together here.

    One file, joined from its parts when all are written, or a folder of parts with the header in the first.
    """
    rows = df.select(F.lit(1).alias("k"), F.concat_ws("\t", *fields).alias("value"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    keys = ["k", *[F.col(f"o{i}") for i in range(len(order))]]
    if one_file:
        write_ordered(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), path, header)
        return
    top = df.sparkSession.createDataFrame([(0, header)], "k int, value string")
    for i, (name, kind) in enumerate(rows.dtypes[2:]):
        top = top.withColumn(f"o{i}", F.lit(None).cast(kind))
    both = top.unionByName(rows)
    both.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.text(path)


def write_match_results(df: DataFrame, path: str, one_file: bool = False) -> None:
    """spec_id, score, q, pep, peptide and proteins by falling score."""
    fields = [F.col("spec_id"), *[fixed(F.col(c), 6) for c in ("score", "q", "pep")], F.col("peptide"), F.col("proteins")]
    _text(df, "\t".join(MATCH_COLUMNS), fields, [-F.col("score"), F.col("row_id")], path, one_file)


def write_protein_results(groups: DataFrame, path: str, decoys: bool = False, one_file: bool = False) -> None:
    """Picked groups of one polarity by falling score."""
    rows = groups.where(F.col("picked") & (F.col("is_decoy") == decoys))
    fields = [F.get("proteins", F.lit(0)), *[fixed(F.col(c), 6) for c in ("q", "pep", "score")], F.col("n_peptides").cast("string"), F.array_join("proteins", ",")]
    _text(rows, "\t".join(PROTEIN_COLUMNS), fields, [-F.col("score"), F.array_join("proteins", ",")], path, one_file)


def feature_report_lines(report: DataFrame, names: list[str]) -> list[str]:
    """The report as text; it has a line for each feature, so the driver puts it together."""
    rows = report.orderBy("feature").collect()
    head = [
        "# feature report 1",
        "# linear model; weights are means over the held-out folds' models",
        f"# baseline targets under the limit: {rows[0]['baseline_yield'] if rows else 0}",
        "# permutation within held-out folds, models held fixed",
    ]
    columns = ["feature", "raw_weight", "raw_sd", "weight", "weight_sd", "correlation", "mean", "sd", "selected_folds", "yield_drop", "permuted_yield"]
    lines = [*head, "\t".join(["index", *columns])]
    for r in rows:
        numbers = [f"{r[c]:.8f}" for c in columns[1:8]] + [str(r[c]) for c in columns[8:]]
        lines.append("\t".join([str(r["feature"]), names[r["feature"]], *numbers]))
    return lines


def read_match_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with a typed q-value; protein fields beyond the header belong to the last column.

    A file without a q-value column, or with one that isn't a number, is an error.
    """
    header = spark.read.text(path).first()
    columns = header["value"].split("\t") if header else []
    if "q-value" not in columns:
        raise ValueError(f"no q-value column in {path}")
    f = F.split("value", "\t", -1)
    n = len(columns)
    rows = spark.read.text(path).where(F.col("value") != header["value"]).where("value <> ''").select(F.col("_metadata.file_path").alias("file"), f.alias("f"))
    named = [F.get("f", F.lit(k)).alias(c) for k, c in enumerate(columns[:-1])]
    tail = F.array_join(F.slice("f", n, F.greatest(F.size("f") - n + 1, F.lit(0))), "\t").alias(columns[-1])
    return rows.select("file", *named, tail).withColumn("q-value", F.col("q-value").cast("double"))


def count_accepted(results: DataFrame, limit: float = 0.01) -> DataFrame:
    """Rows strictly under the limit by file."""
    return results.groupBy("file").agg(F.count_if(F.col("q-value") < limit).alias("accepted"))


def entrapment_class(results: DataFrame, decoy: bool = False) -> DataFrame:
    """q, pure (only foreign proteins) and mixed for each result row."""
    names = split_proteins(F.replace(F.col("proteinIds"), F.lit(";"), F.lit("\t")))
    if decoy:
        names = F.transform(names, lambda p: F.regexp_replace(p, "^(DECOY_|decoy_)", ""))
    rows = results.select(F.col("q-value").alias("q"), names.alias("p"))
    foreign = F.filter("p", lambda p: p.startswith("ENT_"))
    pure = (F.size("p") > 0) & (F.size(foreign) == F.size("p"))
    return rows.select("q", pure.alias("pure"), ((F.size(foreign) > 0) & ~pure).alias("mixed"))


def decoy_path(path: str) -> str:
    """Where the decoys of a target result file lie; the same path if it isn't named as one."""
    return path.replace(".target.psms.tsv", ".decoy.psms.tsv")


def method_of(path: str) -> str:
    """The method that a result file is of: its name up to the first dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def write_entrapment(report: DataFrame, path: str) -> None:
    """The entrapment report, tab-separated, by method and limit."""
    # fixed values
    names = ("method", "q_threshold", "accepted_targets", "pure_entrapment", "mixed", "effective_entrapment_fraction", "adjusted_fdp", "fdp_ci95_low", "fdp_ci95_high")
    report.select("method", "cut", "accepted", "foreign", "mixed", "foreign_share", "fdp", "fdp_low", "fdp_high").toDF(*names).orderBy("method", "q_threshold").coalesce(1).write.csv(path, sep="\t", header=True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Recorded runs; anything malformed is an error."""
    return spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def run_json(row) -> str:
    """A run as JSON with explicit nulls."""
    return json.dumps(row.asDict(recursive=True), indent=2)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_line(spark: SparkSession, text: str, path: str) -> None:
    """A small file, in any store that Spark writes to; an existing one is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray((text + "\n").encode()))
    finally:
        out.close()


def write_once(df: DataFrame, path: str) -> None:
    """JSON with explicit nulls; an existing path is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Tab-separated, NA for what is missing."""
    shown = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in df.columns])
    shown.coalesce(1).write.csv(path, sep="\t", header=True)
