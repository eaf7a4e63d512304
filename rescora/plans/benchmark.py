"""Runs over registered datasets: each file by itself, recorded with its yields, times and failures."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..operators.calibration import CUTS, entrapment
from ..operators.targetdecoy import yield_at
from ..sources import manifest, matches, results
from .params import Params
from .pipeline import proteins_accepted, rescore

FILE_KIND = "input string, ok boolean, wall_s double, rss_kb long, psms long, peptides long, proteins long, reason string"


def planned(spark: SparkSession, dataset: manifest.Dataset, p: Params, output: str, env: Mapping[str, str] | None = None) -> list[str]:
    """The commands that a run of the dataset amounts to, one for each file, without running or writing anything."""
    out = []
    for path in matches.discover(spark, [manifest.expand(dataset.pin_path, env)], dataset.file_count):
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        where = f"{output}/{name}"
        words = ["python", "-m", "rescora", "--seed", str(p.seed), "-m", f"{where}/target.psms", "-r", f"{where}/target.peptides"]
        words += ["-l", f"{where}/target.proteins"] if dataset.protein_level_evaluation else []
        out.append(manifest.command_line([*words, path], f"{where}/time.tsv"))
    return out


def run_dataset(
    spark: SparkSession, dataset: manifest.Dataset, p: Params, env: Mapping[str, str] | None = None, output: str | None = None
) -> tuple[DataFrame, dict]:
    """A row for each file, and the record of the run; with `output`, each file's results and its timing in a folder there.

    Files are separate inputs with models of their own, so they are separate runs; one that fails is recorded and the
    others go on. Totals are null unless all succeeded.
    """
    rows = []
    for path in matches.discover(spark, [manifest.expand(dataset.pin_path, env)], dataset.file_count):
        began = time.time()
        try:
            df, _ = matches.read_matches(spark, [path])
            run = rescore(df, p, infer_proteins=dataset.protein_level_evaluation)
            psms, peptides = (x.agg(yield_at(p.test_fdr)).first()[0] for x in (run.matches, run.peptides))
            groups = proteins_accepted(run.proteins, p.test_fdr) if run.proteins is not None else None
            if output:
                where = f"{output}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}"
                run.write(where)
            wall, rss = time.time() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            if output:
                results.write_line(spark, f"{wall:.2f}\t{rss}", f"{where}/time.tsv")
            row = (path, True, wall, rss, psms, peptides, groups, None)
        except Exception as e:  # recorded, not hidden: the run's totals are null then
            row = (path, False, None, None, None, None, None, str(e).splitlines()[0][:500])
        rows.append(row)
    files = spark.createDataFrame(rows, FILE_KIND)
    total = compare.totals(files).first()
    record = {
        "schema_version": 1, "benchmark_timestamp_unix_seconds": int(time.time()), "dataset_id": dataset.id, "implementation": "rescora",
        "random_seed": p.seed, "wall_seconds": total["wall_s"], "peak_rss_kb": total["rss_kb"], "files_attempted": len(rows),
        "files_successful": sum(r[1] for r in rows), "psms_q_lt_0_01": total["psms"], "peptides_q_lt_0_01": total["peptides"], "proteins_q_lt_0_01": sum(r[6] for r in rows) if rows and all(r[6] is not None for r in rows) else None,
        "failed_files": [{"input": r[0], "exit_status": 1, "reason": r[7]} for r in rows if not r[1]],
        "per_file_results": [
            {"input": r[0], "exit_status": 0 if r[1] else 1, "wall_seconds": r[2], "peak_rss_kb": r[3], "psms_q_lt_0_01": r[4], "peptides_q_lt_0_01": r[5], "proteins_q_lt_0_01": r[6], "failure": r[7]}
            for r in rows
        ],
    }
    return files, record


def write_run(files: DataFrame, record: dict, path: str) -> None:
    """IMPLEMENTATION-result.json, per-file, summary and failures tables under a folder."""
    results.write_line(files.sparkSession, json.dumps(record, indent=2), f"{path}/{record['implementation']}-result.json")
    results.write_summary(files, f"{path}/files.tsv")
    results.write_summary(compare.totals(files), f"{path}/summary.tsv")
    results.write_summary(files.where("NOT ok").select("input", "reason"), f"{path}/failures.tsv")


def recorded_files(run: DataFrame) -> DataFrame:
    """A recorded run's files as rows for comparison."""
    rows = run.select(F.explode("per_file_results").alias("r"))
    return rows.select(
        F.element_at(F.split("r.input", "/"), -1).alias("input"), F.col("r.failure").isNull().alias("ok"), F.col("r.wall_seconds").alias("wall_s"),
        F.col("r.peak_rss_kb").alias("rss_kb"), F.col("r.psms_q_lt_0_01").alias("psms"), F.col("r.peptides_q_lt_0_01").alias("peptides"),
    )


def entrapment_report(spark: SparkSession, targets: list[str], fraction: float, cuts: Sequence[float] = CUTS) -> DataFrame:
    """False discovery proportions by method and limit, from target result files and the decoy files beside them.

    A method's files are pooled; its name is theirs up to the first dot. `fraction` is the foreign part of the searched
    residues, for limits that no decoy passes.
    """
    tables = []
    for path in targets:
        both = [(path, 1)]
        if (decoys := results.decoy_path(path)) != path and results.exists(spark, decoys):
            both.append((decoys, -1))
        for p, label in both:
            rows = results.entrapment_class(results.read_match_results(spark, p), decoy=label < 0)
            tables.append(rows.select(F.lit(results.method_of(path)).alias("method"), F.lit(label).alias("label"), "q", F.col("pure").alias("foreign"), "mixed"))
    return entrapment(reduce(DataFrame.unionByName, tables), cuts, fraction)


def compare_runs(spark: SparkSession, candidate: str, baseline: str) -> DataFrame:
    """Two recorded runs of one dataset and seed compared; others are an error."""
    a, b = (results.read_runs(spark, p) for p in (candidate, baseline))
    for column in ("schema_version", "dataset_id", "random_seed"):
        x, y = a.first()[column], b.first()[column]
        if x != y:
            raise ValueError(f"the runs differ in {column}: {x} and {y}")
    return compare.compare(recorded_files(a), recorded_files(b))
