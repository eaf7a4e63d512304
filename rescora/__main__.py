"""Command line: python -m rescora [flags] inputs...

First words for other work: compare, manifests, dataset (runs a registered dataset) and entrapment (its report).
"""

from __future__ import annotations

import argparse
import json
import sys

from .plans.params import PROFILES, Params

#: Result files: flags, attribute, and what they hold.
OUTPUTS = (
    (("-m", "--results-psms"), "matches", False), (("-M", "--decoy-results-psms"), "matches", True), (("-r", "--results-peptides"), "peptides", False),
    (("-B", "--decoy-results-peptides"), "peptides", True), (("-l", "--results-proteins"), "proteins", False), (("-L", "--decoy-results-proteins"), "proteins", True),
)


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="rescora", allow_abbrev=False)
    a.add_argument("inputs", nargs="+", help="match files, or ENGINE=FILE with --ensemble")
    for flags, _, _ in OUTPUTS:
        a.add_argument(*flags)
    a.add_argument("--feature-report")
    a.add_argument("--protein-inference", default="picked", choices=("picked", "bayesian", "fido"))
    for name, value in (("alpha", 0.1), ("beta", 0.01), ("gamma", 0.5), ("peptide-prior", 0.1)):
        a.add_argument(f"--protein-{name}", type=float, default=value)
    a.add_argument("--protein-max-iter", type=int, default=200)
    a.add_argument("--rescore-model", "--model", default="svm", choices=("svm", "linear", "mlp", "neural"))
    a.add_argument("--mlp-hidden", type=int, default=8)
    a.add_argument("--mlp-epochs", type=int, default=10)
    a.add_argument("--mlp-learning-rate", type=float, default=0.02)
    a.add_argument("--mlp-l2", type=float, default=0.0)
    a.add_argument("--auto-model", "--nested-select", dest="nested", action=argparse.BooleanOptionalAction, default=False)
    a.add_argument("--svm-tolerance", type=float, default=1e-5)
    a.add_argument("--join", action="store_true")
    a.add_argument("--ensemble", action="store_true")
    a.add_argument("--rt-features", action="store_true")
    a.add_argument("--seed", type=int, default=1)
    a.add_argument("--maxiter", type=int)
    a.add_argument("-N", "--subset-max-train", type=int)
    a.add_argument("--cpos", type=float)
    a.add_argument("--cneg", type=float)
    a.add_argument("--select-c", action=argparse.BooleanOptionalAction, default=False)
    a.add_argument("--num-threads", type=int, default=1, help="local threads; a cluster's master overrides it")
    a.add_argument("--profile", default="canonical", choices=PROFILES)
    for name in PROFILES:
        a.add_argument(f"--{name}", dest="profile", action="store_const", const=name)
    return a


def dataset_parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="rescora dataset", allow_abbrev=False)
    a.add_argument("--manifest", default="bench/datasets.toml", help="registry of datasets")
    a.add_argument("--dataset", required=True)
    a.add_argument("--output", required=True, help="folder for the run's records and results")
    a.add_argument("--profile", default="canonical", choices=PROFILES)
    a.add_argument("--seed", type=int, default=1)
    a.add_argument("--dry-run", action="store_true", help="print the commands only")
    return a


def settings(a: argparse.Namespace) -> Params:
    own = {
        "model": a.rescore_model, "seed": a.seed, "tolerance": a.svm_tolerance, "select_c": a.select_c, "nested": a.nested, "join": a.join, "ensemble": a.ensemble,
        "rt_features": a.rt_features, "mlp_hidden": a.mlp_hidden, "mlp_epochs": a.mlp_epochs, "mlp_rate": a.mlp_learning_rate, "mlp_l2": a.mlp_l2,
        "protein_inference": a.protein_inference,
    }
    own |= {k: v for k, v in (("max_iter", a.maxiter), ("cap", a.subset_max_train), ("positive_weight", a.cpos), ("negative_weight", a.cneg)) if v is not None}
    pinned = a.cpos is not None or a.cneg is not None
    if pinned:
        own["select_c"] = False
    p = Params.of(a.profile, **own)
    p.check(bool(a.feature_report), bool(a.results_proteins or a.decoy_results_proteins), pinned)
    if len(a.inputs) > 1 and not (p.join or p.ensemble):
        raise ValueError("several inputs need --join or --ensemble")
    if p.ensemble and not all("=" in x for x in a.inputs):
        raise ValueError("--ensemble takes ENGINE=FILE inputs")
    return p


def main(argv: list[str]) -> int:
    from .plans import benchmark, pipeline
    from .sources import manifest, matches, results

    if argv[:1] == ["manifests"]:
        try:
            for path in argv[1:]:
                with open(path) as f:
                    print(f"{path}: {len(manifest.parse(f.read()))} datasets")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    from pyspark.sql import SparkSession

    if argv[:1] == ["compare"]:
        if len(argv) != 4:
            print("usage: compare CANDIDATE BASELINE OUTPUT", file=sys.stderr)
            return 2
        spark = SparkSession.builder.getOrCreate()
        results.write_once(benchmark.compare_runs(spark, *argv[1:3]), argv[3])
        return 0
    if argv[:1] == ["dataset"]:
        d = dataset_parser().parse_args(argv[1:])
        try:
            with open(d.manifest) as f:
                found = manifest.parse(f.read())
            if d.dataset not in found:
                raise ValueError(f"dataset {d.dataset} is not in {d.manifest}")
            p = Params.of(d.profile, seed=d.seed)
            spark = SparkSession.builder.getOrCreate()
            if d.dry_run:
                print("\n".join(benchmark.planned(spark, found[d.dataset], p, d.output)))
                return 0
            files, record = benchmark.run_dataset(spark, found[d.dataset], p, output=d.output)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        benchmark.write_run(files, record, d.output)
        return int(record["files_successful"] < record["files_attempted"])
    if argv[:1] == ["entrapment"]:
        e = argparse.ArgumentParser(prog="rescora entrapment", allow_abbrev=False)
        e.add_argument("--entrapment-fraction", type=float, required=True)
        e.add_argument("--output")
        e.add_argument("inputs", nargs="+", help="target result files; decoys are found beside them")
        e = e.parse_args(argv[1:])
        report = benchmark.entrapment_report(SparkSession.builder.getOrCreate(), e.inputs, e.entrapment_fraction).orderBy("method", "cut")
        if e.output:
            results.write_entrapment(report, e.output)
        for r in report.collect():
            print("\t".join(str(x) if isinstance(x, (str, int)) else "NA" if x is None else f"{x:.6f}" for x in r))
        return 0
    a = parser().parse_args(argv)
    try:
        p = settings(a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    builder = SparkSession.builder
    spark = (builder if SparkSession.getActiveSession() else builder.config("spark.master", f"local[{max(1, a.num_threads)}]")).getOrCreate()
    counts = matches.LineCounts()
    if p.ensemble:
        df, names = matches.read_engines(spark, dict(x.split("=", 1) for x in a.inputs), counts)
    else:
        df, names = matches.read_matches(spark, a.inputs, counts)
    bayes_params = pipeline.bayes.BayesParams(a.protein_alpha, a.protein_beta, a.protein_gamma, a.protein_peptide_prior, max_iter=a.protein_max_iter)
    run = pipeline.rescore(df, p, bool(a.results_proteins or a.decoy_results_proteins), bayes_params)
    for flags, level, decoys in OUTPUTS:
        path = getattr(a, flags[1].lstrip("-").replace("-", "_"))
        if path and level == "proteins":
            results.write_protein_results(run.proteins, path, decoys, one_file=True)
        elif path:
            results.write_match_results(getattr(run, level).where("label < 0" if decoys else "label > 0"), path, one_file=True)
    if a.feature_report:
        lines = results.feature_report_lines(run.feature_report(p), names + ["rt_abs_error", "rt_sq_error"] * p.rt_features)
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(a.feature_report)
    print(json.dumps(pipeline.run_log(run, p, a.profile) | {"inputs": counts.by_file()}), file=sys.stderr)
    if p.join:
        for r in pipeline.yields_by_source(run).collect():
            print(f"{r['source']}\t{r['accepted']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
