"""Whole runs: from match tables to scored matches, peptides and protein groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayes, learn, proteins, retention, rollup
from ..operators import targetdecoy as td
from ..session import materialise
from ..sources import results
from .params import Params


@dataclass(frozen=True)
class Run:
    """Scored matches and peptides with q and pep; protein groups if asked for; the folds' settings."""

    matches: DataFrame
    peptides: DataFrame
    proteins: DataFrame | None
    choices: DataFrame
    #: Matches with the features that the models were trained on, and their held-out scores and folds.
    trained: DataFrame

    def feature_report(self, p: Params) -> DataFrame:
        """The report of this run's own models, on the features and folds that they had."""
        return learn.report_of(self.trained, self.choices, p)

    def write(self, path: str) -> None:
        """Targets and decoys of each level, as result files under a folder."""
        for name, df in (("psms", self.matches), ("peptides", self.peptides)):
            results.write_match_results(df.where("label > 0"), f"{path}/{name}")
            results.write_match_results(df.where("label < 0"), f"{path}/decoy_{name}")
        if self.proteins is not None:
            results.write_protein_results(self.proteins, f"{path}/proteins")
            results.write_protein_results(self.proteins, f"{path}/decoy_proteins", decoys=True)


def with_retention_features(df: DataFrame) -> DataFrame:
    """Retention errors as two more features, fitted by source before pooling."""
    out = retention.with_retention(df)
    both = F.concat("features", F.array("rt_abs_error", "rt_sq_error"))
    return out.withColumn("features", both).drop("rt_predicted", "rt_abs_error", "rt_sq_error")


def statistics(df: DataFrame) -> DataFrame:
    """Append q and pep, with pi0 of these rows."""
    q = td.qvalues(df)
    pep = td.peps(df.select("row_id", "label", "score")).select(F.col("row_id").alias("_row"), "pep")
    return q.join(pep, F.col("row_id") == F.col("_row")).drop("_row")


def rescore(
    df: DataFrame, p: Params | None = None, infer_proteins: bool = False, bayes_params: bayes.BayesParams | None = None
) -> Run:
    """Learn a score on a canonical table and carry it to matches, peptides and proteins.

    Pools of several runs are one table; in an ensemble the reports of one candidate share a fold, only the best of
    them stays, and match ids name their engine.
    """
    p = p or Params()
    p.check(proteins=infer_proteins)
    if p.rt_features:
        df = with_retention_features(df)
    df = materialise(df, "matches")
    if p.ensemble:
        from ..operators.folds import assign_grouped_folds

        rows = assign_grouped_folds(df, ["scan", "label", "peptide"], p.folds, p.seed)
    else:
        rows = df
    own = materialise(learn.cross_validated(rows, p, folds=not p.ensemble), "learned")
    choices = learn.fold_choices(own)
    scored = trained = df.join(own.select(F.col("row_id").alias("_row"), "score", "fold"), F.col("row_id") == F.col("_row")).drop("_row")
    if p.ensemble:
        scored = rollup.best_report_of_candidate(scored)
    scored = materialise(scored.drop("features"), "scored")
    matches = statistics(scored)
    if p.ensemble:
        matches = matches.withColumn("spec_id", F.concat_ws(":", "source", "spec_id"))
    peptides = materialise(statistics(rollup.best_psm_of_peptide(scored)), "peptides")
    groups = None
    if infer_proteins:
        entries = peptides.select("row_id", "score", "pep", "proteins")
        groups = proteins.infer_picked(entries)
        if p.protein_inference == "bayesian":
            groups = bayes.infer_bayes(entries, bayes_params).withColumn("picked", F.lit(True))
        groups = materialise(groups, "protein-groups")
    return Run(matches, peptides, groups, choices, trained)


def yields_by_source(run: Run) -> DataFrame:
    """Accepted targets of each input under pooled q-values."""
    return rollup.yield_of_sources(run.matches)


def run_log(run: Run, p: Params | None = None, profile: str = "canonical") -> dict:
    """What a run did: its settings, what each fold chose, counts, and whether inference settled."""
    p = p or Params()
    m = run.matches.agg(F.count_if(F.col("label") > 0).alias("targets"), F.count_if(F.col("label") < 0).alias("decoys"), td.pi0_of(F.col("label")).alias("pi0"), td.yield_at().alias("psms_q01")).first()
    choices = [r.asDict() for r in run.choices.drop("weights").orderBy("fold").collect()]
    out = {"profile": profile, "model": p.model, "max_iter": p.max_iter, "cap": p.cap, "seed": p.seed, "join": p.join, "ensemble": p.ensemble, "rt_features": p.rt_features}
    out |= {"class_weights": "nested" if p.nested else "selected" if p.select_c else "fixed", "folds": choices}
    if p.model == "mlp":
        out |= {"mlp_hidden": p.mlp_hidden, "mlp_epochs": p.mlp_epochs, "mlp_rate": p.mlp_rate, "mlp_l2": p.mlp_l2}
    out |= m.asDict() | {"peptides_q01": run.peptides.agg(td.yield_at()).first()[0]}
    if run.proteins is not None:
        out["proteins_q01"] = proteins_accepted(run.proteins, p.test_fdr)
        if "converged" in run.proteins.columns:
            out["inference"] = bayes.inference_diagnostics(run.proteins).first().asDict()
    return out


def proteins_accepted(groups: DataFrame, fdr: float) -> int:
    return groups.where(F.col("picked") & ~F.col("is_decoy") & (F.col("q") < fdr)).count()
