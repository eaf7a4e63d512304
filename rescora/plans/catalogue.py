"""The registered queries of the library's own operators, each over its whole table.

Sums and averages are rounded to 6 places where engines may add in another order; counts and ids are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bayes, calibration, compare, features, folds, learn, proteins, retention, rollup
from ..operators import targetdecoy as td
from ..operators.calibration import CUTS
from ..session import materialise
from ..sources.matches import Layout, parsed
from ..sources.results import entrapment_class
from . import views as V
from .params import Params

#: Weights of the fixed linear score over the lineitem features.
LINE_WEIGHTS = (0.5, 0.0001, -2.0, 3.0)
WIDTHS = {"A": 4, "N": 4, "R": 4}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- labels, q-values, yields -----------------------------------------------------------------------------------


@query
def label_counts_pi0(spark: SparkSession, sf: str) -> DataFrame:
    return td.label_counts(V.psm_events(spark, sf))


@query
def psm_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    return td.qvalues(V.psm_events(spark, sf).select("row_id", "label", "score")).select("row_id", "label", "score", "q")


@query
def psm_qvalues_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    rows = td.qvalues(V.psm_events(spark, sf).select("row_id", "label", "score"), one_task=0)
    return rows.select("row_id", "label", "score", "q")


@query
def psm_qvalues_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return td.qvalues(V.psm_events(spark, sf).select("row_id", "label", "score", "source"), ["source"]).select("row_id", "source", "q")


@query
def psm_accepted_q01(spark: SparkSession, sf: str) -> DataFrame:
    return td.accepted(td.qvalues(V.psm_events(spark, sf))).select("row_id", "score", "q", "peptide", "proteins")


@query
def yield_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return td.yield_sweep(td.qvalues(V.psm_events(spark, sf).select("row_id", "label", "score")), CUTS)


@query
def psm_pep_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return td.peps(V.psm_events(spark, sf).select("row_id", "label", "score")).select("row_id", r6("pep").alias("pep"))


@query
def bayes_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    pep = F.round(1 / (1 + F.abs(F.col("score")) / 100), 2)
    rows = V.psm_events(spark, sf).select("row_id", (F.col("label") < 0).alias("is_decoy"), pep.alias("pep"))
    return td.bayes_qvalues(rows).select("row_id", "is_decoy", "pep", r6("q").alias("q"))


# --- roll-ups, engines, runs ------------------------------------------------------------------------------------


@query
def peptide_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.best_psm_of_peptide(V.psm_events(spark, sf)).select("label", "core", "row_id", "score")


@query
def peptide_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    return td.qvalues(rollup.best_psm_of_peptide(V.psm_events(spark, sf))).select("label", "core", "row_id", "score", "q")


@query
def candidate_best(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.best_report_of_candidate(V.psm_lines(spark, sf)).select("scan", "label", "peptide", "row_id", "score", "source")


@query
def engine_support(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.engine_support(V.psm_lines(spark, sf)).select("row_id", "scan_engines", "candidate_engines")


@query
def ensemble_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.join_engines(V.psm_lines(spark, sf), sorted(WIDTHS), WIDTHS)
    return rows.select("row_id", *[F.get("features", F.lit(k)).alias(f"f{k}") for k in range(3 + 12 + 2)])


@query
def join_pool_yield_per_source(spark: SparkSession, sf: str) -> DataFrame:
    runs = V.psm_events(spark, sf).select("row_id", "label", "score", "source")
    kinds = ["click", "view"]
    pooled = rollup.join_runs([runs.where(F.col("source") == k) for k in kinds] + [runs.where(~F.col("source").isin(kinds))])
    return rollup.yield_of_sources(td.qvalues(pooled))


@query
def size_interleaved_order(spark: SparkSession, sf: str) -> DataFrame:
    sizes = V.psm_events(spark, sf).groupBy(F.col("scan").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    return rollup.interleaved_by_size(sizes).select("name", "size", F.col("position").cast("long").alias("position"))


# --- folds, caps, permutations ----------------------------------------------------------------------------------


@query
def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return folds.assign_folds(V.psm_events(spark, sf).select("row_id")).select("row_id", "fold")


@query
def grouped_folds(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["scan", "label", "peptide"]
    return folds.assign_grouped_folds(V.psm_events(spark, sf).select("row_id", *keys), keys).select("row_id", "fold")


@query
def train_cap_sample(spark: SparkSession, sf: str) -> DataFrame:
    return folds.training_cap(V.psm_events(spark, sf).select("row_id", "label"), 1000).select("row_id", "label")


@query
def permute_feature(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.assign_folds(V.psm_events(spark, sf).select("row_id", "score"))
    return folds.permute(rows, "score").select("row_id", "fold", "permuted")


@query
def permuted_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.assign_folds(V.psm_lines(spark, sf).select("row_id", "features"))
    return folds.permute_each(rows).select("row_id", "fold", "feature", "x", "permuted")


# --- feature statistics -----------------------------------------------------------------------------------------


@query
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_stats(V.psm_lines(spark, sf)).select("feature", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.psm_lines(spark, sf)
    both = features.as_arrays(features.feature_stats(rows))
    z = S.zscore(F.col("features"), F.col("means"), F.col("sds"))
    return rows.crossJoin(F.broadcast(both)).select("row_id", *[F.round(F.get(z, F.lit(k)), 5).alias(f"z{k}") for k in range(5)])


@query
def label_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return features.label_correlation(V.psm_lines(spark, sf)).select("feature", r6("correlation").alias("correlation"))


@query
def single_feature_yield(spark: SparkSession, sf: str) -> DataFrame:
    return features.single_feature_yield(V.psm_lines(spark, sf).select("row_id", "label", "features"))


@query
def initial_direction(spark: SparkSession, sf: str) -> DataFrame:
    return features.initial_direction(features.single_feature_yield(V.psm_emb(spark, sf)))


@query
def top_k_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.top_features(features.single_feature_yield(V.psm_emb(spark, sf)), 8)


@query
def linear_score_fixed_weights(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_linear_score(V.psm_lines(spark, sf), LINE_WEIGHTS).select("row_id", r6("score").alias("score"))


@query
def decoy_standardised_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.assign_folds(V.psm_events(spark, sf).select("row_id", "label", "score"))
    return features.standardise_scores(rows, F.col("fold") != 0).select("row_id", r6("standard").alias("standard"))


# --- retention time ---------------------------------------------------------------------------------------------


@query
def rt_predict(spark: SparkSession, sf: str) -> DataFrame:
    return V.psm_docs(spark, sf).select("row_id", r6(S.retention(F.col("peptide"))).alias("rt"))


@query
def rt_fit(spark: SparkSession, sf: str) -> DataFrame:
    return retention.fits(V.psm_docs(spark, sf)).select("source", r6("slope").alias("slope"), F.round("intercept", 5).alias("intercept"))


@query
def rt_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = retention.with_retention(V.psm_docs(spark, sf))
    return rows.select("row_id", F.round("rt_abs_error", 4).alias("rt_abs_error"), F.round("rt_sq_error", 1).alias("rt_sq_error"))


# --- scalar functions -------------------------------------------------------------------------------------------


@query
def core_peptide(spark: SparkSession, sf: str) -> DataFrame:
    return V.psm_events(spark, sf).select("row_id", S.core_peptide(F.col("peptide")).alias("core"))


@query
def split_proteins(spark: SparkSession, sf: str) -> DataFrame:
    names = S.split_proteins(F.concat_ws("\t", "proteins", F.concat(F.lit("REV_"), F.col("proteins")), F.lit(" X;Y")))
    return V.psm_events(spark, sf).select("row_id", F.array_join(names, "|").alias("names"), F.size(names).cast("long").alias("n"))


@query
def decoy_flag_strip(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("proteins")
    return V.psm_events(spark, sf).select("row_id", S.is_decoy_protein(p).alias("is_decoy"), S.strip_decoy(p).alias("stripped"))


@query
def pairing_key(spark: SparkSession, sf: str) -> DataFrame:
    names = S.split_proteins(F.concat_ws(";", "proteins", F.concat(F.lit("rev_P"), (F.col("scan") % 5).cast("string"))))
    return V.psm_events(spark, sf).select("row_id", S.pairing_key(names).alias("key"))


@query
def target_decoy_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.psm_events(spark, sf)
    return rows.groupBy(F.when(F.col("label") > 0, "target").otherwise("decoy").alias("kind"), "source").agg(F.count(F.lit(1)).alias("rows"))


@query
def odds_and_emission(spark: SparkSession, sf: str) -> DataFrame:
    pep = S.clamp(F.round(1 / (1 + F.abs(F.col("score")) / 100), 4), 1e-12, 1 - 1e-12)
    lr = S.odds_ratio(pep, 0.1)
    return V.psm_events(spark, sf).select("row_id", F.round(lr, 4).alias("lr"), r6(S.emission(F.col("scan") % 4, 0.1, 0.01)).alias("emission"))


@query
def binomial_priors(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("scan") % 5 + 1).cast("double")
    rows = V.psm_events(spark, sf).select("row_id", n.alias("n"))
    return rows.select("row_id", F.posexplode(S.binomial_prior(F.col("n"), 0.3)).alias("k", "p")).select("row_id", "k", r6("p").alias("p"))


@query
def fixed_point_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.psm_events(spark, sf).select("row_id", S.fixed(F.col("score"), 6).alias("score"))


@query
def derived_ms_features(spark: SparkSession, sf: str) -> DataFrame:
    x = S.minus_log10(F.abs(F.col("score")))
    charges = S.charge_features((F.col("scan") % 7 + 1).cast("int"))
    return V.psm_events(spark, sf).select("row_id", r6(x).alias("minus_log"), F.array_join(F.transform(charges, lambda c: S.fixed(c, 0)), "").alias("charge"))


@query
def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    mixed = F.concat(F.when(F.col("row_id") % 3 == 0, "-").otherwise(""), F.col("scan").cast("string"), F.lit("ab"), (F.col("row_id") % 10).cast("string"))
    number = F.when(F.col("row_id") % 4 == 0, F.lit("n/a")).otherwise(F.col("scan").cast("string"))
    return V.psm_events(spark, sf).select("row_id", S.lenient_int(mixed).alias("n"), S.lenient_double(number).alias("x"), S.label_of(mixed).alias("label"))


# --- proteins ---------------------------------------------------------------------------------------------------


@query
def protein_edges(spark: SparkSession, sf: str) -> DataFrame:
    return proteins.protein_edges(V.graph_lines(spark, sf))


@query
def protein_components(spark: SparkSession, sf: str) -> DataFrame:
    return proteins.protein_components(V.graph_lines(spark, sf))


@query
def group_evidence(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.graph_lines(spark, sf)
    rows = proteins.group_evidence(entries, proteins.protein_components(entries))
    return rows.select("component", F.array_join("proteins", ",").alias("proteins"), "score", r6("pep").alias("pep"), "n_peptides", "is_decoy")


@query
def picked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    entries = V.graph_lines(spark, sf)
    rows = proteins.pick(proteins.group_evidence(entries, proteins.protein_components(entries)))
    return rows.select("component", "key", "is_decoy", "score", "picked")


@query
def picked_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    return proteins.infer_picked(V.graph_lines(spark, sf)).select("component", "is_decoy", "score", "picked", "q")


@query
def classic_count(spark: SparkSession, sf: str) -> DataFrame:
    return proteins.classic_count(proteins.groups(V.graph_lines(spark, sf)))


@query
def protein_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.clusters(V.graph_lines(spark, sf)).select("protein", "is_decoy", "cluster", "size", "n_peptides")


@query
def graph_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.graph_diagnostics(V.graph_lines(spark, sf))


@query
def bayes_tree_posterior(spark: SparkSession, sf: str) -> DataFrame:
    found = bayes.evidence(V.graph_lines(spark, sf), bayes.BayesParams())
    return found.easy.select("cluster", "pep").unionByName(found.untangled()).select("cluster", r6("pep").alias("pep"))


@query
def bp_posterior(spark: SparkSession, sf: str) -> DataFrame:
    rows = bayes.infer_bayes(V.graph_lines(spark, sf))
    return rows.select("cluster", F.array_join("proteins", ",").alias("proteins"), "is_decoy", "n_peptides", r6("pep").alias("pep"), r6("score").alias("score"), r6("q").alias("q"))


# --- learning ---------------------------------------------------------------------------------------------------


def _learned(spark: SparkSession, rows: DataFrame, p: Params, task_rows: int = learn.TASK_ROWS) -> DataFrame:
    """Held-out scores with their q-values."""
    rows = rows.select("row_id", "label", "features")
    own = rows.agg(F.count(F.lit(1)).alias("n"), td.pi0_of(F.col("label")).alias("pi0")).first()
    scored = learn.held_out(rows, p, task_rows)
    return td.qvalues(scored, pi0=own["pi0"], rows=own["n"]).select("row_id", "label", "fold", "score", "q")


@query
def svm_rescore(spark: SparkSession, sf: str) -> DataFrame:
    return _learned(spark, V.psm_emb(spark, sf, planted=True), Params())


@query
def svm_rescore_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _learned(spark, V.psm_lines(spark, sf), Params())


@query
def svm_rescore_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """svm_rescore_lines by partial sums, as beyond the rows of a task."""
    return _learned(spark, V.psm_lines(spark, sf), Params(), task_rows=0)


@query
def repeated_lines_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """events as match lines, those of every seventh user three times over: all are rows of their own after rescoring."""
    rows = V.psm_events(spark, sf)
    times = F.when(F.col("scan") % 7 == 0, 3).otherwise(1)
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), times)))
    number = lambda c: c.cast("decimal(18,4)").cast("string")
    line = F.concat_ws("\t", F.col("row_id").cast("string"), F.col("label").cast("string"), F.col("scan").cast("string"), number(F.col("score")), "peptide", "proteins")
    found = parsed(rows.select(F.lit("events").alias("source"), line.alias("value")), Layout(("SpecId", "Label", "ScanNr", "f1", "Peptide", "Proteins")))
    scored = learn.rescored(materialise(found, "lines"), Params(max_iter=2))
    per = scored.groupBy("spec_id", "label", "scan").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("ids"))
    return per.select(F.col("spec_id").cast("long").alias("spec_id"), "label", "scan", "rows", "ids")


@query
def mlp_rescore(spark: SparkSession, sf: str) -> DataFrame:
    return _learned(spark, V.psm_emb(spark, sf, planted=True), Params(model="mlp"))


@query
def mlp_rescore_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """mlp_rescore over blocks, by a barrier stage, as beyond the rows of a task."""
    return _learned(spark, V.psm_emb(spark, sf, planted=True), Params(model="mlp"), task_rows=0)


@query
def select_c(spark: SparkSession, sf: str) -> DataFrame:
    return _learned(spark, V.psm_emb(spark, sf, planted=True), Params(select_c=True))


@query
def select_c_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """select_c over blocks, as beyond the rows of a task."""
    return _learned(spark, V.psm_emb(spark, sf, planted=True), Params(select_c=True), task_rows=0)


@query
def nested_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.psm_emb(spark, sf, planted=True)
    scored = learn.cross_validated(rows, Params(nested=True))
    return learn.fold_choices(scored).drop("weights")


@query
def nested_selection_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """nested_selection over blocks, as beyond the rows of a task."""
    scored = learn.cross_validated(V.psm_emb(spark, sf, planted=True), Params(nested=True), task_rows=0)
    return learn.fold_choices(scored).drop("weights")


@query
def feature_report(spark: SparkSession, sf: str) -> DataFrame:
    return learn.feature_report(V.psm_emb(spark, sf, planted=True))


# --- calibration and comparison ---------------------------------------------------------------------------------


@query
def null_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.null_yield(V.psm_events(spark, sf))


@query
def null_training(spark: SparkSession, sf: str) -> DataFrame:
    """Whole runs on relabelled decoys, with fixed weights and with the grid."""
    return learn.null_trained(V.psm_lines(spark, sf), Params())


@query
def entrapment_fdp(spark: SparkSession, sf: str) -> DataFrame:
    foreign, mixed = F.col("scan") % 3 == 0, (F.col("scan") % 3 != 0) & (F.col("scan") % 5 == 0)
    rows = td.qvalues(V.psm_events(spark, sf)).withColumns({"foreign": foreign, "mixed": mixed, "method": F.col("source")})
    out = calibration.entrapment(rows, fraction=0.5)
    return out.select("method", "cut", "accepted", "foreign", "mixed", *[r6(c).alias(c) for c in ("foreign_share", "fdp", "fdp_low", "fdp_high")])


@query
def residue_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.psm_docs(spark, sf).select("row_id", F.col("peptide").alias("sequence"))
    return calibration.residue_budget(rows, 200_000, [F.col("row_id")]).select("row_id", F.length("sequence").cast("long").alias("residues"))


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the users' events: counts of accepted matches under two scores."""
    rows = V.psm_events(spark, sf)
    good = F.count_if((F.col("label") > 0) & (F.col("score") > 300))
    out = []
    for scale in (1, 2):
        per = rows.groupBy(F.col("scan").cast("string").alias("input")).agg(
            F.lit(True).alias("ok"), F.round(F.sum("score"), 6).alias("wall_s"), (good + F.max("scan") % (scale + 1)).alias("psms"),
            good.alias("peptides"), (F.max("scan") * scale).alias("rss_kb"),
        )
        out.append(per)
    return out[0], out[1]


@query
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    row = compare.compare(*_runs(spark, sf))
    return row.select(*[r6(F.col(c).cast("double")).alias(c) for c in row.columns])


@query
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return compare.totals(_runs(spark, sf)[0]).select(r6("wall_s").alias("wall_s"), "psms", "peptides", "rss_kb", "failed")


@query
def unmatched_inputs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return compare.unmatched_inputs(a.where("input NOT LIKE '1%'"), b.where("input NOT LIKE '%7'"))


@query
def duplicate_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.duplicates(V.psm_lines(spark, sf).select("scan", "peptide").withColumn("input", F.concat_ws("-", F.col("scan").cast("string"), "peptide")), "input")


@query
def median_of_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return compare.lower_median(V.psm_events(spark, sf).select("scan", "score"), ["scan"], "score")


@query
def results_class(spark: SparkSession, sf: str) -> DataFrame:
    foreign = F.when(F.col("scan") % 4 == 0, F.lit("ENT_X1")).otherwise(F.col("proteins"))
    rows = V.psm_events(spark, sf).select(F.col("score").alias("q-value"), F.concat_ws(";", foreign, F.when(F.col("scan") % 3 == 0, F.lit("ENT_Y2"))).alias("proteinIds"))
    return entrapment_class(rows).groupBy("pure", "mixed").agg(F.count(F.lit(1)).alias("rows"))


@query
def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """events written as ragged match lines and parsed again."""
    rows = V.psm_events(spark, sf)
    line = F.concat_ws("\t", F.col("row_id").cast("string"), F.col("label").cast("string"), F.concat(F.lit("s"), F.col("scan").cast("string")), F.lit("1.0"), F.lit("bad"), (F.col("scan") % 50).cast("string"), "peptide", "proteins", F.when(F.col("scan") % 2 == 0, "Q2"))
    layout = Layout(("SpecId", "Label", "ScanNr", "ExpMass", "f1", "f2", "Peptide", "Proteins"))
    out = parsed(rows.select(F.lit("events").alias("source"), line.alias("value")), layout)
    return out.select("spec_id", "label", "scan", "peptide", "proteins", F.get("features", F.lit(0)).alias("f1"), F.get("features", F.lit(1)).alias("f2"))
