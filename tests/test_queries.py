import numpy as np
import pytest
from compare_sql import SF, compare

import __spark_entry__
from rescora.plans import views as V
from rescora.plans.catalogue import QUERIES
from rescora.plans.oracles import ORACLES


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1000


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


LINES = ("svm_rescore_lines", "svm_rescore_distributed")
RESCORED = (*LINES, "svm_rescore", "mlp_rescore", "mlp_rescore_distributed", "select_c", "select_c_distributed")
OTHERS = ("nested_selection", "nested_selection_distributed", "feature_report", "null_training", "bp_posterior")


def test_queries_without_sql_are_all_looked_at():
    assert set(QUERIES) - set(ORACLES) == {*RESCORED, *OTHERS}


@pytest.mark.parametrize("name", RESCORED)
def test_rescored(spark, name):
    """Every row once, folds even, and the q-values those of the scores."""
    from rescora.operators import learn

    view = V.psm_lines(spark, SF) if name in LINES else V.psm_emb(spark, SF, planted=True)
    rows = QUERIES[name](spark, SF).toPandas().sort_values("row_id")
    assert len(rows) == view.count() == rows["row_id"].nunique()
    assert rows["fold"].value_counts().max() - rows["fold"].value_counts().min() <= 1
    score, label = rows["score"].to_numpy(), rows["label"].to_numpy()
    assert rows["q"].to_numpy() == pytest.approx(learn.rank_qvalues(score, label, learn.share_wrong(label)))
    if name not in LINES:
        # half the targets stand out, among 64 features of noise and 500 rows
        assert ((rows["q"] < 0.01) & (label > 0)).sum() >= 10


@pytest.mark.parametrize("name", ["nested_selection", "nested_selection_distributed"])
def test_nested_selection(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2]
    assert all(r["n_features"] in (65, 8, 4) and r["inner_yield"] > 0 and r["negative"] / r["positive"] in (1, 4, 16) for r in rows)


def test_forms_over_blocks_choose_as_forms_in_a_task(spark):
    for name in ("select_c", "nested_selection"):
        a, b = ({tuple(r[c] for c in ("fold", "n_features", "positive", "negative", "inner_yield") if c in r) for r in QUERIES[n](spark, SF).collect()} for n in (name, f"{name}_distributed"))
        assert a == b


def test_null_training(spark):
    rows = QUERIES["null_training"](spark, SF).collect()
    decoys = V.psm_lines(spark, SF).where("label < 0").count()
    assert len(rows) == 10 and all(r["rows"] == decoys and r["accepted"] <= 0.01 * decoys for r in rows)


def test_feature_report(spark):
    rows = QUERIES["feature_report"](spark, SF).toPandas()
    assert sorted(rows["feature"]) == list(range(65))
    # the planted feature carries the yield
    assert rows.loc[rows["yield_drop"].idxmax(), "feature"] == 64


def test_isotonic_probabilities(spark):
    rows = QUERIES["psm_pep_isotonic"](spark, SF).toPandas().set_index("row_id")["pep"]
    view = V.psm_events(spark, SF).toPandas().sort_values(["score", "row_id"], ascending=[False, True])
    pep = rows.loc[view["row_id"]].to_numpy()
    assert (np.diff(pep) >= -1e-9).all() and pep.min() >= 0 and pep.max() <= 1
    # the fit keeps the sum: 2 * pi0 * decoys, where nothing is cut off at 1
    decoy, low = (view["label"] < 0).to_numpy(), pep < 1
    pi0 = min(decoy.sum() / (~decoy).sum(), 1.0)
    assert pep[low].sum() == pytest.approx(2 * pi0 * decoy[low].sum(), abs=1.0)


def test_propagated_posteriors(spark):
    rows = QUERIES["bp_posterior"](spark, SF).toPandas()
    assert rows["cluster"].is_unique and rows["pep"].between(0, 1).all()
    assert (rows["score"] + rows["pep"]).to_numpy() == pytest.approx(1, abs=2e-6)
    for _, own in rows.groupby("is_decoy"):
        own = own.sort_values("pep")
        upto = own.groupby("pep")["pep"].agg(["sum", "count"]).cumsum()
        assert own["q"].to_numpy() == pytest.approx((upto["sum"] / upto["count"]).loc[own["pep"]].to_numpy(), abs=1e-4)


def test_learning_queries_use_all_features_and_rounds(spark, monkeypatch):
    from rescora.operators import features, learn
    from rescora.plans import catalogue
    from rescora.plans.params import Params

    seen = []

    class Seen(Exception):
        pass

    def look(df, p, *a, **k):
        seen.append((features.width(df), p))
        raise Seen

    monkeypatch.setattr(learn, "cross_validated", look)
    for run in (catalogue.nested_selection, catalogue.svm_rescore_distributed):
        with pytest.raises(Seen):
            run(spark, SF)
    assert seen[0] == (65, Params(nested=True)) and seen[1][1] == Params()
