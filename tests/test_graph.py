import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rescora.operators import bayes, proteins
from rescora.operators.components import connected_components


def roots(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)],
    }[kind]
    df = spark.createDataFrame(edges + [(None, 3), (7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def entries(spark, rows):
    return spark.createDataFrame([(i, float(s), float(p), x) for i, (s, p, x) in enumerate(rows)], "row_id long, score double, pep double, proteins string")


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def synthetic_rows():
    """120 target groups of three peptides, 120 decoy groups of two, a shared pair and two lone decoys."""
    rows = []

    def add(best, names, n):
        rows.extend((best - 0.01 * k, 1 / (1 + max(best - 0.01 * k, 0)), "\t".join(names)) for k in range(n))

    for i in range(120):
        add(1000 - i, [f"T{i:03d}"], 3)
        add(920.5 - i if i < 40 else 140 - i, [f"DECOY_T{i:03d}"], 2)
    add(930.25, ["SHARED_A", "SHARED_B"], 3)
    add(910.25, ["DECOY_SHARED_A", "DECOY_SHARED_B"], 2)
    add(40, ["DECOY_LONE_A"], 1)
    add(39, ["DECOY_LONE_B"], 1)
    return rows


def test_picked_groups(spark):
    rows = synthetic_rows()
    assert len(rows) == 607
    groups = proteins.infer_picked(entries(spark, rows)).collect()
    assert len(groups) == 244
    shared = next(g for g in groups if g["proteins"] == ["SHARED_A", "SHARED_B"])
    assert shared["n_peptides"] == 3 and not shared["is_decoy"] and shared["picked"]
    passed = [g for g in groups if not g["is_decoy"] and g["picked"] and g["q"] < 0.01]
    frame = spark.createDataFrame(groups)
    assert len(passed) == 121 and proteins.classic_count(frame).first()[0] == 81
    by = {}
    for g in groups:
        by.setdefault(g["key"], []).append(g)
    for own in by.values():
        best = max(own, key=lambda g: (g["score"], not g["is_decoy"]))
        assert [g["picked"] for g in own].count(True) == 1 and best["picked"]
        assert all(g["q"] == 1.0 for g in own if not g["picked"])


def test_target_wins_ties_and_empty_names_are_left_out(spark):
    groups = proteins.infer_picked(entries(spark, [(5, 0.1, "A"), (5, 0.1, "rev_A"), (9, 0.1, " ;\t")])).collect()
    assert {g["component"]: g["picked"] for g in groups} == {"A": True, "rev_A": False}


def enumerate_posterior(rows, p):
    """Chance that no protein of each cluster is present, by all states of all proteins."""
    names = sorted({x for _, _, s in rows for x in s.split()})
    peps = [min(max(q, 1e-12), 1 - 1e-12) for _, q, _ in rows]
    lr = [((1 - q) / q) / (p.peptide_prior / (1 - p.peptide_prior)) for q in peps]
    hood = {n: tuple(i for i, (_, _, s) in enumerate(rows) if n in s.split()) for n in names}
    total, none = 0.0, {}
    for state in itertools.product((0, 1), repeat=len(names)):
        on = dict(zip(names, state, strict=True))
        w = 1.0
        for n in names:
            w *= p.gamma if on[n] else 1 - p.gamma
        for (_, _, s), x in zip(rows, lr, strict=True):
            k = sum(on[n] for n in s.split())
            w *= 1 + (x - 1) * (1 - (1 - p.beta) * (1 - p.alpha) ** k)
        total += w
        for c in set(hood.values()):
            if not any(on[n] for n in names if hood[n] == c):
                none[c] = none.get(c, 0.0) + w
    return {tuple(sorted(n for n in names if hood[n] == c)): none.get(c, 0.0) / total for c in set(hood.values())}


@pytest.mark.parametrize(
    "rows",
    [[(1, 0.02, "A B")], [(1, 0.02, "A"), (1, 0.2, "A B")], [(1, 0.6, "A")], [(1, 0.05, "A B C"), (1, 0.3, "B C"), (1, 0.5, "A")], [(1, 0.01, "A B"), (1, 0.1, "B C"), (1, 0.4, "D")]],
)
def test_bayes_equals_enumeration_on_trees(spark, rows):
    p = bayes.BayesParams()
    got = {tuple(r["proteins"]): r for r in bayes.infer_bayes(entries(spark, rows), p).collect()}
    want = enumerate_posterior(rows, p)
    assert {k: v["pep"] for k, v in got.items()} == pytest.approx(want, abs=1e-8)
    assert all(r["score"] + r["pep"] == pytest.approx(1) for r in got.values())


def test_closed_form_equals_propagation(spark):
    p = bayes.BayesParams()
    df = entries(spark, [(1, 0.02, "A B"), (1, 0.3, "A B"), (1, 0.7, "C")])
    named = bayes.clusters(df)
    closed = {r["cluster"]: r["pep"] for r in bayes.closed_posterior(bayes.cluster_edges(df, named), df, p).collect()}
    lr = lambda q: ((1 - q) / q) / (0.1 / 0.9)
    pdf = pd.DataFrame({"row_id": [0, 1, 2], "cluster": ["A", "A", "C"], "size": [2, 2, 1], "lr": [lr(0.02), lr(0.3), lr(0.7)]})
    found = bayes.propagate(pdf, p).set_index("cluster")["pep"].to_dict()
    assert closed == pytest.approx(found, abs=1e-8)


def test_bayes_parameters():
    for bad in ({"alpha": -0.1}, {"gamma": 0.0}, {"peptide_prior": 0.0}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            bayes.BayesParams(**bad)


def test_bayes_q_rises_with_error(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(rng.uniform(0.01, 0.9)), f"P{i % 20}") for i in range(60)]
    out = bayes.infer_bayes(entries(spark, rows)).orderBy("pep").collect()
    assert all(a["q"] <= b["q"] + 1e-12 for a, b in zip(out, out[1:], strict=False))


def test_zero_messages_and_settling():
    """A peptide that some parent explains for certain, and a run that is stopped early."""
    pdf = pd.DataFrame({"row_id": [0, 0, 1, 1, 2], "cluster": ["a", "b", "b", "c", "c"], "size": [1, 2, 2, 1, 1], "lr": [9.0, 9.0, 0.2, 0.2, 5.0]})
    got = bayes.propagate(pdf, bayes.BayesParams())
    assert got["converged"].all() and 1 < got["iterations"].max() < 200
    short = bayes.propagate(pdf, bayes.BayesParams(max_iter=1))
    assert not short["converged"].any() and short["iterations"].max() == 1


def test_parts_of_several_sizes_are_solved_alike(spark):
    rows = [(9 - i, 0.1 + i / 40, f"G{i};H{i};K{i % 3}") for i in range(9)] + [(5, 0.2, "G1;X"), (4, 0.3, "X;Y;Z")]
    df = entries(spark, rows)
    out = bayes.infer_bayes(df)
    alone = {r["cluster"]: r["pep"] for r in out.collect()}
    named = bayes.clusters(df)
    edges = bayes.cluster_edges(df, named).join(df.select("row_id", "pep"), "row_id").toPandas()
    post = 1 - edges["pep"]
    edges["lr"] = (post / (1 - post)) / (0.1 / 0.9)
    whole = bayes.propagate(edges, bayes.BayesParams()).set_index("cluster")["pep"].to_dict()
    assert set(whole) == set(alone) and all(alone[c] == pytest.approx(whole[c], abs=1e-6) for c in whole)
    log = bayes.inference_diagnostics(out).first()
    assert log["converged"] and log["iterations"] > 1


def tangled_rows(n=60, seed=4):
    """A graph with loops in one large part, a peptide of many proteins, a protein of many peptides, and other parts."""
    rng = np.random.default_rng(seed)
    rows = [(1.0, float(rng.uniform(0.01, 0.9)), f"P{i};P{(i * 7 + 3) % n};P{(i * 5 + 1) % n}") for i in range(n)]
    rows += [(2.0, float(rng.uniform(0.05, 0.8)), f"P0;P{i % n}") for i in range(0, 40, 2)]
    rows += [(3.0, 0.2, ";".join(f"P{i}" for i in range(25))), (1.0, 0.4, "X;Y"), (1.0, 0.1, "X"), (1.0, 0.3, "Z"), (1.0, 0.02, "S1;S2"), (1.0, 0.2, "S1;S2;P3")]
    return rows


def test_a_part_as_tables_equals_a_part_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(bayes, "HOT_EDGES", 6)
    df = entries(spark, tangled_rows())
    p = bayes.BayesParams()
    task = {r["cluster"]: r for r in bayes.infer_bayes(df, p).collect()}
    tables = {r["cluster"]: r for r in bayes.infer_bayes(df, p, task_states=6).collect()}
    assert set(task) == set(tables) and sum(r["iterations"] > 0 for r in tables.values()) > 50
    assert all(tables[c]["converged"] and abs(tables[c]["pep"] - task[c]["pep"]) < 1e-8 for c in task)
    assert tables["Z"]["iterations"] == 0 and tables["Z"]["pep"] == task["Z"]["pep"]


def test_tables_stop_where_propagation_stops(spark):
    df = entries(spark, tangled_rows(12))
    p = bayes.BayesParams(max_iter=3)
    edges = bayes.cluster_edges(df, bayes.clusters(df))
    logs = bayes.own_evidence(edges, df, p)
    rows = edges.where("parents > 1").join(logs, "cluster").join(df.select("row_id", bayes._lr(p).alias("lr")), "row_id")
    want = bayes.propagate(rows.toPandas(), p).set_index("cluster")
    got = bayes.propagate_tables(rows, p).toPandas().set_index("cluster")
    assert set(got.index) == set(want.index) and (got["iterations"] == 3).all() and not got["converged"].any()
    assert np.allclose(got["pep"], want.loc[got.index, "pep"], atol=1e-10)


def test_peptides_with_one_parent_are_part_of_the_evidence(spark):
    """Their messages propagated, or summed beforehand: the same posteriors."""
    df = entries(spark, tangled_rows(20))
    p = bayes.BayesParams()
    named = bayes.clusters(df)
    rows = bayes.cluster_edges(df, named).join(df.select("row_id", bayes._lr(p).alias("lr")), "row_id").toPandas()
    whole = bayes.propagate(rows, p).set_index("cluster")["pep"]
    got = bayes.infer_bayes(df, p).toPandas().set_index("cluster")["pep"]
    assert set(whole.index) == set(got.index) and np.allclose(got, whole.loc[got.index], atol=1e-7)


def test_clusters_with_clashing_hashes_are_taken_apart(spark):
    rows = [(1, 0.1, "A;B"), (1, 0.1, "A;B;C"), (1, 0.1, "C;D"), (1, 0.1, "E;F"), (1, 0.1, "E;F"), (1, 0.1, "D;rev_A"), (1, 0.1, "G")]
    df = entries(spark, rows)
    plain = sorted(map(tuple, bayes.clusters(df).collect()))
    for digest in (F.lit(1).cast("long"), F.xxhash64("row_id") % 2):
        assert sorted(map(tuple, bayes.clusters(df, digest).collect())) == plain
    assert {r[0]: r[2] for r in plain} == {"A": "A", "B": "A", "C": "C", "D": "D", "E": "E", "F": "E", "G": "G", "rev_A": "rev_A"}


def test_no_entries(spark):
    none = spark.createDataFrame([], "row_id long, score double, pep double, proteins string")
    assert bayes.infer_bayes(none).collect() == [] and bayes.clusters(none).collect() == []


def test_stars_take_no_part_in_further_rounds(spark, monkeypatch):
    import random

    from rescora.operators import components as C

    rng = random.Random(4)
    chains = [(1000 + 10 * k + i, 1000 + 10 * k + i + 1) for k in range(20) for i in range(rng.randrange(1, 9))]
    pairs, hub = [(9000 + 2 * k, 9001 + 2 * k) for k in range(200)], [(20000, 20000 + k) for k in range(1, 50)]
    links = [*chains, *pairs, *hub, (3, 2), (2, 3), (5, 5)]
    seen, star = [], C._star
    monkeypatch.setattr(C, "_star", lambda edges, large: (seen.append({r["v"] for r in edges.collect()}), star(edges, large))[1])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {x: x for x in {n for a, b in links if a != b for n in (a, b)}}
    for _ in range(12):
        for a, b in links:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert got == top
    assert all(2 not in v and not any(x >= 9000 for x in v) for v in seen)


def test_classic_count_reads_written_groups(spark):
    from rescora.operators import proteins

    rows = spark.createDataFrame([(str(k), float(k % 9), 0.1, f"P{k % 5};P{k % 7}") for k in range(40)], "row_id string, score double, pep double, proteins string")
    plan = proteins.groups(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_diagnostics_aggregate_clusters_not_peptides(spark, monkeypatch):
    from rescora.operators import bayes

    rows = spark.createDataFrame([("1", "A;B"), ("2", "A;B"), ("3", "A"), ("4", "B"), ("5", "C;D"), ("6", "C"), ("7", "E")], "row_id string, proteins string")
    out = bayes.graph_diagnostics(rows)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(out.first()) == (3, 2, 1)


def test_only_entries_with_several_names_are_followed_as_edges(spark, monkeypatch):
    """Proteins with entries of their own are summed, and what is not read again is deleted."""
    rows = [(1.0, 0.1 + k / 99, f"P{k % 20}") for k in range(60)] + [(1.0, 0.3, "P1;P2"), (1.0, 0.2, "A;B"), (1.0, 0.4, "A;B;P3")]
    gone = []
    monkeypatch.setattr(bayes, "discard", lambda *t, delete=bayes.discard: (gone.extend(x._scratch_path.split("/")[-1].rsplit("-", 1)[0] for x in t), delete(*t))[1])
    found = bayes.evidence(entries(spark, rows), bayes.BayesParams())
    assert gone == ["edges"]
    assert found.edges.count() == 5 and {r["protein"] for r in found.named.collect()} == {"A", "B", "P1", "P2", "P3"}
    assert {r["cluster"]: r["n_peptides"] for r in found.easy.collect()} == {f"P{k}": 3 for k in range(20) if k not in (1, 2, 3)}
    gone.clear()
    assert bayes.infer_bayes(entries(spark, rows)).count() == 21
    assert gone == ["edges", "counted", "clusters", "cluster-edges", "own-evidence"]


def test_what_was_shuffled_for_a_written_table_is_deleted(spark):
    import os
    import time

    from rescora.session import SHUFFLE_CLEANUP, materialise

    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for _, _, own in os.walk(d.getPath()) for f in own if f.startswith("shuffle_")}
    old = files()
    written = materialise(spark.range(5000).repartition(3, "id"), "shuffled")
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    for _ in range(100):
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old and written.count() == 5000
