import pytest
from pyspark.sql import functions as F

from rescora.operators import calibration, compare, rollup
from rescora.plans import pipeline
from rescora.plans.params import Params
from rescora.sources import manifest, matches, results, spectra

PIN = """SpecId\tLabel\tScanNr\tExpMass\tCalcMass\tXcorr\tDelta\tPeptide\tProteins
DefaultDirection\t-\t-\t-\t-\t1\t0\t\t
a_1\t1\t12ab3\t1.0\t1.0\t2.5\tbad\tK.PEP[16]R.A\tP1\tP2
a_2\t-1\t7\t1\t1\t1e1\t.5\tK.AAA.R\tDECOY_P1

short\t1\t3
a_3\t0\t-9\t1\t1\tnan\t+2\tNODOTS
"""


def test_ragged_file(spark, tmp_path):
    (tmp_path / "one.pin").write_text(PIN.replace("\n", "\r\n"))
    df, names = matches.read_matches(spark, [str(tmp_path / "*.pin")])
    rows = {r["spec_id"]: r for r in df.collect()}
    assert names == ["Xcorr", "Delta"] and set(rows) == {"a_1", "a_2", "a_3"}
    assert rows["a_1"]["scan"] == 123 and rows["a_1"]["features"] == [2.5, 0.0] and rows["a_1"]["proteins"] == "P1\tP2"
    assert rows["a_2"]["label"] == -1 and rows["a_2"]["features"] == [10.0, 0.5]
    assert rows["a_3"]["scan"] == -9 and rows["a_3"]["label"] == -1 and rows["a_3"]["proteins"] == "" and rows["a_3"]["features"] == [0.0, 2.0]
    assert {r["source"] for r in rows.values()} == {"one.pin"}


def test_round_trip_and_pooling(spark, tmp_path):
    (tmp_path / "one.pin").write_text(PIN)
    df, names = matches.read_matches(spark, [str(tmp_path / "one.pin")])
    matches.write_matches(df.coalesce(1), names, str(tmp_path / "copy"))
    again, _ = matches.read_matches(spark, [str(tmp_path / "copy" / "part*")])
    key = ["spec_id", "label", "scan", "peptide", "proteins", "features"]
    assert sorted(map(tuple, df.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    with pytest.raises(ValueError):
        matches.discover(spark, [str(tmp_path / "one.pin")], 2)


def test_engines(spark, tmp_path):
    head = "SpecId\tLabel\tScanNr\tscore\tPeptide\tProteins\n"
    (tmp_path / "x.pin").write_text(head + "a\t1\t1\t4\tK.A.R\tP\nb\t1\t2\t2\tK.B.R\tP\n")
    (tmp_path / "y.pin").write_text(head + "a\t1\t1\t.01\tK.A.R\tP\nc\t1\t1\t.9\tK.C.R\tP\n")
    df, names = matches.read_engines(spark, {"e1": str(tmp_path / "x.pin"), "e2": str(tmp_path / "y.pin")})
    got = {(r["source"], r["spec_id"]): r["features"] for r in df.collect()}
    assert len(names) == 6
    assert got == {("e1", "a"): [1, 0, 4, 0, 2, 2], ("e1", "b"): [1, 0, 2, 0, 1, 1], ("e2", "a"): [0, 1, 0, 0.01, 2, 2], ("e2", "c"): [0, 1, 0, 0.9, 2, 1]}
    with pytest.raises(ValueError):
        matches.read_engines(spark, {"e1": str(tmp_path / "x.pin")})


def test_titles(spark):
    df = spark.createDataFrame([("run#12x", "1", 5), ("none", "2", 6)], "ScanNr string, posterior_error string, n long")
    rows = matches.normalised_titles(df, "n").collect()
    assert [r["ScanNr"] for r in rows] == ["12", "6"] and rows[0].asDict().keys() == {"ScanNr"}


def test_hits(spark, tmp_path):
    (tmp_path / "r.pep.xml").write_text(
        """<?xml version="1.0"?><msms_pipeline_analysis xmlns="http://x"><msms_run_summary base_name="r">
<spectrum_query spectrum="r.1" end_scan="11" assumed_charge="2" precursor_neutral_mass="1000.5" retention_time_sec="3.5"><search_result>
<search_hit hit_rank="1" peptide="ACDK" protein="rev_P1 desc" calc_neutral_pep_mass="1000.0" num_missed_cleavages="1">
<alternative_protein protein="P2 x"/><modification_info mod_nterm_mass="43.0"><mod_aminoacid_mass position="2" mass="160.03"/></modification_info>
<search_score name="expect" value="0.001"/><search_score name="xcorr" value="2.5"/></search_hit></search_result></spectrum_query>
<spectrum_query spectrum="r.2" end_scan="12" assumed_charge="3" precursor_neutral_mass="900"><search_result>
<search_hit hit_rank="1" peptide="GGR" protein="rev_P3" calc_neutral_pep_mass="900"><search_score name="xcorr" value="1"/></search_hit>
</search_result></spectrum_query></msms_run_summary></msms_pipeline_analysis>"""
    )
    hits = spectra.read_hits(spark, str(tmp_path / "r.pep.xml"))
    names = spectra.score_names(hits)
    df, features = spectra.as_matches(hits, names)
    rows = {r["scan"]: r for r in df.collect()}
    assert names == ["expect", "xcorr"]
    assert rows[11]["peptide"] == "[43.0]AC[160.03]DK" and rows[11]["label"] == 1 and rows[11]["proteins"] == "rev_P1\tP2"
    assert rows[12]["label"] == -1
    f = dict(zip(features, rows[11]["features"], strict=True))
    assert f["NegLog10Expect"] == pytest.approx(3) and f["abs_mz_diff"] == pytest.approx(0.25) and f["Charge2"] == 1 and f["Charge3"] == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">sp|A x\nAC\nDE\n>B\nKK\n")
    df = spectra.read_fasta(spark, str(tmp_path / "f.fasta"))
    assert {(r["header"], r["sequence"]) for r in df.collect()} == {("sp|A x", "ACDE"), ("B", "KK")}
    assert {r["header"] for r in spectra.entrapment_names(df).collect()} == {"ENT_F_sp_A", "ENT_F_B"}
    taken = calibration.residue_budget(df, 3, [F.col("header").desc()]).collect()
    assert [r["header"] for r in taken] == ["sp|A x"]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, 0.009, 0.1, "K.A.R", "P\tQ"), (2, "b", 2.5, 0.01, 0.2, "K.B.R", "ENT_X")], "row_id long, spec_id string, score double, q double, pep double, peptide string, proteins string")
    results.write_match_results(df, str(tmp_path / "psms"))
    back = results.read_match_results(spark, str(tmp_path / "psms" / "part*"))
    assert sum(r["accepted"] for r in results.count_accepted(back).collect()) == 1
    assert {r["proteinIds"] for r in back.collect()} == {"P\tQ", "ENT_X"}
    kinds = results.entrapment_class(back).collect()
    assert [r["pure"] for r in sorted(kinds, key=lambda r: r["q"])] == [False, True]
    text = "".join(p.read_text() for p in sorted((tmp_path / "psms").glob("part*")))
    assert text.splitlines()[:2] == ["\t".join(results.MATCH_COLUMNS), "b\t2.500000\t0.010000\t0.200000\tK.B.R\tENT_X"]
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        results.read_match_results(spark, str(tmp_path / "bad.tsv"))


def test_run_records(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"schema_version": 1, "dataset_id": "d", "wall_seconds": null, "psms_q_lt_0_01": 5}')
    row = results.read_runs(spark, str(tmp_path / "run.json")).first()
    assert row["psms_q_lt_0_01"] == 5 and row["wall_seconds"] is None
    assert '"wall_seconds": null' in results.run_json(row)


GOOD = """version = 1
[[datasets]]
id = "d-1"
source = "s"
organism = "o"
experiment_type = "e"
search_engine = "x"
pin_path = "${DATA_DIR}/*.pin"
protein_level_evaluation = false
notes = "n"
"""


def test_manifest():
    assert manifest.parse(GOOD)["d-1"].pin_path == "${DATA_DIR}/*.pin"
    assert manifest.expand("${A}/x", {"A": "/d"}) == "/d/x"
    with pytest.raises(ValueError):
        manifest.expand("${A}", {})
    bad = GOOD.replace('"d-1"', '"-d"').replace("${DATA_DIR}", "${data").replace('"n"', '" "') + "odd = 1\n"
    with pytest.raises(manifest.ManifestError) as e:
        manifest.parse(bad)
    assert len(e.value.errors) == 4
    assert manifest.timing("1.5\t2048\n") == (1.5, 2048)
    assert manifest.command_line(["a b", "c"]) == "'a b' c"


def test_comparison(spark):
    kind = "input string, ok boolean, wall_s double, psms long, peptides long, rss_kb long"
    a = spark.createDataFrame([("f1", True, 1.0, 110, 11, 100), ("f2", True, 1.0, 90, 9, 50), ("f3", True, 1.0, 50, 5, 60)], kind)
    b = spark.createDataFrame([("f1", True, 2.0, 100, 10, 200), ("f2", True, 2.0, 100, 10, 90), ("f3", True, 2.0, 50, 5, 60)], kind)
    r = compare.compare(a, b).first()
    assert (r["speed_up"], r["memory_ratio"], r["wins"], r["ties"], r["losses"], r["worst"], r["best"]) == (2.0, 0.5, 1, 1, 1, -10, 10)
    zero = compare.compare(a.withColumn("psms", F.lit(0).cast("long")), b.withColumn("psms", F.lit(0).cast("long"))).first()
    assert zero["psm_change"] is None
    with pytest.raises(ValueError):
        compare.compare(a, b.where("input <> 'f1'"))
    with pytest.raises(ValueError):
        compare.compare(a.union(a), b)
    failed = compare.totals(a.withColumn("ok", F.col("input") != "f1")).first()
    assert failed["psms"] is None and failed["failed"] == 1


def table(spark, n=240):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(n):
        label = 1 if i % 2 else -1
        good = 6.0 if i % 4 == 1 else 0.0
        x = [rng.gauss(0, 1), rng.gauss(good, 1)]
        prefix = "" if label > 0 else "DECOY_"
        rows.append((i, "ab"[i % 2 and i % 3 == 0], f"s{i}", label, i // 2, f"K.PEP{i // 3}.R", f"{prefix}P{i % 30}", x))
    return spark.createDataFrame(rows, "row_id long, source string, spec_id string, label int, scan long, peptide string, proteins string, features array<double>")


@pytest.mark.parametrize("p,proteins", [(Params(), True), (Params(protein_inference="bayesian", rt_features=True), True), (Params(ensemble=True), False)])
def test_whole_run(spark, tmp_path, p, proteins):
    run = pipeline.rescore(table(spark), p, infer_proteins=proteins)
    log = pipeline.run_log(run, p)
    assert len(log["folds"]) == 3 and log["class_weights"] == "fixed" and ("inference" in log) == (p.protein_inference == "bayesian")
    assert log["psms_q01"] >= 40 and log["targets"] <= 120
    assert run.peptides.count() == run.peptides.select("label", "core").distinct().count()
    assert sum(r["accepted"] for r in pipeline.yields_by_source(run).collect()) == log["psms_q01"]
    assert run.choices.count() == 3
    run.write(str(tmp_path / "out"))
    assert (tmp_path / "out" / "decoy_peptides").exists()
    if proteins:
        assert run.proteins.where("picked").count() > 0


def test_peptide_rollup_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(2, 1, "K.A.R", 5.0), (1, 1, "K.A.K", 5.0), (3, -1, "K.A.R", 9.0)], "row_id long, label int, peptide string, score double")
    got = {(r["label"], r["core"]): r["row_id"] for r in rollup.best_psm_of_peptide(df).collect()}
    assert got == {(1, "A"): 1, (-1, "A"): 3}


def test_command_line(spark, tmp_path):
    from rescora.__main__ import main

    df = table(spark)
    matches.write_matches(df.withColumn("source", F.lit("x")).coalesce(1), ["f1", "f2"], str(tmp_path / "in"))
    path = str(tmp_path / "in" / "part*")
    assert main([path, "-m", str(tmp_path / "psms"), "-l", str(tmp_path / "prot"), "--feature-report", str(tmp_path / "rep"), "--fast"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "rep").glob("part*")))
    assert len([x for x in text.splitlines() if not x.startswith("#")]) == 3
    assert (tmp_path / "psms").exists() and (tmp_path / "prot").exists()
    assert main([path, "--join", "--ensemble"]) == 2 and main([path, path]) == 2 and main([path, "--model", "mlp", "--select-c"]) == 2
    (tmp_path / "m.toml").write_text(GOOD)
    assert main(["manifests", str(tmp_path / "m.toml")]) == 0
    (tmp_path / "m.toml").write_text("version = 2")
    assert main(["manifests", str(tmp_path / "m.toml")]) == 1


def test_dataset_runs_are_recorded_and_compared(spark, tmp_path):
    from rescora.plans import benchmark

    matches.write_matches(table(spark).coalesce(1), ["f1", "f2"], str(tmp_path / "in"))
    next((tmp_path / "in").glob("part*.txt")).rename(tmp_path / "good.pin")
    (tmp_path / "bad.pin").write_text("no\theader\n")
    data = manifest.parse(GOOD)["d-1"]
    files, record = benchmark.run_dataset(spark, data, Params(max_iter=2), {"DATA_DIR": str(tmp_path)})
    assert [r["exit_status"] for r in record["per_file_results"]] == [1, 0] and record["failed_files"][0]["exit_status"] == 1
    assert record["files_attempted"] == 2 and record["files_successful"] == 1 and record["psms_q_lt_0_01"] is None
    benchmark.write_run(files, record, str(tmp_path / "out"))
    path = str(tmp_path / "out" / "rescora-result.json")
    row = benchmark.compare_runs(spark, path, path).first()
    assert row["ties"] == 1 and row["wins"] == row["losses"] == 0
    with pytest.raises(Exception):
        main = __import__("rescora.__main__", fromlist=["main"]).main
        main(["compare", path, path, str(tmp_path / "out" / "files.tsv")])


def test_dataset_command(spark, tmp_path, monkeypatch, capsys):
    from rescora.__main__ import main

    matches.write_matches(table(spark).coalesce(1), ["f1", "f2"], str(tmp_path / "in"))
    next((tmp_path / "in").glob("part*.txt")).rename(tmp_path / "good.pin")
    (tmp_path / "m.toml").write_text(GOOD.replace("protein_level_evaluation = false", "protein_level_evaluation = true"))
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    words = ["dataset", "--manifest", str(tmp_path / "m.toml"), "--dataset", "d-1", "--output", str(tmp_path / "run"), "--profile", "fast"]
    assert main([*words, "--dry-run"]) == 0
    said = capsys.readouterr().out
    assert "/usr/bin/time" in said and "good.pin" in said and not (tmp_path / "run").exists()
    assert main(words) == 0
    row = results.read_runs(spark, str(tmp_path / "run" / "rescora-result.json")).first()
    assert row["proteins_q_lt_0_01"] is not None and row["per_file_results"][0]["proteins_q_lt_0_01"] == row["proteins_q_lt_0_01"]
    assert len(manifest.timing((tmp_path / "run" / "good" / "time.tsv").read_text())) == 2
    assert main([*words[:4], "none", *words[5:]]) == 2


def test_entrapment_report(spark, tmp_path):
    from rescora.__main__ import main
    from rescora.plans import benchmark

    head = "\t".join(results.MATCH_COLUMNS)
    row = lambda i, q, p: f"{i}\t1.0\t{q}\t0.1\tK.A.R\t{p}"
    (tmp_path / "svm.target.psms.tsv").write_text("\n".join([head, row(1, 0.0005, "P1"), row(2, 0.0005, "ENT_A"), row(3, 0.004, "P2;ENT_B"), row(4, 0.03, "ENT_C\tENT_D")]) + "\n")
    (tmp_path / "svm.decoy.psms.tsv").write_text("\n".join([head, row(5, 0.004, "DECOY_ENT_A"), row(6, 0.004, "decoy_P1"), row(7, 0.004, "DECOY_P1;DECOY_ENT_Q"), row(8, 0.004, "DECOY_P9")]) + "\n")
    (tmp_path / "mlp.target.psms.tsv").write_text("\n".join([head, row(1, 0.5, "P1")]) + "\n")
    files = [str(tmp_path / f"{m}.target.psms.tsv") for m in ("svm", "mlp")]
    rows = {(r["method"], r["cut"]): r for r in benchmark.entrapment_report(spark, files, 0.5).collect()}
    r = rows["svm", 0.001]
    # no decoy passes: the given fraction
    assert (r["accepted"], r["foreign"], r["mixed"], r["foreign_share"], r["fdp"]) == (2, 1, 0, 0.5, 1.0)
    r = rows["svm", 0.005]
    # a third of the decoys that aren't mixed
    assert (r["accepted"], r["foreign"], r["mixed"]) == (3, 1, 1) and r["foreign_share"] == pytest.approx(1 / 3) and r["fdp"] == pytest.approx(1.0)
    assert rows["svm", 0.05]["foreign"] == 2 and rows["mlp", 0.1]["fdp"] == rows["mlp", 0.1]["fdp_high"] == 0.0
    assert main(["entrapment", "--entrapment-fraction", "0.5", "--output", str(tmp_path / "report"), *files]) == 0
    text = next((tmp_path / "report").glob("part*")).read_text().splitlines()
    assert len(text) == 13 and text[0].startswith("method\tq_threshold\taccepted_targets")


def test_repeated_lines_are_rows_of_their_own(spark, tmp_path):
    from rescora.operators import learn

    head, *lines = regression_lines()[:60]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "r.pin").write_text("\n".join([head, *lines, lines[0], lines[0]]) + "\n")
    (tmp_path / "b" / "r.pin").write_text("\n".join([head, lines[0]]) + "\n")
    one, _ = matches.read_matches(spark, [str(tmp_path / "a" / "r.pin")])
    assert one.count() == one.select("row_id").distinct().count() == len(lines) + 2
    assert learn.rescored(one, Params(max_iter=1)).count() == len(lines) + 2
    both, _ = matches.read_matches(spark, [str(tmp_path / "*" / "r.pin")])
    assert both.select("source").distinct().count() == 2 and both.select("row_id").distinct().count() == len(lines) + 3
    again, _ = matches.read_matches(spark, [str(tmp_path / "a" / "r.pin")])
    ids = lambda d: sorted(r["row_id"] for r in d.select("row_id").collect())
    assert ids(one) == ids(again.repartition(5))


def test_marks_inside_headers(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">A a->b binding\nAC\nDE\n>B >x\n>C\nKK")
    df = spectra.read_fasta(spark, str(tmp_path / "f.fasta"))
    assert {(r["header"], r["sequence"]) for r in df.collect()} == {("A a->b binding", "ACDE"), ("B >x", ""), ("C", "KK")}


def test_callers_names_are_kept(spark):
    from rescora.operators import folds, targetdecoy

    df = table(spark).drop("features").selectExpr("*", "cast(row_id as double) AS score", "'mine' AS _t", "'mine' AS _D", "'mine' AS _pi0", "'mine' AS _b", "'mine' AS _r", "'mine' AS _draw")
    rows = [targetdecoy.qvalues(df), targetdecoy.qvalues(df, one_task=0), targetdecoy.peps(df), rollup.best_of(df, ["peptide"]), folds.assign_folds(df), rollup.interleaved_by_size(df.withColumn("size", F.col("scan")), name="spec_id")]
    for out in rows:
        assert set(df.columns) <= set(out.columns) and out.count() > 0
        for c in ("_t", "_D", "_pi0", "_b", "_r", "_draw"):
            assert {r[c] for r in out.select(c).distinct().collect()} == {"mine"}


def regression_lines():
    """260 lone targets, and 110 pairs of a target and a decoy protein with two peptides each."""
    lines = ["SpecId\tLabel\tScanNr\tXcorr\tPeptide\tProteins"]

    def add(name, label, score, peptide, protein):
        lines.append("\t".join([name, str(label), str(len(lines)), str(score), f"K.{peptide}.R", protein]))

    for i in range(1, 261):
        add(f"seed{i}", 1, 5000.0 - i, f"SEEDT{i}", f"SEEDPROT_{i}")
    for i in range(1, 111):
        t = 2000 - 2 * i
        add(f"t{i}a", 1, float(t), f"TGT{i}A", f"PROT_{i}")
        add(f"t{i}b", 1, t - 1 + 0.8, f"TGT{i}B", f"PROT_{i}")
        add(f"d{i}a", -1, t - 2 + 0.5, f"DEC{i}A", f"DECOY_PROT_{i}")
        add(f"d{i}b", -1, t - 3 + 0.3, f"DEC{i}B", f"DECOY_PROT_{i}")
    return lines


def drawn_folds(n, k=3):
    """Folds by a swap shuffle over a 64-bit shift generator from 1, for counts that depend on the draw."""
    order, x, mask = list(range(n)), 1, (1 << 64) - 1
    for i in range(n - 1, 0, -1):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        j = x % (i + 1)
        order[i], order[j] = order[j], order[i]
    out = [0] * n
    for place, row in enumerate(order):
        out[row] = place % k
    return out


def test_proteins_of_a_whole_file(spark, tmp_path):
    from rescora.operators import learn, proteins

    (tmp_path / "r.pin").write_text("\n".join(regression_lines()) + "\n")
    df, _ = matches.read_matches(spark, [str(tmp_path / "r.pin")])
    assert df.count() == 700
    fold = spark.createDataFrame(list(enumerate(drawn_folds(700))), "k long, fold int")
    df = df.withColumn("row_id", F.col("scan") - 1).join(fold, F.col("row_id") == F.col("k")).drop("k")
    scored = learn.rescored(df, Params(), folds=False).drop("features")
    peptides = pipeline.statistics(rollup.best_psm_of_peptide(scored))
    groups = proteins.infer_picked(peptides.select("row_id", "score", "pep", "proteins"))
    rows = groups.collect()
    targets = [g for g in rows if g["picked"] and not g["is_decoy"]]
    assert len(rows) == 480 and sum(g["picked"] for g in rows) == 370 and len(targets) == 338
    assert sum(g["q"] < 0.01 for g in targets) == 276
    assert proteins.classic_count(groups.select("component", "is_decoy", "score")).first()[0] == 263
    assert [sum(g["n_peptides"] == n for g in targets) for n in (1, 2)] == [260, 78]
    run = pipeline.rescore(df.drop("fold"), Params(protein_inference="bayesian"), infer_proteins=True)
    assert all(g["score"] + g["pep"] == pytest.approx(1) and 0 <= g["q"] <= 1 for g in run.proteins.collect())
