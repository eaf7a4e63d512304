import pytest
from pyspark.sql import functions as F

from rescora.functions import scalars as S
from rescora.operators import calibration, retention
from rescora.streaming import score as stream


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("text,core", [("K.PEP[16]R.A", "PEP[16]R"), ("A.B", "A.B"), ("ABC", "ABC"), ("..", ""), ("K.A.B.R", "A.B"), ("", "")])
def test_core(spark, text, core):
    assert one(spark, c=S.core_peptide(F.lit(text)))["c"] == core


def test_names(spark):
    r = one(
        spark, n=S.split_proteins(F.lit("A;B\t C;;")), d=S.is_decoy_protein(F.lit("rev_A")), t=S.is_decoy_protein(F.lit("XREV_A")),
        s=S.strip_decoy(F.lit("DECOY_DECOY_A")), k=S.pairing_key(F.array(F.lit("B"), F.lit("random-A"), F.lit("REV_B"))),
    )
    assert r["n"] == ["A", "B", "C"] and r["d"] and not r["t"] and r["s"] == "DECOY_A" and r["k"] == "A|B"


def test_probabilities(spark):
    r = one(spark, p=S.binomial_prior(F.lit(3.0), 0.5), n=S.normalise(F.array(F.lit(0.0), F.lit(0.0))), x=S.softmax(F.array(F.lit(-1000.0), F.lit(-1000.0))), e=S.emission(F.lit(0), 0.1, 0.01), o=S.odds_ratio(F.lit(0.0), 0.1))
    assert r["p"] == pytest.approx([1 / 8, 3 / 8, 3 / 8, 1 / 8]) and r["n"] == [0.5, 0.5] and r["x"] == [0.5, 0.5]
    assert r["e"] == pytest.approx(0.01) and r["o"] == 1e12


def test_numbers(spark):
    r = one(spark, a=S.lenient_int(F.lit("12ab3")), b=S.lenient_int(F.lit("-x4")), c=S.lenient_int(F.lit("none")), d=S.lenient_double(F.lit("inf")), e=S.lenient_double(F.lit("1d")), z=S.ratio(F.lit(1), F.lit(0)))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["z"]) == (123, -4, None, 0.0, 0.0, None)


def test_retention_fit_edges(spark):
    kind = "source string, label int, peptide string, scan long"
    rows = [("a", 1, "K.W.R", 10), ("b", -1, "K.W.R", 5), ("b", -1, "K.WW.R", 9), ("c", 1, "K.G.R", 4), ("c", 1, "K.G.R", 8)]
    got = {r["source"]: (r["slope"], r["intercept"]) for r in retention.fits(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"] == (1.0, 0.0) and got["c"] == (0.0, 6.0) and got["b"] == pytest.approx((4 / 11, 1.0))


def test_interval(spark):
    r = one(spark, w=calibration.wilson(F.lit(5), F.lit(100)), e=calibration.wilson(F.lit(0), F.lit(0)))
    assert (r["w"]["low"], r["w"]["high"]) == pytest.approx((0.02154, 0.11175), abs=1e-4) and r["e"]["low"] is None


def test_stream_with_a_fixed_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, -1, [3.0, 0.0])], "row_id long, label int, features array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scored = stream.accepted_stream(stream.with_fixed_model(source, [2.0, 1.0, 0.5], [1.0, 0.0], [1.0, 2.0]), 1.0)
    query = scored.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["row_id"], r["score"]) for r in spark.sql("SELECT * FROM scored").collect()] == [(1, 1.5)]


def test_each_step_of_a_softmax_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from rescora.functions import scalars as S

    shown = spark.range(1).select(S.binomial_prior(F.lit(3.0) + F.col("id"), 0.3).alias("p"))._jdf.queryExecution().analyzed().toString()
    # the sum of logarithms, and that of the shares
    assert shown.count("aggregate(") == 2
    rows = spark.createDataFrame([(150.0,)], "n double").select(S.binomial_prior(F.col("n"), 0.3).alias("p")).first()["p"]
    assert len(rows) == 151 and abs(sum(rows) - 1) < 1e-12 and rows.index(max(rows)) == 45
    odd = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, 3.0],), (None,)], "v array<double>").select(S.normalise(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in odd] == [[0.5, 0.5], [0.5, 0.5], [0.25, 0.75], None]


def test_ranks_in_a_group_come_with_its_size_in_one_join(spark):
    from rescora.operators import folds

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in range(100)], "row_id long, fold int")
    got = folds._ranked(rows, ["fold"], 1, "x")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    sizes = {}
    for r in got.collect():
        assert r["_n"] == {None: 15, 0: 42, 1: 43}[r["fold"]]
        sizes.setdefault(r["fold"], []).append(r["_k"])
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
