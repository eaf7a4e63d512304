import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rescora.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        last = name == corpus_pipeline.STAGES[-1][0]
        assert docs.columns == columns + (["shard", "slot"] if last else []), name
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == counts[-1] == docs.select("doc_id").distinct().count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontam.decontaminate(docs, bench).where("n_hit > 0").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4] > 0


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_on_awkward_rows(spark, docs, none, nulls, name, stage):
    """Nulls, empty and long texts, repeated rows, an empty table, and further columns whose names operators use."""
    for table in (docs, none, nulls, docs.withColumns({c: F.lit(f"mine {c}") for c in ("score", "size", "taken", "n_hit", "_id", "_row", "slot")})):
        table = corpus_pipeline.materialise(table, "stage-input")
        out = corpus_pipeline.materialise(stage(spark, table, SF), "stage-output")
        more = ["shard", "slot"] if name == "sharding" else []
        assert out.columns == [c for c in table.columns if c not in more] + more
        if not table.count():
            assert out.count() == 0
        for c in ("score", "size", "taken", "n_hit", "_id", "_row"):
            if c in table.columns:
                assert {r[c] for r in out.select(c).distinct().collect()} <= {f"mine {c}"}
        again = corpus_pipeline.materialise(stage(spark, table.repartition(5), SF), "stage-output")
        if name not in ("mixing", "sharding"):
            assert rows_of(again) == rows_of(out)
        else:
            assert again.count() == out.count()
    if name == "near_dedup":
        texts = [r["text"] or "" for r in stage(spark, docs, SF).collect()]
        assert texts.count("") == 1 and len(texts) == len(set(texts))


def test_an_empty_table_goes_through_all_stages(spark, none):
    rows = none
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, SF), f"empty-{name}")
    assert rows.count() == 0 and rows.columns[-2:] == ["shard", "slot"]


def test_rows_of_one_id_and_text_keep_the_same_one(spark):
    made = [(7, "one text of several words here", "en", f"s{k}", k) for k in range(12)] + [(8, "another text", "de", None, None)]
    kept = {rows_of(simhash.keep_one(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(k)))[0] for k in (1, 3, 7)}
    assert len(kept) == 1


def test_near_dedup_takes_proposals_of_the_fingerprints_and_checks_them(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    # one copy with a word changed; a text of the same repeated line whose other shingles differ has a near fingerprint only
    line = " ".join(f"x{k}" for k in range(9))
    made = [" ".join(words), " ".join([*words[:200], "other", *words[201:]]), (line + " ") * 300 + " ".join(words[:12]), (line + " ") * 300 + " ".join(words[50:62])]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    found, proposed = [], simhash.proposals
    monkeypatch.setattr(simhash, "proposals", lambda rows: (found.extend(map(tuple, proposed(rows).collect())), proposed(rows))[1])
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert len(found) >= 1  # the two texts of one repeated line, which the exact check keeps apart
