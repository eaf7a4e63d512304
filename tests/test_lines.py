"""Match lines by byte ranges, counts of what is dropped, and one result file in order."""

import gzip

import pytest
from pyspark.sql import functions as F

from rescora.__main__ import main
from rescora.sources import lines, matches, results

HEAD = "SpecId\tLabel\tScanNr\tXcorr\tDelta\tPeptide\tProteins"


def text_of(n, tag, direction=False, end="\n"):
    """Lines of several lengths: quotes, ragged tails, short and empty ones, wide characters."""
    own = [HEAD] + ([f"DefaultDirection\t-\t-\t1\t0\t\t"] if direction else [])
    for i in range(n):
        own.append(f'{tag}"{i}\t{1 if i % 3 else -1}\t{i}\t{i / 7:.3f}\t.5\tK.PÉP"{"日" * (i % 5)}.R' + "".join(f"\tP{k}" for k in range(i % 4)))
        if i % 6 == 0:
            own.append("short\t1")
        if i % 7 == 0:
            own.append("")
    return end.join(own) + (end if n % 2 else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_any_size_give_the_same_lines(tmp_path, end):
    path = tmp_path / "a.pin"
    path.write_bytes(text_of(41, "a", True, end).encode())
    size = path.stat().st_size
    whole = list(lines.lines_of(str(path), 0, None))
    data = path.read_bytes()
    assert [data[at : at + len(line)] for at, line in whole] == [line for _, line in whole]
    for step in (1, 7, 64, 1000, size):
        assert [x for at in range(0, size, step) for x in lines.lines_of(str(path), at, min(at + step, size))] == whole
    header, direction, body = lines.head_of(str(path))
    assert header == HEAD and direction.startswith("DefaultDirection") and data[body:].startswith(b'a"0')


def test_files_are_read_in_ranges_with_stable_ids(spark, tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"f{k:02}.pin").write_bytes(text_of(20 + k, f"f{k}", k % 4 == 0, "\r\n" if k % 2 else "\n").encode())
    got = {}
    for step in (97, 1 << 20):
        monkeypatch.setattr(matches, "read_lines", lambda s, files, first=0, step=step: lines.read_lines(s, files, first, step))
        df, names = matches.read_matches(spark, [str(tmp_path / "*.pin")])
        got[step] = sorted(map(tuple, df.select("row_id", "source", "spec_id", "label", "scan", "peptide", "proteins", "features").collect()))
        assert names == ["Xcorr", "Delta"]
    assert got[97] == got[1 << 20] and len({r[0] for r in got[97]}) == len(got[97]) == sum(20 + k for k in range(30))
    # rows are in order of files and lines
    assert [(r[1], r[2]) for r in got[97]] == [(f"f{k:02}.pin", f'f{k}"{i}') for k in range(30) for i in range(20 + k)]
    r = got[97][5]
    assert r[5] == 'K.PÉP".R' and r[6] == "P0" and r[7] == [0.714, 0.5]


def test_the_heads_of_all_files_are_one_job(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k:02}.pin").write_text(text_of(5, f"f{k}", k % 2 == 0))
    spark.sparkContext.setJobGroup("heads", "heads")
    try:
        matches.read_matches(spark, [str(tmp_path / "*.pin")])
        found = spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 1


def test_packed_files_and_files_without_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.pin.gz", "wb") as f:
        f.write(text_of(12, "a", True).encode())
    (tmp_path / "b.pin").write_text(HEAD)
    df, _ = matches.read_matches(spark, [str(tmp_path / "*pin*")])
    assert sorted(r["spec_id"] for r in df.collect()) == sorted(f'a"{i}' for i in range(12))
    one, _ = matches.read_matches(spark, [str(tmp_path / "b.pin")])
    assert one.collect() == []
    (tmp_path / "none.pin").write_text("")
    with pytest.raises(ValueError, match="are empty"):
        matches.read_matches(spark, [str(tmp_path / "none.pin")])
    with gzip.open(tmp_path / "void.pin.gz", "wb"):
        pass
    with pytest.raises(ValueError, match="void.pin.gz is empty"):
        matches.read_matches(spark, [str(tmp_path / "void.pin.gz")])


def test_dropped_lines_are_counted_by_file_as_they_are_read(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.pin").write_text(text_of(13 * k, f"f{k}"))
    (tmp_path / "g.pin").write_text(HEAD.replace("SpecId", "id") + "\nx\t1\n")
    counts = matches.LineCounts()
    df, _ = matches.read_matches(spark, [str(tmp_path / "*.pin")], counts)
    n = df.count()
    found = {r["input"].rsplit("/", 1)[-1]: (r["kept"], r["dropped"]) for r in counts.by_file()}
    assert found == {f"f{k}.pin": (13 * k, -(-13 * k // 6)) for k in range(5)} | {"g.pin": (0, 1)}
    assert n == sum(k for k, _ in found.values())


def match_rows(spark, n):
    rows = [(i, f"s{i}", float(-i % 97), 0.01, 0.1, "K.A.R", "P\tQ") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, spec_id string, score double, q double, pep double, peptide string, proteins string").repartition(5)


def test_one_result_file_in_order(spark, tmp_path):
    path = tmp_path / "deep" / "psms.tsv"
    results.write_match_results(match_rows(spark, 500), str(path), one_file=True)
    got = path.read_text().splitlines()
    assert got[0] == "\t".join(results.MATCH_COLUMNS) and len(got) == 501
    want = sorted(range(500), key=lambda i: (-float(-i % 97), i))
    assert [x.split("\t")[0] for x in got[1:]] == [f"s{i}" for i in want]
    assert [p.name for p in path.parent.iterdir()] == ["psms.tsv"]
    with pytest.raises(Exception, match="there already"):
        results.write_match_results(match_rows(spark, 3), str(path), one_file=True)
    assert len(path.read_text().splitlines()) == 501 and [p.name for p in path.parent.iterdir()] == ["psms.tsv"]
    results.write_match_results(match_rows(spark, 0), str(tmp_path / "none.tsv"), one_file=True)
    assert (tmp_path / "none.tsv").read_text() == "\t".join(results.MATCH_COLUMNS) + "\n"


def test_an_aborted_file_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out" / "x.tsv"
    rows = match_rows(spark, 50).select(F.when(F.col("row_id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("spec_id")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        lines.write_ordered(rows, str(path), "head")
    assert not path.exists() and list(path.parent.glob("*")) == []


def test_the_log_has_lines_by_file_and_results_are_files(spark, tmp_path, capsys):
    (tmp_path / "r.pin").write_text(text_of(90, "r"))
    out = tmp_path / "psms.tsv"
    assert main([str(tmp_path / "r.pin"), "-m", str(out), "--maxiter", "2", "--rt-features", "--feature-report", str(tmp_path / "report")]) == 0
    assert out.read_text().splitlines()[0] == "\t".join(results.MATCH_COLUMNS) and len(out.read_text().splitlines()) == 61
    import json

    log = json.loads(next(x for x in capsys.readouterr().err.splitlines() if x.startswith("{")))
    assert [(r["kept"], r["dropped"]) for r in log["inputs"]] == [(90, 15)]
    report = next((tmp_path / "report").glob("part*")).read_text().splitlines()
    assert [x.split("\t")[1] for x in report[5:]] == ["Xcorr", "Delta", "rt_abs_error", "rt_sq_error"]
