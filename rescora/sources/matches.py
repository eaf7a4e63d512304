"""Tab-separated match inputs (.pin): reading into the canonical table, pooling, and writing.

Canonical columns: row_id, source, spec_id, label, scan, peptide, proteins, features. row_id is a file's number and a
line's offset in it. Lines that come from elsewhere have a hash of source and line; of equal lines, each further one has
a hash of that and its number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import label_of, lenient_double, lenient_int
from ..operators.ordering import running_sum
from .lines import head_of, read_lines

SKIPPED = ("ExpMass", "CalcMass")
#: Bits of a file's number within an engine's files.
ENGINE_BITS = 14


@dataclass(frozen=True)
class Layout:
    """Where a file's columns are: found by name in any case, features between scan and peptide."""

    columns: tuple[str, ...]

    def at(self, name: str) -> int:
        for k, c in enumerate(self.columns):
            if c.lower() == name.lower():
                return k
        raise ValueError(f"no column {name} in the header")

    @property
    def features(self) -> list[tuple[int, str]]:
        first, last = self.at("ScanNr"), self.at("Peptide")
        return [(k, c) for k, c in enumerate(self.columns) if first < k < last and c not in SKIPPED]


def discover(spark: SparkSession, patterns: Sequence[str], count: int | None = None) -> list[str]:
    """Paths of the files that match, sorted; none at all, or another number than asked for, is an error."""
    found = spark.read.format("binaryFile").load(list(patterns)).select("path").distinct().collect()
    paths = sorted(r["path"] for r in found)
    if not paths or count is not None and len(paths) != count:
        raise ValueError(f"{len(paths)} files match {', '.join(patterns)}" + ("" if count is None else f", not {count}"))
    return paths


def _inventory(spark: SparkSession, patterns: Sequence[str]) -> list[dict]:
    """path, bytes, header, direction and body (where lines begin) of each file, sorted; one job reads all heads.

    Spark lists no files of 0 bytes.
    """
    import pyarrow as pa

    def heads(batches):
        for b in batches:
            rows = [(p, n, *head_of(p)) for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "bytes", "header", "direction", "body"])

    files = spark.read.format("binaryFile").load(list(patterns)).select("path", "length")
    found = files.mapInArrow(heads, "path string, bytes long, header string, direction string, body long").collect()
    if not found:
        raise ValueError(f"0 files match {', '.join(patterns)}, or all that do are empty")
    if empty := [r["path"] for r in found if r["header"] is None]:
        raise ValueError(f"{empty[0]} is empty")
    return sorted((r.asDict() for r in found), key=lambda r: r["path"])


class LineCounts:
    """How many lines of each file are matches and how many too short, counted while the table is read the first time."""

    def __init__(self):
        self._parts: list[tuple[Observation, list[str], int]] = []

    def counted(self, lines: DataFrame, whole: Column, files: list[str], first: int) -> DataFrame:
        """`lines` under observation: as many histogram cells as files, so each file has its own count."""
        seen = Observation(f"lines-{uuid.uuid4().hex}")
        self._parts.append((seen, files, first))
        cells = F.lit(max(len(files), 2))
        kept, dropped = (F.histogram_numeric(F.when(on, F.col("number")), cells) for on in (whole, ~whole))
        return lines.observe(seen, kept.alias("kept"), dropped.alias("dropped"))

    def by_file(self) -> list[dict]:
        """input, kept and dropped; waits until a job has read the table."""
        out = []
        for seen, files, first in self._parts:
            got = {k: {round(c["x"]): int(c["y"]) for c in v or ()} for k, v in seen.get.items()}
            out += [{"input": f, "kept": got["kept"].get(k, 0), "dropped": got["dropped"].get(k, 0)} for k, f in enumerate(files, first)]
        return out


def source_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """Append row_id, a hash of `key` that no other row has: of rows with equal keys, the first keeps it.

    Rows with equal keys are counted by the partition that they are read in, so that no task has all copies of a hot
    row; which of equal rows gets which number makes no difference.
    """
    rows = rows.withColumn("_id", F.xxhash64(*key)).withColumn("_at", F.spark_partition_id())
    rows = running_sum(rows, {"_no": F.lit(1).cast("long")}, ["_id"], "_at", [F.col(k) for k in key])
    own = F.when(F.col("_no") == 1, F.col("_id")).otherwise(F.xxhash64("_id", "_no"))
    return rows.withColumn("row_id", own).drop("_id", "_at", "_no")


def parsed(lines: DataFrame, layout: Layout) -> DataFrame:
    """Canonical rows of lines (source, value, and row_id, or file where sources don't tell files apart); too short ones drop out.

    Unreadable numbers are 0; a label above 0 is a target, all else a decoy; everything after the peptide is proteins.
    """
    f = F.split("value", "\t", -1)
    rows = lines.withColumn("value", F.regexp_replace("value", "\r$", "")).where((F.col("value") != "") & _whole(layout))
    if "row_id" not in lines.columns:
        rows = numbered(rows, "file" if "file" in lines.columns else "source", "value")
    rows, last = rows.withColumn("f", f), layout.at("Peptide")
    field = lambda k: F.get("f", F.lit(k))
    scan = F.coalesce(lenient_int(field(layout.at("ScanNr"))), F.lit(0).cast("long"))
    return rows.select(
        "row_id", "source", field(0).alias("spec_id"),
        label_of(field(layout.at("Label"))).alias("label"), scan.alias("scan"), field(last).alias("peptide"),
        F.array_join(F.slice("f", last + 2, F.greatest(F.size("f") - last - 1, F.lit(0))), "\t").alias("proteins"),
        F.array(*[lenient_double(field(k)) for k, _ in layout.features]).alias("features"),
    )


def _whole(layout: Layout) -> Column:
    return F.size(F.split("value", "\t", -1)) > layout.at("Peptide")


def read_matches(spark: SparkSession, paths: Sequence[str], counts: LineCounts | None = None, first: int = 0) -> tuple[DataFrame, list[str]]:
    """All files as one canonical table, and the feature names; their layouts must have the same features.

    Files with one header are one scan. row_id is the file's number, from `first` on in order of paths, and the line's
    offset, so rows are in order of files and lines and have the same ids in any partitioning.
    """
    found = _inventory(spark, paths)
    # files of one name in several folders are told apart by their paths
    plain = len({r["path"].rsplit("/", 1)[-1] for r in found}) == len(found)
    by: dict[Layout, list[dict]] = {}
    for r in found:
        by.setdefault(Layout(tuple(r["header"].split("\t"))), []).append(r)
    names = {tuple(n for _, n in k.features) for k in by}
    if len(names) > 1:
        raise ValueError("the inputs have different features")
    tables = []
    for layout, files in by.items():
        own = [r["path"] for r in files]
        lines = read_lines(spark, [(r["path"], r["bytes"], r["body"]) for r in files], first)
        lines = lines.withColumn("source", source_name(F.col("file")) if plain else F.col("file"))
        if counts is not None:
            lines = counts.counted(lines, _whole(layout), own, first)
        first += len(files)
        tables.append(parsed(lines, layout))
    return reduce(DataFrame.unionByName, tables), list(names.pop())


def read_engines(spark: SparkSession, inputs: dict[str, str], counts: LineCounts | None = None) -> tuple[DataFrame, list[str]]:
    """Engines' files of one run as one table, features namespaced by engine, two agreement counts last."""
    from ..operators.rollup import join_engines

    if len(inputs) < 2 or not all(inputs):
        raise ValueError("an ensemble needs two named engines at least")
    tables, widths, names = [], {}, [f"engine={e}" for e in inputs]
    for k, (engine, path) in enumerate(inputs.items()):
        # engines' files have numbers of their own
        rows, features = read_matches(spark, [path], counts, k << ENGINE_BITS)
        widths[engine] = len(features)
        names += [f"{engine}:{x}" for x in features]
        tables.append(rows.withColumn("source", F.lit(engine)))
    both = reduce(DataFrame.unionByName, tables)
    return join_engines(both, list(inputs), widths), [*names, "spectrum_engines", "candidate_engines"]


def write_matches(df: DataFrame, names: Sequence[str], path: str) -> None:
    """Canonical rows as text: one folder of files, each with the header first."""
    header = "\t".join(["SpecId", "Label", "ScanNr", *names, "Peptide", "Proteins"])
    fields = ["spec_id", F.col("label").cast("string"), F.col("scan").cast("string")]
    features = [F.get("features", F.lit(k)).cast("string") for k in range(len(names))]
    lines = df.select(F.concat_ws("\t", *fields, *features, "peptide", "proteins").alias("value"))
    # the header is the first line of each file, so each file can be read by itself
    lines.withColumn("_p", F.spark_partition_id()).mapInPandas(_headed(header), "value string").write.text(path)


def _headed(header: str):
    import pandas as pd

    def run(batches):
        yield pd.DataFrame({"value": [header]})
        for b in batches:
            yield b[["value"]]

    return run


# Columns of one search tool's files that can't be features, and the scan number inside its spectrum titles.
TOOL_COLUMNS = ("posterior_error", "ion_mobility", "predicted_mobility", "sqrt(delta_mobility)")
TITLE_SCAN = r"#(\d+)(?:\D.*)?$"


def normalised_titles(df: DataFrame, row_number: str) -> DataFrame:
    """A table with all columns of a file, without TOOL_COLUMNS; ScanNr is the number after #, or the row's number."""
    found = F.regexp_extract("ScanNr", TITLE_SCAN, 1)
    out = df.withColumn("ScanNr", F.when(found != "", found).otherwise(F.col(row_number).cast("string")))
    return out.drop(*[c for c in TOOL_COLUMNS if c in out.columns], row_number)
