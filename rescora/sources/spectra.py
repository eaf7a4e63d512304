"""Search results in XML: one row for each hit, read by Spark's own XML source, in two passes.

The first pass finds the names of all scores, the second builds the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import charge_features, minus_log10
from .matches import numbered

#: Mass of a proton.
PROTON = 1.00727646688

_SCORE = "array<struct<_name string, _value double>>"
_MODIFIED = "struct<_mod_nterm_mass string, _mod_cterm_mass string, mod_aminoacid_mass array<struct<_position int, _mass string>>>"
_HIT = (
    "struct<_hit_rank string, _peptide string, _protein string, _calc_neutral_pep_mass double, _num_missed_cleavages double, _num_tol_term double,"
    f" _num_matched_peptides double, alternative_protein array<struct<_protein string>>, modification_info {_MODIFIED}, search_score {_SCORE}>"
)
SCHEMA = (
    "_spectrum string, _end_scan long, _assumed_charge int, _precursor_neutral_mass double, _retention_time_sec double,"
    f" search_result struct<search_hit array<{_HIT}>>"
)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """spectrum columns and hit."""
    rows = spark.read.format("xml").option("rowTag", "spectrum_query").option("ignoreNamespace", "true").schema(SCHEMA).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("hit", F.explode("search_result.search_hit")).drop("search_result")


def modified_peptide(hit: Column) -> Column:
    """The sequence with masses in brackets after the residues they modify, before the first and after the last."""
    info, peptide = hit["modification_info"], hit["_peptide"]
    mods = F.coalesce(info["mod_aminoacid_mass"], F.array().cast("array<struct<_position int, _mass string>>"))
    at = F.transform(
        F.sequence(F.lit(1), F.char_length(peptide)),
        lambda k: F.concat(
            F.substring(peptide, k, F.lit(1)),
            F.array_join(F.transform(F.filter(mods, lambda m: m["_position"] == k), lambda m: F.concat(F.lit("["), m["_mass"], F.lit("]"))), ""),
        ),
    )
    mark = lambda m: F.coalesce(F.concat(F.lit("["), m, F.lit("]")), F.lit(""))
    return F.concat(mark(info["_mod_nterm_mass"]), F.array_join(at, ""), mark(info["_mod_cterm_mass"]))


def score_names(hits: DataFrame) -> list[str]:
    names = hits.select(F.explode("hit.search_score._name").alias("n")).distinct().orderBy("n")
    return [r["n"] for r in names.collect()]


def as_matches(hits: DataFrame, names: list[str], decoy_prefix: str = "rev_") -> tuple[DataFrame, list[str]]:
    """Canonical rows and feature names. A hit is a target if any of its proteins is."""
    h = F.col("hit")
    first = lambda p: F.element_at(F.split(p, " "), 1)
    others = F.coalesce(h["alternative_protein"], F.array().cast("array<struct<_protein string>>"))
    prot = F.concat(F.array(first(h["_protein"])), F.transform(others, lambda p: first(p["_protein"])))
    charge, mass, calc = F.col("_assumed_charge"), F.col("_precursor_neutral_mass"), h["_calc_neutral_pep_mass"]
    value = lambda n, missing: F.coalesce(F.get(F.filter(h["search_score"], lambda s: s["_name"] == n), F.lit(0))["_value"], F.lit(missing))
    rank = F.coalesce(h["_hit_rank"], F.lit("1"))
    number = lambda c, missing: F.coalesce(c, F.lit(float(missing)))
    fixed = {
        "retentiontime": number(F.col("_retention_time_sec"), 0), "rank": rank.cast("double"), "missed_cleavages": number(h["_num_missed_cleavages"], 0),
        "ntt": number(h["_num_tol_term"], 0), "num_matched_peptides": number(h["_num_matched_peptides"], 1), "peptide_length": F.char_length(h["_peptide"]).cast("double"),
        "mass_diff": mass - calc, "abs_mz_diff": F.abs((mass - calc) / charge), "NegLog10Expect": minus_log10(value("expect", 1.0)),
    }
    features = F.concat(F.array(*fixed.values(), *[value(n, 0.0) for n in names]), charge_features(charge))
    label = F.when(F.exists(prot, lambda p: ~p.startswith(decoy_prefix)), 1).otherwise(-1)
    spec = F.concat_ws("_", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""), F.col("_end_scan").cast("string"), charge.cast("string"), rank)
    rows = hits.select(
        spec.alias("spec_id"), label.alias("label"), F.col("_end_scan").alias("scan"), modified_peptide(h).alias("peptide"),
        F.array_join(prot, "\t").alias("proteins"), features.alias("features"), F.element_at(F.split("file", "/"), -1).alias("source"), F.col("file").alias("_file"),
    )
    out = numbered(rows.withColumn("file", F.col("_file")), "file", "spec_id", "peptide").drop("file", "_file")
    return out, [*fixed, *names, *[f"Charge{z}" for z in range(1, 8)]]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """source, header and sequence; lines of a record are put together. Compressed files are read as they are.

    A record begins with ">" at the start of a line; the file's first line is one.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("p"), F.regexp_replace("value", r"\A\s*>", "").alias("value"))
    rows = rows.where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    return rows.select(
        F.element_at(F.split("p", "/"), -1).alias("source"), F.rtrim(F.get(parts, F.lit(0))).alias("header"),
        F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"),
    )


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value")).write.text(path)


def entrapment_names(foreign: DataFrame) -> DataFrame:
    """Foreign records under names that show them as such: ENT_, the file's tag, the accession."""
    tag = F.upper(F.element_at(F.split("source", r"\."), 1))
    accession = F.replace(F.element_at(F.split("header", r"\s"), 1), F.lit("|"), F.lit("_"))
    return foreign.withColumn("header", F.concat(F.lit("ENT_"), tag, F.lit("_"), accession))
