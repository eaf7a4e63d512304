"""Protein groups from shared peptides, and picked target-decoy competition.

Entries have row_id, score, pep and proteins (raw names), one for each peptide-level match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, is_decoy_protein, pairing_key, split_proteins
from ..session import materialise
from .components import connected_components
from .targetdecoy import ONE_TASK, TEST_FDR, qvalues, yield_at


def protein_edges(entries: DataFrame) -> DataFrame:
    """row_id and protein, once for each distinct pair."""
    return entries.select("row_id", F.explode(F.array_distinct(split_proteins(F.col("proteins")))).alias("protein"))


def protein_components(entries: DataFrame) -> DataFrame:
    """protein and component: the first name among all that share peptides, directly or in turn."""
    names = F.array_distinct(split_proteins(F.col("proteins")))
    rows = entries.select(names.alias("p")).where(F.size("p") > 1)
    links = rows.select(F.get("p", F.lit(0)).alias("a"), F.explode(F.slice("p", 2, 1 << 30)).alias("b"))
    found = connected_components(links, one_task=ONE_TASK)
    every = protein_edges(entries).select("protein").distinct()
    return every.join(found, every.protein == found.node, "left").select("protein", F.coalesce("component", "protein").alias("component"))


def group_evidence(entries: DataFrame, components: DataFrame) -> DataFrame:
    """A row for each group: members, the score of its best peptide (lowest error, then score), pep, n_peptides, is_decoy.

    Entries without proteins are left out. A peptide's proteins are in one group, so its first name leads there.
    """
    names = split_proteins(F.col("proteins"))
    rows = entries.select("row_id", "score", clamp(F.col("pep"), 1e-12, 1.0).alias("pep"), F.get(names, F.lit(0)).alias("first"))
    rows = rows.where("first IS NOT NULL").join(components, F.col("first") == F.col("protein"))
    best = F.min(F.struct("pep", (-F.col("score")).alias("minus")))
    groups = rows.groupBy("component").agg(best.alias("b"), F.count(F.lit(1)).alias("n_peptides"))
    members = components.groupBy("component").agg(
        F.array_sort(F.collect_set("protein")).alias("proteins"), F.bool_or(is_decoy_protein(F.col("protein"))).alias("is_decoy")
    )
    return groups.join(members, "component").select(
        "component", "proteins", (-F.col("b.minus")).alias("score"), F.col("b.pep").alias("pep"), "n_peptides", "is_decoy"
    )


def pick(groups: DataFrame) -> DataFrame:
    """Append key and picked: of the groups with one pairing key the higher score stays; targets win ties."""
    rows = groups.withColumn("key", pairing_key(F.col("proteins")))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("is_decoy").asc(), F.col("component").asc())
    return rows.withColumn("picked", F.row_number().over(order) == 1)


def picked_qvalues(groups: DataFrame) -> DataFrame:
    """Append q: over picked groups with pi0 1; 1 for the others."""
    rows = pick(groups).withColumns({"label": F.when(F.col("is_decoy"), -1).otherwise(1), "row_id": F.col("component")})
    q = qvalues(rows.where("picked"), pi0=1.0).select(F.col("component").alias("_c"), "q")
    out = rows.join(q, F.col("component") == F.col("_c"), "left")
    return out.withColumn("q", F.coalesce("q", F.lit(1.0))).drop("_c", "label", "row_id")


def classic_count(groups: DataFrame, fdr: float = TEST_FDR) -> DataFrame:
    """How many target groups pass without picking."""
    rows = groups.withColumns({"label": F.when(F.col("is_decoy"), -1).otherwise(1), "row_id": F.col("component")})
    return qvalues(rows, pi0=1.0).agg(yield_at(fdr).alias("accepted"))


def infer_picked(entries: DataFrame) -> DataFrame:
    """Groups of the entries with their q-values; written once, since every step reads them."""
    return picked_qvalues(groups(entries))


def groups(entries: DataFrame) -> DataFrame:
    """group_evidence() as a written table, over a written one of components, which it reads twice."""
    components = materialise(protein_components(entries), "components")
    return materialise(group_evidence(entries, components), "groups")
