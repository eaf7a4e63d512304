"""The queries of this subpackage: operators over whole tables, with the digest columns of their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round(F.get("positions", F.lit(0)), 6).alias("position"),
    )
    order = F.coalesce(F.col("position"), F.lit(2.0))
    return out.repartitionByRange(shuffle_partitions(spark), order, "doc_id").sortWithinPartitions(order, "doc_id")


def op2_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    rows = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16, compact=True)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import add_sketch, as_text, edited, in_ranges, likeness

    rows, order = in_ranges(table(spark, sf_dir, "documents"))
    rows = add_sketch(rows.withColumn("_next", F.lead("text").over(order)), "text", "_s")
    rows = rows.withColumn("_s_next", F.lead("_s").over(order)).where("_guest = 0")
    rows = add_sketch(rows.withColumn("_edited", edited(F.col("text"), F.col("_next"))), "_edited", "_s_edited")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("_s")).alias("fingerprint"),
        as_text(F.col("_s_edited")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_s_edited")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_s_next")).alias("near_next"),
    )


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, with_score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    out = components(table(spark, sf_dir, "documents"), k=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_common_lines

    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenids import default_folder, read_ids, write_ids

    folder = default_folder(spark)
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, folder)


def op8_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    # a dialogue may have a third of all turns, so rows are parts of it
    rows = rotate(table(spark, sf_dir, "conversations"), part=512)
    return rows.select("conv_id", "part", "speaker", "text", F.array_join(spans, ",").alias("mask"), "n_turns", "n_spoken")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import default_folder, read_warc, write_warc

    index = write_warc(table(spark, sf_dir, "pages"), default_folder(spark))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode, n_ids

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    rows = decode(rows.select("doc_id", "ids"), vocabulary)
    return rows.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_kdtree": op2_kdtree,
    "op3_sketch": op3_sketch,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_lines": op6_lines,
    "op7_tokens": op7_tokens,
    "op8_rotation": op8_rotation,
    "op9_decontam": op9_decontam,
    "op10_warc": op10_warc,
    "op11_bpe": op11_bpe,
    "op12_whitening": op12_whitening,
    "op13_audit": op13_audit,
}
