"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.llm import collisions, forest, fptree, hilbert, infill, language, leaks, licences, lines, names, packing, piececount, warc
from splitguard.storage import materialize, shared_folder

N_SHARDS = 16
TOKEN_LIMIT = 4096


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, also if it is not installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licences.licences(table(spark, sf_dir, "documents"))


def op2_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, exactly or within the edit budget."""
    return leaks.leak_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back as chunks; per page its record."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark).rstrip('/')}/splitguard/{uuid.uuid4().hex}/archives"
    warc.write_archives(warc.revisit_plan(pages), path)
    records = warc.record_ends(warc.read_chunks(spark, path, with_data=False))
    id_type = pages.schema["page_id"].dataType
    return records.select(
        F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


def op4_line_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over documents; per document its counts and the hash of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_keeps(docs, lines.line_keeps(docs))
    return kept.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among documents: links at 85 percent of shared 5-word shingles."""
    return forest.near_copies(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a sentencepiece model."""
    counts = piececount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents along a Hilbert curve through size, source and language, cut into shards of equal row counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    docs = materialize(docs, "metadata")
    cuts = hilbert.step_cuts(docs, ["size", "source", "lang"])
    axes = [hilbert.steps_by(F.col(c), own) for c, own in cuts.items()]
    sharded = hilbert.curve_runs(docs, axes, ["doc_id", "text_crc32"], N_SHARDS)
    return sharded.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among documents, found by block names."""
    copies = names.exact_copies(table(spark, sf_dir, "documents"))
    return copies.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return fptree.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return collisions.nearest(collisions.index_vectors(vectors), vectors.filter("vec_id % 50 = 0"), k=5)


def op13_chunk_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document turned for filling in the middle, cut between lines, and turned back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = infill.fill_in_middle(docs, seed=7, fim_percent=100, spm_percent=50)
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_sentences, op2_edit_leaks, op3_warc_chunks, op4_line_keeps, op5_lsh_forest, op6_token_counts, op7_hilbert_shards,
        op8_language_id, op9_block_names, op10_best_fit, op11_fp_tree, op12_collision_counts, op13_chunk_infill,
    )
}
