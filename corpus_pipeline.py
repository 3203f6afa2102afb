"""The corpus pipeline: five stages over ``documents``, each one operator, each writing what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.llm import forest, language, leaks, names, packing
from splitguard.llm.queries import let_workers_import, table, tokenizer
from splitguard.storage import materialize

MIN_SCORE = 0.2  # a language less certain than this is no language
NEAR_PERCENT = 80  # shared 5-word shingles from which documents are near copies
TELLING_BYTES = 20  # a shorter benchmark item is a phrase that clean documents hold too


def _with_ids(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``keep`` (columns doc_id and maybe mark); NULL meets NULL."""
    right = keep.select(*[F.col(c).alias(f"_keep_{c}") for c in keep.columns])
    same = docs["doc_id"].eqNullSafe(right["_keep_doc_id"])
    if "mark" in keep.columns:
        same = same & (names.row_mark(docs["text"]) == right["_keep_mark"])
    return docs.join(right, same, "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the models know; a text without letters, or NULL, goes."""
    let_workers_import(spark)
    known = language.languages(docs).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return known.select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the smallest id."""
    let_workers_import(spark)
    return _with_ids(docs, names.exact_copies(docs).filter("kept").select("doc_id", "mark"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies."""
    let_workers_import(spark)
    return _with_ids(docs, forest.near_copies(docs, percent=NEAR_PERCENT).filter("kept").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item of TELLING_BYTES or more, exactly or within its edit budget."""
    matches = leaks.leak_matches(docs, table(spark, sf_dir, "benchmark")).filter(F.col("item_bytes") >= TELLING_BYTES)
    found = matches.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    let_workers_import(spark)
    return packing.packed_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pack", pack),
]

#: SQL can express neither the fitted models nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
