"""The frames the registered queries run on, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.functions.records import identity_key, row_key, token_set, word_shingles
from splitguard.operators.prepare import project_record
from splitguard.operators.splits import random_split

LABEL_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_documents(spark: SparkSession, sf_dir: str, label_rows: int = LABEL_ROWS) -> DataFrame:
    """All documents, with their labels where there are some.

    Features cost far more than their texts are large, so where the table is read in fewer parts than there are cores, as a small
    one is, the texts are dealt out over all cores. A larger one is worked on where it is read. Up to LABEL_ROWS labels are broadcast (some 100 MB), so that texts
    without one are left out where they are read instead of being sent to meet it; more of them join by shuffle.
    """
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "record_id")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "record_id")
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.rdd.getNumPartitions() < cores
    if labels.count() <= label_rows:
        labels = F.broadcast(labels)
    joined = docs.join(labels, "record_id", "left")
    return joined.repartition(parts, "record_id") if dealt else joined


def document_frame(
    spark: SparkSession, sf_dir: str, label: str = "quality", dataset: str | None = None, runs: bool = False
) -> DataFrame:
    """All documents: key = normalised text, features = tokens or runs of three words, group = source.

    The label may be NULL. Texts share few runs of words unless one comes from the other, so runs tell
    twins apart better than tokens and keep frequent features out of the neighbour join.
    """
    docs = labelled_documents(spark, sf_dir)
    return project_record(
        docs,
        key=identity_key("text"),
        label=F.col(label).cast("double"),
        group_key=F.col("source"),
        features=word_shingles("text", 3) if runs else token_set("text"),
        dataset="documents" if dataset is None else F.col(dataset),
    )


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_split(document_frame(spark, sf_dir))


def judged_documents(
    spark: SparkSession, sf_dir: str, label: str = "quality", dataset: str | None = None, runs: bool = False
) -> DataFrame:
    """The documents that have a label, as ``prepare`` keeps them; ``prepare_notes`` counts the others."""
    return document_frame(spark, sf_dir, label, dataset, runs).filter(F.col("key").isNotNull() & F.col("label").isNotNull())


def split_judged(spark: SparkSession, sf_dir: str, label: str = "quality", runs: bool = False) -> DataFrame:
    return random_split(judged_documents(spark, sf_dir, label, runs=runs))


def order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: key = customer and day, group = customer, label = finished or not."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "record_id")
    return project_record(
        orders,
        key=row_key("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")),
        label=(F.col("o_orderstatus") == "F").cast("double"),
        group_key=F.col("o_custkey").cast("string"),
        dataset="orders",
    )


def conversation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: one record per turn, group = conversation, label = assistant or not."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "record_id", F.concat_ws(":", "conv_id", "turn")
    )
    return project_record(
        turns,
        key=identity_key("text"),
        label=(F.col("role") == "assistant").cast("double"),
        group_key=F.col("conv_id").cast("string"),
        features=token_set("text"),
        dataset="conversations",
    )
