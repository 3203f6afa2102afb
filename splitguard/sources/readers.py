"""Readers for labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "tsv", "json", "parquet", "fasta")


def format_of(path: str) -> str:
    """Table format by file suffix; a trailing .gz is looked through."""
    name = path.rstrip("/").lower()
    if name.endswith(".gz"):
        name = name[:-3]
    for fmt in FORMATS:
        if name.endswith("." + fmt):
            return fmt
    raise ValueError(f"cannot tell the format of {path!r}; pass fmt as one of {FORMATS}")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    id_col: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read CSV, TSV or FASTA (also gzip), JSON or Parquet; globs and folders work as in Spark.

    Pass ``schema`` for large CSV or JSON: without it Spark reads the files twice.
    A gzip file is one partition, so give ``partitions`` to spread its rows after the read.
    Without ``id_col`` every row gets a ``record_id`` made of a hash of its content and, for rows alike in
    every column, a running number: it depends on the rows alone, not on files, splits or cluster.
    """
    fmt = fmt or format_of(path)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        frame = reader.csv(path, header=True, inferSchema=schema is None, sep="\t" if fmt == "tsv" else ",")
    elif fmt == "fasta":
        frame = _fasta(spark, path)
    elif fmt == "json":
        frame = reader.json(path)
    else:
        frame = reader.parquet(path)
    if id_col is not None:
        require_columns(frame, id_col)
        frame = frame.withColumn("record_id", F.col(id_col))
    elif "record_id" not in frame.columns:
        frame = with_content_ids(frame)
    return frame.repartition(partitions, "record_id") if partitions else frame


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records (name, description, sequence): a record starts at a > that begins a line."""
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("record")).filter(F.trim("record") != "")
    head = F.regexp_replace(F.substring_index("record", "\n", 1), "\r", "")
    body = F.regexp_replace(F.expr("substring(record, length(substring_index(record, '\\n', 1)) + 1)"), r"\s+", "")
    return parts.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("sequence"))


def with_content_ids(frame: DataFrame) -> DataFrame:
    """Adds a string ``record_id`` from each row's content.

    Rows alike are counted before the shuffle and told apart by number afterwards, so a row repeated a
    billion times is one row per task on the way.
    """
    columns = [F.col(f"`{c}`") for c in frame.columns]
    counted = frame.groupBy(*columns).agg(F.count("*").alias("_copies"))
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    numbered = counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return numbered.withColumn("record_id", F.concat_ws(":", content, F.col("_copy").cast("string"))).drop("_copy")


def require_unique_ids(frame: DataFrame, id_col: str = "record_id") -> None:
    """Raise if an id is missing or names two rows: neighbours and splits would be wrong."""
    repeated = frame.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if not repeated.isEmpty():
        raise ValueError(f"{id_col!r} does not name each row: an id is missing or repeated")


def require_columns(frame: DataFrame, *names: str) -> None:
    """Raise if a named column is missing, and say which columns there are."""
    for name in names:
        if name not in frame.columns:
            raise ValueError(f"column {name!r} not found; the table has {frame.columns}")
