"""Writers for corrected splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corrected_rows(frame: DataFrame, key_name: str = "key") -> DataFrame:
    """The three columns of a corrected split: key, label, split (plus the row id)."""
    return frame.select("record_id", F.col("key").alias(key_name), "label", "split")


def write_split(frame: DataFrame, path: str, fmt: str = "csv", key_name: str = "key") -> None:
    """Write a split as CSV, or as Parquet with one folder per side."""
    rows = corrected_rows(frame, key_name)
    if fmt == "csv":
        rows.drop("record_id").write.csv(path, header=True)
    elif fmt == "parquet":
        rows.write.partitionBy("split").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; csv or parquet")


def report_json(report: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One JSON object per data set: verdict, summary, the four checks, and the notes."""
    nested = report.select(
        "dataset",
        F.struct(
            "verdict",
            "low_confidence",
            "n_train",
            "n_test",
            "summary",
            F.struct(
                F.struct(
                    "n_test", "n_leaked", "fraction_leaked", F.col("duplicates_message").alias("message")
                ).alias("duplicates"),
                F.struct(
                    "n_test_groups", "n_shared", "fraction_shared", F.col("groups_message").alias("message")
                ).alias("groups"),
                F.struct(
                    F.col("nn_mean").alias("mean"),
                    "fraction_above_0_8",
                    F.col("similarity_message").alias("message"),
                ).alias("similarity"),
                F.struct("metric_name", "score", F.col("baseline_message").alias("message")).alias("baseline"),
            ).alias("checks"),
        ).alias("body"),
    )
    if notes is None:
        return nested.select("dataset", F.to_json("body", {"ignoreNullFields": "false"}).alias("report"))
    noted = notes.select("dataset", F.struct(*[c for c in notes.columns if c != "dataset"]).alias("notes"))
    return nested.join(noted, "dataset", "left").select(
        "dataset",
        F.to_json(F.struct("body.*", "notes"), {"ignoreNullFields": "false"}).alias("report"),
    )


def write_reports(report: DataFrame, path: str, notes: DataFrame | None = None) -> None:
    """Write one JSON object per line."""
    report_json(report, notes).select(F.col("report").alias("value")).write.text(path)
