"""An append-only store of findings in which a second run of the same checks leaves the same rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.operators.extended import record_hash
from splitguard.operators.splits import BY

VERSION = "1"


def content_hash(frame: DataFrame, *names: str) -> Column:
    """An aggregate: SHA-256 of the number of rows and the sum of a part of their content hashes. The order of rows plays no part."""
    part = F.conv(F.substring(record_hash(*(names or frame.columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string")), 256)


def evidence(
    checks: dict[str, tuple[DataFrame, str, float | None]], inputs: DataFrame, settings_hash: str,
    by: tuple[str, ...] = BY, version: str = VERSION,
) -> DataFrame:
    """One row per check and data set, passed and skipped ones too.

    ``checks`` names a result with measured and severity, its metric, and the threshold it was held against.
    ``evidence`` is a JSON object of the result's other columns, in their order. ``inputs`` has an input_hash per data set.
    The finding's id is a hash of what was checked, on which input, with which settings and code.
    """
    rows = None
    for name, (found, metric, threshold) in checks.items():
        others = [c for c in found.columns if c not in (*by, "measured", "severity")]
        body = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
        one = found.select(
            *by, F.lit(name).alias("check"), "severity", F.lit(metric).alias("metric"), F.lit(threshold).cast("double").alias("threshold"),
            F.col("measured").cast("double").alias("measured"), body.alias("evidence"),
        )
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(inputs, list(by), "left").withColumns({"settings_hash": F.lit(settings_hash), "code_version": F.lit(version)})
    identity = F.concat_ws(":", "check", *by, F.coalesce("input_hash", F.lit("")), "settings_hash", "code_version")
    return rows.withColumn("finding_id", F.sha2(identity, 256))


def read_evidence(spark: SparkSession, path: str) -> DataFrame | None:
    """All findings of the store, None if there is no store yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_evidence(rows: DataFrame, path: str) -> DataFrame:
    """Add the findings that the store does not hold yet, and return all of it.

    Nothing in the store is changed. Findings that ``rows`` repeats are written once. Spark commits a write as
    a whole, so a run that dies leaves nothing behind and can be repeated. One writer at a time.
    """
    spark, fresh = rows.sparkSession, rows.dropDuplicates(["finding_id"])
    held = read_evidence(spark, path)
    if held is not None:
        fresh = fresh.join(held.select("finding_id"), "finding_id", "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
