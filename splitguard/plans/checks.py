"""The four checks and the verdict, one row per data set."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.config import THRESHOLDS
from splitguard.operators.duplicates import duplicate_check
from splitguard.operators.groups import group_check
from splitguard.operators.neighbors import hashed, nearest_neighbors, similarity_check
from splitguard.operators.prepare import Prepared, prepare, require_rows
from splitguard.operators.scoring import baseline_check
from splitguard.operators.splits import BY, group_split
from splitguard.operators.verdict import low_confidence, summary, verdict
from splitguard.sources.readers import read_table, require_unique_ids
from splitguard.storage import materialize


def split_sizes(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return frame.groupBy(*by).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )


def audit(frame: DataFrame, by: tuple[str, ...] = BY, limits: dict[str, float] = THRESHOLDS, stored: bool = False) -> DataFrame:
    """All checks, verdict and summary per data set.

    The frame is written once, its features as hashes, so keys and features are computed once (``stored``: it is
    a written table already); the nearest-neighbour rows are written once and feed both the similarity check and the
    label-copy baseline.
    """
    frame = frame if stored else hashed(frame, by, ("key", "group_key"))
    neighbors = materialize(nearest_neighbors(frame, by), "neighbors")
    keys = list(by)
    joined = (
        split_sizes(frame, by)
        .join(duplicate_check(frame, by).drop("n_test"), keys)
        .join(group_check(frame, by), keys)
        .join(similarity_check(neighbors, by), keys, "left")
        .join(baseline_check(frame, neighbors, by), keys)
        .fillna(0.0, ["nn_mean", "fraction_above_0_8"])
        .fillna(0, ["n_measured"])
        .fillna("No test record could be compared with train.", ["similarity_message"])
    )
    judged = joined.withColumn("verdict", verdict(limits)).withColumn("low_confidence", low_confidence())
    return judged.withColumn("summary", summary()).select(
        *by,
        "verdict",
        "low_confidence",
        "n_train",
        "n_test",
        "n_leaked",
        "fraction_leaked",
        "n_measured",
        "nn_mean",
        "fraction_above_0_8",
        "n_test_groups",
        "n_shared",
        "fraction_shared",
        "metric_name",
        "score",
        "duplicates_message",
        "similarity_message",
        "groups_message",
        "baseline_message",
        "summary",
    )


class Fixed(NamedTuple):
    report: DataFrame
    rows: DataFrame


def fix_split(frame: DataFrame, test_frac: float = 0.2, stored: bool = False) -> Fixed:
    """Group-safe re-split, with the label-copy baseline before and after.

    Both splits run through one nearest-neighbour job, kept apart by ``variant``.
    """
    frame = frame if stored else materialize(frame, "frame")
    after = group_split(frame, test_frac).select(*frame.columns)
    by = ("dataset", "variant")
    both = frame.withColumn("variant", F.lit("before")).unionByName(after.withColumn("variant", F.lit("after")))
    neighbors = materialize(nearest_neighbors(both, by), "neighbors")
    scores = baseline_check(both, neighbors, by)
    sizes = split_sizes(both, by)
    at = lambda variant, c: F.max(F.when(F.col("variant") == variant, F.col(c)))
    report = (
        sizes.join(scores, list(by))
        .groupBy("dataset")
        .agg(
            at("before", "metric_name").alias("metric_before"),
            at("before", "score").alias("score_before"),
            at("after", "metric_name").alias("metric_after"),
            at("after", "score").alias("score_after"),
            at("after", "n_train").alias("n_train"),
            at("after", "n_test").alias("n_test"),
        )
        .withColumn("improved", F.coalesce(F.col("score_after") < F.col("score_before"), F.lit(False)))
    )
    return Fixed(report, after)


def collapse_bars(report: DataFrame) -> DataFrame:
    """Plot rows of a fix report: bar height from chance (0) to perfect (100), and whether the
    score reaches the leaking line (here including the line itself)."""
    bars = report.select(
        "dataset",
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("bar"), F.col("metric_before").alias("metric"), F.col("score_before").alias("score")),
                F.struct(F.lit("after").alias("bar"), F.col("metric_before").alias("metric"), F.col("score_after").alias("score")),
            )
        ).alias("b"),
    ).select("dataset", "b.*")
    r2 = F.col("metric") == "R2"
    floor = F.when(r2, F.lit(0.0)).otherwise(F.lit(0.5))
    line = F.when(r2, F.lit(THRESHOLDS["r2_leaking"])).otherwise(F.lit(THRESHOLDS["baseline_leaking"]))
    height = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), (v - floor) / (1 - floor) * 100))
    return bars.filter(F.col("score").isNotNull()).select(
        "dataset",
        "bar",
        "metric",
        "score",
        height(F.col("score")).alias("height"),
        height(line).alias("leaking_height"),
        height(floor).alias("chance_height"),
        (F.col("score") >= line).alias("hot"),
    )


def audit_table(spark, path: str, fmt: str | None = None, schema=None, id_col: str | None = None, **options) -> Prepared:
    """Read, prepare, guard and audit one table; returns (report, notes).

    ``options`` go to ``prepare``; blank column names mean detection.
    """
    clean = _prepared(spark, path, fmt, schema, id_col, options, lambda frame: hashed(frame, others=("key", "group_key"), name="prepared"))
    return Prepared(audit(require_rows(clean.frame), stored=True), clean.notes)


def fix_table(spark, path: str, fmt: str | None = None, schema=None, id_col: str | None = None, **options) -> Fixed:
    """Read, prepare, guard and repair one table; a missing split is created at random."""
    options["make_split_method"] = "random"
    clean = _prepared(spark, path, fmt, schema, id_col, options, lambda frame: materialize(frame, "prepared"))
    return fix_split(require_rows(clean.frame), stored=True)


def _prepared(spark, path: str, fmt, schema, id_col, options: dict, write: Callable[[DataFrame], DataFrame]) -> Prepared:
    named = {k: (v or None) if k in ("key_col", "label_col", "split_col") else v for k, v in options.items()}
    raw = materialize(read_table(spark, path, fmt, schema, id_col), "raw")
    require_unique_ids(raw)
    clean = prepare(raw, **named)
    return Prepared(write(clean.frame), clean.notes)
