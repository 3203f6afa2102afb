"""Check 1: test records whose identity key also occurs in train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.functions.numbers import fixed, percent, safe_ratio
from splitguard.operators.splits import BY, split_sides


def leaked_rows(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Test rows with a train twin (left semi join; every test row counts on its own)."""
    train, test = split_sides(frame)
    return test.join(train.select(*by, "key").distinct(), [*by, "key"], "left_semi")


def duplicate_check(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """n_test, n_leaked, fraction_leaked per data set.

    One count per (data set, key) with map-side combining replaces the join: a key held by a
    third of all rows arrives at its reducer as one row per map task. A record without key is no copy
    of anything.
    """
    per_key = frame.groupBy(*by, "key").agg(
        F.count_if(F.col("split") == "train").alias("_train"),
        F.count_if(F.col("split") == "test").alias("_test"),
    )
    counts = per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_test"), F.lit(0)).alias("n_test"),
        F.coalesce(F.sum(F.when((F.col("_train") > 0) & F.col("key").isNotNull(), F.col("_test"))), F.lit(0)).alias("n_leaked"),
    )
    share = safe_ratio(F.col("n_leaked"), F.col("n_test"))
    return counts.withColumn("fraction_leaked", share).withColumn(
        "duplicates_message",
        F.format_string(
            "%d of %d test records (%s%%) also occur in train under the same key.",
            "n_leaked",
            "n_test",
            fixed(percent(F.col("fraction_leaked")), 1),
        ),
    )
