"""Check 3: groups that stand on both sides of the split, and set operations on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.functions.numbers import fixed, percent, safe_ratio
from splitguard.operators.splits import BY, split_sides


def distinct_groups(frame: DataFrame, side: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Distinct groups of one side; '' is a group, NULL is none."""
    return frame.filter((F.col("split") == side) & F.col("group_key").isNotNull()).select(*by, "group_key").distinct()


def shared_groups(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Groups of test that are also in train."""
    return distinct_groups(frame, "test", by).intersect(distinct_groups(frame, "train", by))


def groups_only_in_test(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Groups of test that are not in train."""
    return distinct_groups(frame, "test", by).subtract(distinct_groups(frame, "train", by))


def sides_disjoint(frame: DataFrame, by: tuple[str, ...] = BY) -> bool:
    """Post-condition of a group-safe split, NULL being one group like any other."""
    train, test = split_sides(frame)
    return test.select(*by, "group_key").intersect(train.select(*by, "group_key")).isEmpty()


def group_check(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """n_test_groups, n_shared, fraction_shared per data set, in one pass over the groups."""
    per_group = frame.groupBy(*by, "group_key").agg(
        F.max(F.col("split") == "train").alias("_train"), F.max(F.col("split") == "test").alias("_test")
    )
    known = F.col("group_key").isNotNull() & F.col("_test")
    counts = per_group.groupBy(*by).agg(
        F.count_if(known).alias("n_test_groups"), F.count_if(known & F.col("_train")).alias("n_shared")
    )
    share = safe_ratio(F.col("n_shared"), F.col("n_test_groups"))
    return counts.withColumn("fraction_shared", share).withColumn(
        "groups_message",
        F.format_string(
            "%d of %d distinct test groups (%s%%) also occur in train, so a model can lean on the group.",
            "n_shared",
            "n_test_groups",
            fixed(percent(F.col("fraction_shared")), 1),
        ),
    )
