"""Gaps in the time that train covers, which may show that windows were picked by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitguard.functions.numbers import safe_ratio
from splitguard.operators.splits import BY
from splitguard.storage import materialize

_EPOCH = "1970-01-01"


def _closed(frame: DataFrame, time: str, entity: str, by: tuple[str, ...]) -> DataFrame:
    """Per entity and day with train rows: the train day before it and the test rows on days between the two.

    Rows are counted per day before they meet, so an entity has at most as many rows as the calendar has
    days, however many records it has.
    """
    keys = [*by, "entity"]
    day = F.datediff(F.col(time), F.lit(_EPOCH).cast("date"))
    days = frame.filter(F.col(time).isNotNull() & F.col(entity).isNotNull() & F.col("split").isin("train", "test")).groupBy(*by, F.col(entity).alias("entity"), day.alias("day")).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    train_day = F.when(F.col("n_train") > 0, F.col("day"))
    onwards = Window.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = days.withColumn("closing", F.last(train_day, ignorenulls=True).over(onwards)).filter("closing IS NOT NULL")
    ends = closing.groupBy(*keys, "closing").agg(F.sum(F.when(F.col("n_train") == 0, F.col("n_test")).otherwise(0)).alias("n_test_inside"))
    return ends.withColumn("before", F.lag("closing").over(Window.partitionBy(*keys).orderBy("closing")))


def _at(day: str):
    return F.date_add(F.lit(_EPOCH).cast("date"), F.col(day))


def train_gaps(frame: DataFrame, least_days: int, time: str = "time", entity: str = "group_key", by: tuple[str, ...] = BY) -> DataFrame:
    """One row per gap: entity, last_day, next_day (train days around it), gap_days, n_test_inside.

    A gap lies between two train days of an entity that follow each other and are more than ``least_days`` apart.
    ``n_test_inside`` counts the entity's test rows on days in it. Rows without time, entity or side do not count.
    """
    gap = F.col("closing") - F.col("before")
    return _closed(frame, time, entity, by).filter(gap > least_days).select(
        *by, "entity", _at("before").alias("last_day"), _at("closing").alias("next_day"), gap.alias("gap_days"), "n_test_inside"
    )


def gap_check(frame: DataFrame, least_days: int, time: str = "time", entity: str = "group_key", by: tuple[str, ...] = BY) -> DataFrame:
    """One row per data set with train days: entities, gaps, the longest, test rows inside, and the share of all entities' train spans that gaps take.

    MEDIUM if test rows lie in a gap, as where they were cut out of train, LOW for any other gap, else PASS.
    """
    ends = materialize(_closed(frame, time, entity, by), "train_days")
    gap = F.when(F.col("closing") - F.col("before") > least_days, F.col("closing") - F.col("before"))
    per = ends.groupBy(*by, "entity").agg(
        (F.max("closing") - F.min("closing")).alias("span"), F.count(gap).alias("gaps"), F.max(gap).alias("longest"), F.sum(gap).alias("inside"),
        F.sum(F.when(gap.isNotNull(), F.col("n_test_inside"))).alias("tests"),
    )
    n_gaps, tests = F.sum("gaps"), F.coalesce(F.sum("tests"), F.lit(0))
    return per.groupBy(*by).agg(
        F.count("*").alias("n_entities"), n_gaps.alias("n_gaps"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest_days"), tests.alias("n_test_inside"),
        safe_ratio(F.coalesce(F.sum("inside"), F.lit(0)), F.sum("span")).alias("measured"),
        F.when(tests > 0, "MEDIUM").when(n_gaps > 0, "LOW").otherwise("PASS").alias("severity"),
    )
