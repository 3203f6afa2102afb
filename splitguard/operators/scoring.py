"""Check 4: how far a lookup gets that only copies the nearest train label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.functions.labels import is_binary
from splitguard.functions.numbers import fixed
from splitguard.operators.splits import BY

_SCORE_SLOTS = 4096


def metric_name(label: Column | str) -> Column:
    """Aggregate over train and test labels: AUROC for exactly {0, 1}, else R2."""
    return F.when(is_binary(label), F.lit("AUROC")).otherwise(F.lit("R2"))


def soft_score(similarity: Column | str, copied: Column | str) -> Column:
    """The similarity if the copied label is 1, else one minus it."""
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    p = F.col(copied) if isinstance(copied, str) else copied
    return F.when(p == 1, s).otherwise(1 - s)


def auroc(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = BY) -> DataFrame:
    """Area under the ROC curve per data set for scores in [0, 1]; ties count half.

    Rows are first counted per distinct score. Running totals are taken over 4,096 score
    slots and then inside each slot, so no window spans all scores. NULL when only one class
    is present.
    """
    per_score = scored.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    return auroc_of_counts(per_score, by)


def auroc_of_counts(per_score: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """``auroc`` of rows that are counted already: _pos and _neg per _score."""
    slot = F.least(F.floor(F.col("_score") * _SCORE_SLOTS), F.lit(_SCORE_SLOTS - 1)).cast("int")
    per_score = per_score.withColumn("_slot", slot)
    slots = per_score.groupBy(*by, "_slot").agg(F.sum("_neg").alias("_slot_neg"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*by, "_slot", F.coalesce(F.sum("_slot_neg").over(earlier), F.lit(0)).alias("_below_slot"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per_score.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
        .join(slots, [*by, "_slot"])
        .withColumn("_won", F.col("_pos") * (F.col("_below_slot") + F.col("_below") + F.col("_neg") / 2))
    )
    totals = ranked.groupBy(*by).agg(
        F.sum("_won").alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return totals.select(*by, F.when(pairs > 0, F.col("_won") / pairs).alias("auroc"))


def r_squared(truth: Column | str, guess: Column | str) -> Column:
    """Aggregate: 1 - residual / total sum of squares.

    Constant truth gives 1 if every guess is right, else 0; fewer than two rows give NULL.
    """
    y = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(guess) if isinstance(guess, str) else guess
    residual = F.sum((y - p) * (y - p))
    constant = F.min(y) == F.max(y)
    return (
        F.when(F.count(y) < 2, F.lit(None).cast("double"))
        .when(constant & (residual == 0), F.lit(1.0))
        .when(constant, F.lit(0.0))
        .otherwise(1 - residual / (F.count(y) * F.var_pop(y)))
    )


def baseline_check(frame: DataFrame, neighbors: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """metric_name, score and message per data set; score is NULL when undefined."""
    metric = frame.filter(F.col("split").isin("train", "test")).groupBy(*by).agg(
        metric_name("label").alias("metric_name")
    )
    curve = auroc(neighbors.select(*by, "label", soft_score("similarity", "nn_label").alias("score")), by=by)
    fit = neighbors.groupBy(*by).agg(r_squared("label", "nn_label").alias("r2"))
    score = F.when(F.col("metric_name") == "AUROC", F.col("auroc")).otherwise(F.col("r2"))
    chance = F.when(F.col("metric_name") == "AUROC", F.lit("0.50")).otherwise(F.lit("0.00"))
    return (
        metric.join(curve, list(by), "left")
        .join(fit, list(by), "left")
        .select(*by, "metric_name", score.alias("score"), chance.alias("chance"))
        .withColumn(
            "baseline_message",
            F.when(
                F.col("score").isNull(),
                F.lit(
                    "The label-copy score is undefined for this split (one class, or too few test rows), "
                    "so this check is inconclusive."
                ),
            ).otherwise(
                F.concat(
                    F.lit("Copying the nearest train label scores "),
                    fixed(F.col("score"), 2),
                    F.lit(" "),
                    F.col("metric_name"),
                    F.lit(" on test (chance = "),
                    F.col("chance"),
                    F.lit("); a model near this score is mostly a lookup."),
                )
            ),
        )
    )
