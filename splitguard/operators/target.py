"""Features that give the label away: rank figure and mutual information per feature, and rows that show it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitguard.operators.extended import FEATURE_AUC, feature_leaks
from splitguard.operators.order_stats import exact_percentiles
from splitguard.operators.splits import BY
from splitguard.storage import attach, materialize, pinned

INFORMATION = 0.80
BINS = 10
MAX_CLASSES = 20
SHOWN = 3


def _long(frame: DataFrame, features: list[str], by: tuple[str, ...]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    train = frame.filter((F.col("split") == "train") & F.col("label").isNotNull() & ~F.isnan("label"))
    return train.select(*by, "record_id", "label", pairs.alias("p")).select(*by, "record_id", "label", "p.*").filter("value IS NOT NULL AND NOT isnan(value)")


def _binned(long: DataFrame, value: str, keys: list[str], bins: int) -> DataFrame:
    """``long`` with bin: how many of the inner quantiles of its group the value exceeds. Equal values share a bin."""
    cuts = {f"_cut{k}": k / bins for k in range(1, bins)}
    found = exact_percentiles(long.withColumn("value", F.col(value)), keys, cuts).drop("n")
    above = reduce(lambda x, y: x + y, [(F.col(value) > F.col(c)).cast("int") for c in cuts])
    return attach(long, pinned(found), tuple(keys)).withColumn("bin", above).drop(*cuts)


def _classed(long: DataFrame, by: tuple[str, ...], bins: int, max_classes: int) -> DataFrame:
    """``long`` with class: the label, or its quantile bin in data sets with more than ``max_classes`` labels."""
    labels = long.groupBy(*by, "label").agg(F.count("*").alias("n")).groupBy(*by).agg((F.count("*") > max_classes).alias("many"))
    marked = attach(long, pinned(labels), by)
    cut = _binned(marked.filter("many"), "label", list(by), bins).withColumn("class", F.col("bin").cast("double")).drop("bin", "many")
    return marked.filter("NOT many").withColumn("class", F.col("label")).drop("many").unionByName(cut)


def mutual_information(frame: DataFrame, features: list[str], by: tuple[str, ...] = BY, bins: int = BINS, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Per feature of the train rows: n_rows, and information, the share of the label's entropy that the feature's bin explains.

    Features are cut at exact quantiles, labels with more than ``max_classes`` values too. Both counts are
    contingency tables with at most bins x classes cells. A label with one value has no entropy: NULL. Rows
    without the feature's value do not count.
    """
    rows = materialize(_long(frame, features, by).drop("record_id"), "feature_values")
    keys = [*by, "feature"]
    classed = _classed(rows, by, bins, max_classes)
    cells = materialize(_binned(materialize(classed, "classed"), "value", keys, bins).groupBy(*keys, "bin", "class").agg(F.count("*").alias("o")), "cells")
    r, c = cells.groupBy(*keys, "bin").agg(F.sum("o").alias("r")), cells.groupBy(*keys, "class").agg(F.sum("o").alias("c"))
    n = cells.groupBy(*keys).agg(F.sum("o").alias("n"))
    share = F.col("o") / F.col("n")
    shared = cells.join(r, [*keys, "bin"]).join(c, [*keys, "class"]).join(n, keys).groupBy(*keys).agg(
        F.first("n").alias("n_rows"), F.sum(share * F.log(share * F.col("n") * F.col("n") / F.col("r") / F.col("c"))).alias("mi")
    )
    entropy = c.join(n, keys).groupBy(*keys).agg(F.count("*").alias("classes"), F.sum(-F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n"))).alias("h"))
    return shared.join(entropy, keys).select(*keys, "n_rows", F.when(F.col("classes") > 1, F.greatest(F.lit(0.0), F.col("mi")) / F.col("h")).alias("information"))


def target_leaks(frame: DataFrame, features: list[str], by: tuple[str, ...] = BY, bins: int = BINS) -> DataFrame:
    """One row per feature: auroc (either way round; of 0/1 labels), information, severity.

    CRITICAL above an AUROC of 0.95 or an information of 0.80, SKIPPED where neither is defined.
    """
    binary = frame.filter((F.col("split") == "train") & F.col("label").isNotNull()).groupBy(*by).agg(F.bool_and(F.col("label").isin(0.0, 1.0)).alias("_binary"))
    ranked = feature_leaks(frame, features, by).join(binary, list(by)).select(*by, "feature", F.when(F.col("_binary"), F.col("measured")).alias("auroc"))
    found = mutual_information(frame, features, by, bins).join(ranked, [*by, "feature"], "left")
    leaks = (F.coalesce("auroc", F.lit(0.0)) > FEATURE_AUC) | (F.coalesce("information", F.lit(0.0)) > INFORMATION)
    none = F.col("auroc").isNull() & F.col("information").isNull()
    return found.select(*by, "feature", "n_rows", "auroc", "information", F.when(none, "SKIPPED").when(leaks, "CRITICAL").otherwise("PASS").alias("severity"))


def leak_evidence(frame: DataFrame, leaks: DataFrame, by: tuple[str, ...] = BY, shown: int = SHOWN, bins: int = BINS, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Rows that show each CRITICAL feature: for each class of the label the ``shown`` train rows first by md5 of their id."""
    leaks = materialize(leaks, "leaks")
    hit = [r["feature"] for r in leaks.filter("severity = 'CRITICAL'").select("feature").distinct().collect()]
    if not hit:
        return leaks.limit(0).select(*by, "feature", F.lit(None).cast(frame.schema["record_id"].dataType).alias("record_id"), F.lit(0.0).alias("value"), F.lit(0.0).alias("label"))
    flagged = leaks.filter("severity = 'CRITICAL'").select(*by, "feature")
    rows = _classed(_long(frame, hit, by), by, bins, max_classes).join(flagged, [*by, "feature"], "left_semi")
    # The rank's limit is applied before the shuffle, so a class with most rows sends ``shown`` of them per task.
    first = Window.partitionBy(*by, "feature", "class").orderBy(F.md5(F.col("record_id").cast("string")), "record_id")
    return rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= shown).select(*by, "feature", "record_id", "value", "label")
