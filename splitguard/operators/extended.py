"""Further checks on a split: who is copied from where, time, batches, groups, features, moments, inputs.

Each takes the common frame (dataset, record_id, key, group_key, label, split and what it names) and
counts per data set with map-side combining; none pairs rows with rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitguard.functions.numbers import safe_ratio
from splitguard.operators.order_stats import exact_percentiles
from splitguard.operators.scoring import auroc_of_counts
from splitguard.operators.splits import BY
from splitguard.storage import attach, lookup, materialize, pinned

# --- fixed values: tiers of the checks ---
SEVERITIES = ("PASS", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFOUND_TIERS = ((0.70, "HIGH"), (0.40, "MEDIUM"), (0.20, "LOW"))
FRACTION_TIERS = ((0.05, "HIGH"), (0.01, "MEDIUM"), (0.0, "LOW"))
FEATURE_AUC = 0.95
MOMENT_TOLERANCE = 1e-10
PERCENTILES = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
MOMENT_DECIMALS = 6
MIN_ROWS = 50
OVERLAP = 0.80


def tier(value: Column, tiers: tuple[tuple[float, str], ...]) -> Column:
    """The first tier whose limit the value exceeds, else PASS; an undefined value is SKIPPED."""
    out = F.lit("PASS")
    for limit, name in reversed(tiers):
        out = F.when(value > limit, F.lit(name)).otherwise(out)
    return F.when(value.isNull(), F.lit("SKIPPED")).otherwise(out)


def record_hash(*names: str) -> Column:
    """SHA-256 of a row's content: columns by name, each value with its length; NULL is told from empty."""
    parts = [F.concat_ws(":", F.lit(n), F.coalesce(F.length(F.col(n).cast("string")).cast("string"), F.lit("-")), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in sorted(names)]
    return F.sha2(F.concat_ws(",", *parts), 256)


def copied_records(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Every test record with a copy in train: the first train record of its key, and how many there are.

    Copies meet once per key, so a key held by thousands on both sides gives a row per test record and
    not one per pair. A key that a large share of the test records hold is answered without gathering them.
    """
    in_train, in_test = F.col("split") == "train", F.col("split") == "test"
    keys = (
        frame.filter(F.col("key").isNotNull()).groupBy(*by, "key")
        .agg(F.min(F.when(in_train, F.col("record_id"))).alias("train_id"), F.count_if(in_train).alias("n_train_copies"), F.count_if(in_test).alias("n_test_copies"))
        .filter("n_train_copies > 0 AND n_test_copies > 0")
    )
    test = frame.filter(in_test & F.col("key").isNotNull()).select(*by, F.col("record_id").alias("test_id"), "key")
    found = lookup(test, materialize(keys, "copied_keys"), [*by, "key"], "n_test_copies", "test_id")
    return found.filter("n_train_copies IS NOT NULL").select(*by, "test_id", "key", "train_id", "n_train_copies")


def duplicate_severity(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Share of test records with a copy in train; any copy is CRITICAL."""
    n_test = frame.filter(F.col("split") == "test").groupBy(*by).agg(F.count("*").alias("n_test"))
    n_copied = copied_records(frame, by).groupBy(*by).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return n_test.join(n_copied, list(by), "left").select(
        *by, "n_test", n.cast("long").alias("n_flagged"), safe_ratio(n, F.col("n_test")).alias("measured"),
        F.when(n > 0, "CRITICAL").otherwise("PASS").alias("severity"),
    )


def group_leaks(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Groups on both sides, with their rows on each."""
    sides = frame.filter(F.col("group_key").isNotNull()).groupBy(*by, "group_key").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    return sides.filter("n_train > 0 AND n_test > 0")


def group_severity(frame: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Number of groups on both sides and the share of test rows in them; any is HIGH."""
    n_test = frame.groupBy(*by).agg(F.count_if(F.col("split") == "test").alias("n_test"))
    shared = group_leaks(frame, by).groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_test").alias("rows"))
    n = F.coalesce("n", F.lit(0))
    return n_test.join(shared, list(by), "left").select(
        *by, "n_test", n.cast("long").alias("n_flagged"), safe_ratio(F.coalesce("rows", F.lit(0)), F.col("n_test")).alias("measured"),
        F.when(n > 0, "HIGH").otherwise("PASS").alias("severity"),
    )


def temporal_check(frame: DataFrame, time: str = "time", by: tuple[str, ...] = BY) -> DataFrame:
    """Test rows older than the newest train row. Passes only if all of train lies before all of test."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    ends = frame.groupBy(*by).agg(
        F.max(F.when(train, F.col(time))).alias("last_train"), F.min(F.when(test, F.col(time))).alias("first_test"), F.count_if(test).alias("n_test")
    )
    # One row per data set comes back to the rows; the optimizer picks how.
    early = frame.filter(test).join(ends.select(*by, "last_train"), list(by)).groupBy(*by).agg(F.count_if(F.col(time) < F.col("last_train")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return ends.join(early, list(by), "left").select(
        *by, "n_test", n.cast("long").alias("n_flagged"), safe_ratio(n, F.col("n_test")).alias("measured"),
        F.when(F.col("last_train").isNull() | F.col("first_test").isNull(), "SKIPPED").when(F.col("last_train") < F.col("first_test"), "PASS").otherwise("HIGH").alias("severity"),
        "last_train", "first_test",
    )


def confound_check(frame: DataFrame, batch: str = "batch", by: tuple[str, ...] = BY) -> DataFrame:
    """Cramer's V between batch and label over train rows; NULL where one of them is constant."""
    cells = frame.filter((F.col("split") == "train") & F.col(batch).isNotNull() & F.col("label").isNotNull()).groupBy(*by, batch, "label").agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy(*by, batch).agg(F.sum("o").alias("r")), cells.groupBy(*by, "label").agg(F.sum("o").alias("c"))
    whole = cells.groupBy(*by).agg(F.sum("o").alias("n")).join(rows.groupBy(*by).agg(F.count("*").alias("k")), list(by)).join(columns.groupBy(*by).agg(F.count("*").alias("m")), list(by))
    # chi2 / n = sum o^2 / (r c) - 1: empty cells add nothing, so they need not exist.
    shares = cells.join(rows, [*by, batch]).join(columns, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    least = F.least("k", "m") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / least))
    return whole.join(shares, list(by)).select(*by, F.col("n").alias("n_train"), F.col("k").alias("n_batches"), F.col("m").alias("n_labels"), v.alias("measured"), tier(v, CONFOUND_TIERS).alias("severity"))


def feature_leaks(frame: DataFrame, features: list[str], by: tuple[str, ...] = BY) -> DataFrame:
    """How well each numeric feature alone tells the 0/1 label of train rows: AUROC, either way round.

    Rows are counted per distinct value as they are read; only these counts are shuffled, and the span of a
    feature, one row, is broadcast to them.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = frame.filter((F.col("split") == "train") & F.col("label").isNotNull()).select(*by, "label", pairs.alias("p")).select(*by, "label", "p.*").filter("value IS NOT NULL")
    keys = [*by, "feature"]
    counts = long.groupBy(*keys, "value").agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") != 1).alias("_neg"))
    counts = materialize(counts, "value_counts")
    span = pinned(counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    score = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    scaled = attach(counts, span, tuple(keys)).filter("lo IS NOT NULL").groupBy(*keys, score.alias("_score"))
    scaled = scaled.agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    strength = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    return auroc_of_counts(scaled, tuple(keys)).select(*keys, strength.alias("measured"), tier(strength, ((FEATURE_AUC, "HIGH"),)).alias("severity"))


def moment_check(frame: DataFrame, features: list[str], by: tuple[str, ...] = BY, decimals: int = MOMENT_DECIMALS) -> DataFrame:
    """Whether mean, deviation and percentiles of a feature in test equal those of all rows, as a scaler fitted on all rows would leave them.

    Sums are exact: of the values' distances to the smallest one, as decimals with ``decimals`` places, so no
    result depends on the order of rows. Percentiles are exact and linearly interpolated. A feature whose
    sums do not fit 38 digits, or without two test values, is SKIPPED.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    sides = F.explode(F.when(F.col("split") == "test", F.array(F.lit("all"), F.lit("test"))).otherwise(F.array(F.lit("all"))))
    long = frame.select(*by, sides.alias("side"), pairs.alias("p")).select(*by, "side", "p.*").filter("value IS NOT NULL AND NOT isnan(value)")
    keys = [*by, "feature"]
    base = pinned(long.filter("side = 'all'").groupBy(*keys).agg(F.min("value").alias("base")))
    exact = F.expr(f"try_cast(value AS decimal(38, {decimals})) - try_cast(base AS decimal(38, {decimals}))").cast(f"decimal(19, {decimals})")
    sums = attach(long, base, tuple(keys)).select(*keys, "side", "base", exact.alias("x")).groupBy(*keys, "side", "base").agg(
        F.count("*").cast("double").alias("n"), F.expr("try_sum(x)").cast("double").alias("s"), F.expr("try_sum(x * x)").cast("double").alias("q")
    )
    deviation = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))))
    figures = sums.select(*keys, "side", (F.col("base") + F.col("s") / F.col("n")).alias("mean"), deviation.alias("std")).join(
        exact_percentiles(long, [*keys, "side"], PERCENTILES).drop("n"), [*keys, "side"]
    )
    names = ["mean", "std", *PERCENTILES]
    one = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{name}_{side}")
    wide = figures.groupBy(*keys).agg(*[one(n, side) for n in names for side in ("all", "test")])
    same = reduce(lambda x, y: x & y, [F.abs(F.col(f"{n}_all") - F.col(f"{n}_test")) <= MOMENT_TOLERANCE for n in names])
    return wide.withColumn("severity", F.when(same.isNull(), "SKIPPED").when(same, "MEDIUM").otherwise("PASS"))


def input_problems(frame: DataFrame, required: dict[str, str], by: tuple[str, ...] = BY, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per rule that the frame breaks: (data set, rule, n_rows). Types and columns are read off the schema."""
    spark, types = frame.sparkSession, dict(frame.dtypes)
    static = [(n, "missing column" if n not in types else f"type {types[n]}, not {t}") for n, t in required.items() if types.get(n) != t]
    sides = frame.groupBy(*by).agg(
        F.count_if(F.col("label").isNull()).alias("label is missing"),
        F.count_if(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False))).alias("split is neither train nor test"),
        F.when(F.count("*") < min_rows, F.count("*")).otherwise(F.lit(0)).alias(f"fewer than {min_rows} rows"),
    )
    named = [c for c in sides.columns if c not in by]
    found = sides.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n_rows")) for c in named])).alias("r")).select(*by, "r.*")
    both = frame.groupBy(*by, "record_id").agg(F.count_distinct("split").alias("n_sides"), F.count("*").alias("n"))
    more = both.groupBy(*by).agg(F.count_if(F.col("n_sides") > 1).alias("both"), F.count_if(F.col("n") > 1).alias("twice"))
    more = more.select(*by, F.explode(F.array(
        F.struct(F.lit("record on both sides").alias("rule"), F.col("both").alias("n_rows")), F.struct(F.lit("record id repeated").alias("rule"), F.col("twice").alias("n_rows"))
    )).alias("r")).select(*by, "r.*")
    out = found.unionByName(more).filter("n_rows > 0")
    if static:
        schema = ", ".join(f"{b} string" for b in by) + ", rule string, n_rows long"
        rows = [(*[None] * len(by), f"{name}: {what}", None) for name, what in static]
        out = out.unionByName(spark.createDataFrame(rows, schema))
    return out


def with_companion_split(frame: DataFrame, companion: DataFrame, id_col: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The frame with the split that a second table gives each id, and one row of counts.

    An id listed twice with one split counts once; listed with different ones, it is contradictory and
    gets no split, like an id that is not listed.
    """
    per_id = companion.groupBy(id_col).agg(F.min("split").alias("_split"), F.count_distinct("split").alias("_sides"), F.count("*").alias("_listed"))
    joined = frame.drop("split").join(per_id, id_col, "left").withColumn("split", F.when(F.col("_sides") == 1, F.col("_split")))
    counts = joined.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_listed").isNull()).alias("n_unassigned"),
        F.count_if(F.col("_listed") > 1).alias("n_listed_twice"), F.count_if(F.col("_sides") > 1).alias("n_contradictory"),
    )
    return joined.drop("_split", "_sides", "_listed"), counts


def corpus_overlap(items: DataFrame, corpus: DataFrame, shingles, item_id: str, corpus_id: str, overlap: float = OVERLAP) -> DataFrame:
    """Items with at least ``overlap`` of their shingles in one text of the corpus: how many such texts, and the fullest.

    ``shingles`` is a Column function of the text. Only corpus shingles that some item has go on past the
    first join, whose small side is the items.
    """
    own = items.select(F.col(item_id).alias("item"), shingles("text").alias("s")).select("item", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    there = corpus.select(F.col(corpus_id).alias("text_id"), F.explode(shingles("text")).alias("shingle"))
    met = there.join(own, "shingle").groupBy("item", "text_id").agg((F.count("*") / F.first("n")).alias("share")).filter(F.col("share") >= overlap)
    return met.groupBy("item").agg(F.count("*").alias("n_texts"), F.max("share").alias("fullest")).withColumnRenamed("item", item_id)


def near_and_far(neighbors: DataFrame, limit: float = 0.5, by: tuple[str, ...] = BY) -> DataFrame:
    """How often the copied label is right for test records close to train and for the others."""
    return neighbors.filter("measured").groupBy(*by, (F.col("similarity") > limit).alias("near")).agg(
        F.count("*").alias("n_rows"), F.avg((F.col("label") == F.col("nn_label")).cast("double")).alias("right"), F.avg("similarity").alias("mean_similarity")
    )


def inflation(neighbors: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Quartiles of the distance to train, and how being right goes with it (correlation and slope)."""
    distance, right = 1 - F.col("similarity"), (F.col("label") == F.col("nn_label")).cast("double")
    rows = neighbors.filter("measured").select(*by, distance.alias("d"), right.alias("r"))
    quartiles = exact_percentiles(rows.withColumnRenamed("d", "value"), list(by), QUARTILES).drop("n")
    fits = rows.groupBy(*by).agg(F.corr("d", "r").alias("correlation"), F.regr_slope("r", "d").alias("slope"))
    return quartiles.join(fits, list(by)).select(*by, *QUARTILES, "correlation", "slope")


def findings(checks: dict[str, DataFrame], by: tuple[str, ...] = BY) -> DataFrame:
    """One row per check and data set: finding_id, check, measured, severity. Passed and skipped checks are rows too.

    The id is a hash of what was checked, so a second run gives the same ids.
    """
    rows = [
        f.select(*by, F.lit(name).alias("check"), F.col("measured").cast("double").alias("measured"), "severity") for name, f in checks.items()
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("finding_id", F.sha2(F.concat_ws(":", "check", *by), 256))


def roll_up(found: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Per data set: number of findings, the worst severity, and which checks passed, failed or were skipped."""
    level = F.array_position(F.lit(list(SEVERITIES)), F.col("severity"))
    names = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("check")))), ",")
    passed, skipped = F.col("severity") == "PASS", F.col("severity") == "SKIPPED"
    worst = F.get(F.lit(list(SEVERITIES)), (F.greatest(F.max(level), F.lit(1)) - 1).cast("int"))
    return found.groupBy(*by).agg(
        F.count_if(~passed & ~skipped).alias("n_findings"), worst.alias("worst"), names(passed).alias("passed"), names(~passed & ~skipped).alias("failed"), names(skipped).alias("skipped"),
    )


def settings_hash(settings: dict) -> str:
    """SHA-256 of the settings of a run, whatever the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
