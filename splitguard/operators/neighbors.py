"""Nearest train record of every test record by set similarity, exact and complete.

Where the shared features can be broadcast, or all pairs share few enough, sets are compared block against block where they were
written (``inplace``): after steps 1 and 2 nothing below applies. Otherwise no plan compares all pairs. It rests on five steps:

1. Equal feature sets collapse into one row, and a set that occurs on both sides is settled
   at similarity 1. A group of copies, however large, costs one row from here on.
2. Features found on one side only cannot be shared. The others are ordered by the number of
   pairs they would produce, cheapest first; each set keeps its features in that order.
3. Every open test set is compared with a few train sets: for its cheapest features, one
   representative per size class; of these, the ones met most often. The best is a lower bound.
4. A train set that beats the bound shares a feature near the front of *both* ordered sets
   (prefix rule), has a fitting size, and keeps enough features behind the shared ones
   (position rule). Only such pairs leave the join; the bound differs per test set and per
   size class, so frequent features are rarely reached.
5. The surviving pairs are counted exactly.

Steps 4 and 5 suit test sets that a few rare features settle. Where the bound leaves so many frequent
features to look through that their lists hold more entries than a tenth of the train sets, the test set is
compared with blocks of train sets instead (``blocks``): no pair leaves those tasks but the best. A join
shuffles a row per entry met, a block counts it in place, so blocks pay well before the lists hold every set.

Nothing is capped: step 3 only supplies bounds, step 4 or the blocks find every pair that could win or tie.
Ties go to the smallest train ``record_id``.

Compared sets do not travel with their pairs: each is sent once to a cell that holds partners of it
(``blocks.shared_sizes``), so what is sent for steps 3 and 5 is bounded by the sets.

Skew: a feature held by many sets is cut into cells on both sides of the join (a test chunk
meets a train chunk, never the whole list); row-to-feature and row-to-set lookups answer hot
keys from a broadcast of proven size (see ``storage.lookup``).

Features travel as 64-bit hashes mixed with the data set, so data sets share no feature. A
collision could only matter inside one compared pair (about 1e-15 for sets of 200 features).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.config import HISTOGRAM_BINS, TWIN_SIMILARITY
from splitguard.functions.numbers import fixed, percent, safe_ratio
from splitguard.operators.blocks import best_in_blocks, shared_sizes
from splitguard.operators.inplace import best_in_place, countable, fits
from splitguard.operators.sieve import crossed, sieved
from splitguard.operators.splits import BY
from splitguard.storage import attach, lookup, materialize, pinned

SEED_FEATURES = 40
SEED_PAIRS = 16
SIZE_STEP = 1.25
FINE_STEP = 1.02
PREFIX_SLACK = 0.3
SLACK_BELOW = 0.2
CELL_ROWS = 10_000
BLOCK_SHARE = 0.1
BROADCAST_ROWS = 2_000_000


def nearest_neighbors(
    frame: DataFrame,
    by: tuple[str, ...] = BY,
    cell_rows: int = CELL_ROWS,
    seed_features: int = SEED_FEATURES,
    block_share: float = BLOCK_SHARE,
) -> DataFrame:
    """One row per test record: label, similarity, nn_id, nn_label, measured.

    A record that shares no feature with train gets similarity 0 and the first train record.
    ``measured`` is false where no comparison exists (NULL features, or train is empty); such
    rows still carry a copied label, as the label-copy baseline scores them too.

    A test set goes through blocks if the lists it would have to look through hold more than
    ``block_share`` entries per train set; that decides what it costs, never the answer.

    ``frame`` is read once and written with hashed features, unless it comes from ``hashed``.
    """
    rows = hashed(frame, by)
    sets = materialize(_sets_without_features(rows), "sets")
    held = _held(_with_features(sets, rows))
    vocabulary = materialize(_vocabulary(crossed(held), cell_rows), "vocabulary")
    if block_share < 1 and fits(sets, vocabulary):
        return _answered(rows, sets, _best(best_in_place(held, vocabulary)), by)
    if block_share < 1 and countable(sets, vocabulary):
        return _answered(rows, sets, _best(best_in_place(sieved(held, vocabulary, "_weight"), None)), by)

    ordered = materialize(_ordered(held, vocabulary), "ordered_sets")
    test = ordered.filter(~F.col("in_train")).drop("in_train")
    train = ordered.filter("in_train").drop("in_train")

    seeds = _best(_verify(_seed_pairs(test, train, seed_features), test, train))
    bounds = materialize(_routed(seeds, test, train, block_share), "bounds")
    compared = bounds.drop("by_blocks")
    better = compared
    routes = {r["by_blocks"] for r in bounds.select("by_blocks").distinct().collect()}
    if False in routes:
        better = better.unionByName(_verify(_winning_pairs(test, train, bounds.filter("NOT by_blocks"), cell_rows), test, train))
    if True in routes:
        better = better.unionByName(best_in_blocks(test, train, bounds.filter("by_blocks")))
    return _answered(rows, sets, _best(better), by)


def _answered(rows: DataFrame, sets: DataFrame, better: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The answers of sets found on both sides and of those ``better`` has the nearest for, given to their records."""
    settled = sets.filter("train_id IS NOT NULL AND test_id IS NOT NULL").select(
        "part", "h1", "h2", "copies", F.lit(1.0).alias("similarity"), F.col("train_id").alias("nn_id"),
        F.col("train_label").alias("nn_label"),
    )
    open_sets = sets.filter("train_id IS NULL AND test_id IS NOT NULL").select("part", "h1", "h2", "copies", "test_id")
    train_labels = sets.filter("train_id IS NOT NULL").select(
        "part", F.col("train_id").alias("nn_id"), F.col("train_label").alias("nn_label")
    )
    found = (
        open_sets.join(better.withColumnRenamed("train_id", "nn_id"), ["part", "test_id"])
        .join(train_labels, ["part", "nn_id"])
        .select("part", "h1", "h2", "copies", (F.col("shared") / F.col("either")).alias("similarity"), "nn_id", "nn_label")
    )
    answers = materialize(settled.unionByName(found), "answers")
    return _answer_rows(rows, answers, by)


def _hashed_rows(frame: DataFrame, by: tuple[str, ...], others: Sequence[str] = ()) -> DataFrame:
    part = F.xxhash64(*by)
    feats = F.sort_array(F.array_distinct(F.transform("features", lambda f: F.xxhash64(part, f))))
    return frame.select(*by, "record_id", "label", "split", *others, part.alias("part"), feats.alias("feats")).select(
        "*",
        F.when(F.col("feats").isNotNull(), F.size("feats")).alias("n"),
        F.xxhash64("feats").alias("h1"),
        F.xxhash64(F.lit("second"), "feats").alias("h2"),
    )


def hashed(frame: DataFrame, by: tuple[str, ...] = BY, others: Sequence[str] = (), name: str = "hashed") -> DataFrame:
    """What neighbours need, written once: hashed features in the place of ``features``, and the columns ``others``. A frame that is already so is returned as it is."""
    if "feats" in frame.columns:
        return frame
    return materialize(_hashed_rows(frame, by, others).withColumn("row", F.monotonically_increasing_id()), name)


def _sets_without_features(rows: DataFrame) -> DataFrame:
    """One row per distinct set; ``row`` is one of the rows that hold it."""
    in_train, in_test = F.col("split") == "train", F.col("split") == "test"
    train_id = F.when(in_train, F.col("record_id"))
    return (
        rows.filter("n > 0")
        .groupBy("part", "h1", "h2", "n")
        .agg(
            F.min(train_id).alias("train_id"),
            F.min_by(F.when(in_train, F.col("label")), train_id).alias("train_label"),
            F.min(F.when(in_test, F.col("record_id"))).alias("test_id"),
            F.count_if(in_test).alias("copies"),
            F.min("row").alias("row"),
        )
    )


def _with_features(sets: DataFrame, rows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The sets with their features, read from the row that holds them; up to ``broadcast_rows`` sets no features are sent for it."""
    few = sets.select("row", "train_id", "test_id")
    if sets.count() <= broadcast_rows:
        few = F.broadcast(few)
    return rows.select("row", "part", "n", "feats").join(few, "row")


def _distinct_sets(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return _with_features(_sets_without_features(rows), rows)


def _held(sets: DataFrame) -> DataFrame:
    return sets.select("part", F.coalesce("train_id", "test_id").alias("id"), F.col("train_id").isNotNull().alias("in_train"), "n", "feats")


def _entries(held: DataFrame) -> DataFrame:
    return held.select("part", "id", "in_train", "n", F.explode("feats").alias("feature"))


def _vocabulary(held: DataFrame, cell_rows: int) -> DataFrame:
    """The features that both sides have, and how many sets of each."""
    return (
        _entries(held).groupBy("feature")
        .agg(F.count_if(~F.col("in_train")).alias("n_test"), F.count_if("in_train").alias("n_train"))
        .filter("n_test > 0 AND n_train > 0")
        .select(
            "feature",
            (F.col("n_test").cast("double") * F.col("n_train")).alias("cost"),
            F.ceil(F.col("n_test") / cell_rows).cast("int").alias("test_cells"),
            "n_train",
            (F.col("n_test") + F.col("n_train")).alias("_weight"),
        )
    )


def _ordered_sets(sets: DataFrame, cell_rows: int) -> DataFrame:
    held = _held(sets)
    return _ordered(held, materialize(_vocabulary(held, cell_rows), "vocabulary"))


def _ordered(held: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Open test sets and all train sets with their shared features, cheapest first.

    ``front`` counts the features of the set that the other side does not have; they come
    first in the order and can never match, so only their number is kept.
    """
    shared = lookup(_entries(sieved(held, vocabulary, "_weight")), vocabulary, ["feature"], "_weight", "id").filter(
        F.col("cost").isNotNull()
    )
    return (
        shared.groupBy("part", "in_train", "id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("cost", "feature", "test_cells", "n_train"))).alias("features"))
        .select("*", (F.col("n") - F.size("features")).alias("front"))
    )


def _size_class(n: Column, step: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(step) + F.lit(1e-9)).cast("int")


def _smallest_in_class(size_class: Column, step: Column) -> Column:
    """A size no set of the class falls below (rounding only ever widens the class)."""
    return F.greatest(F.floor(F.pow(step, size_class.cast("double") - 1e-6)).cast("int"), F.lit(1))


def _step(fine: Column) -> Column:
    return F.when(fine, F.lit(FINE_STEP)).otherwise(F.lit(SIZE_STEP))


def _slack(needed: Column, share: Column) -> Column:
    return F.when(share < SLACK_BELOW, F.floor(needed * PREFIX_SLACK)).otherwise(F.lit(0)).cast("int")


def _prefix(n: Column, needed: Column, share: Column) -> Column:
    """How many leading features to match: sets sharing ``needed`` features share more than
    ``_slack`` of them here. Where the bound is low, the slack trades a few more matches for
    far fewer exact counts; where it is high, the short prefix keeps frequent features out."""
    return n - needed + 1 + _slack(needed, share)


def _cells(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _own_cell(record: str, count: str) -> Column:
    return F.pmod(F.xxhash64(record), F.col(count)).cast("int")


def _seed_pairs(test: DataFrame, train: DataFrame, seed_features: int) -> DataFrame:
    """For the cheapest features of each test set: one train set per size class, of these the SEED_PAIRS met most often."""
    wanted = (
        test.select("part", F.col("id").alias("test_id"), F.explode(F.slice("features", 1, seed_features)).alias("f"))
        .select("part", "test_id", "f.feature", "f.test_cells")
        .select("part", "test_id", "feature", _own_cell("test_id", "test_cells").alias("cell"))
    )
    representatives = (
        train.select("part", "id", _size_class(F.col("n"), F.lit(2.0)).alias("size_class"), F.explode("features").alias("f"))
        .groupBy("part", "f.feature", "f.test_cells", "size_class")
        .agg(F.min("id").alias("train_id"))
        .select("part", "feature", "train_id", _cells("test_cells").alias("cell"))
    )
    met = wanted.join(representatives, ["part", "feature", "cell"]).select("part", "test_id", "train_id")
    # Those met most often are the likeliest to be close; comparing the others would hardly raise the bound.
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = met.repartition(n, "part", "test_id").groupBy("part", "test_id", "train_id").agg((-F.count("*")).alias("d"))
    most = F.slice(F.array_sort(F.collect_list(F.struct("d", "train_id"))), 1, SEED_PAIRS)
    return hits.groupBy("part", "test_id").agg(most.alias("most")).select("part", "test_id", F.explode("most.train_id").alias("train_id"))


def _routed(bounds: DataFrame, test: DataFrame, train: DataFrame, block_share: float) -> DataFrame:
    """The bounds, and whether the lists that each leaves to its test set hold more than ``block_share`` entries per train set."""
    n_sets = pinned(train.groupBy("part").agg(F.count("*").alias("n_sets")))
    rows = attach(bounds.join(test.selectExpr("part", "id AS test_id", "n", "front", "features"), ["part", "test_id"]), n_sets, ("part",))
    share = F.col("shared") / (F.col("shared") + F.col("either"))
    smallest = F.col("n") + F.ceil(F.expr("n * (shared / either) - 1e-9"))
    reach = _prefix(F.col("n"), F.ceil(smallest * share - F.lit(1e-9)).cast("int"), share)
    ahead = F.slice("features", 1, F.greatest(reach - F.col("front"), F.lit(0)).cast("int"))
    entries = F.aggregate(ahead, F.lit(0).cast("long"), lambda n, f: n + f["n_train"])
    return rows.select(*bounds.columns, (entries > F.col("n_sets") * block_share).alias("by_blocks"))


def _winning_pairs(test: DataFrame, train: DataFrame, bounds: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every pair that could beat the bound of its test set, or tie it with a smaller id.

    Bounds of 0.5 and more (``fine``) meet train sets in narrow size classes and only the front
    half of their features; lower bounds use wide classes and all features.
    """
    share, fine = F.col("share"), F.col("fine")

    # c shared features of two sets with ``total`` features in all reach the bound a/b iff
    # c >= total * share, share = a / (a + b). That product is whole or at least 1 / (a + b)
    # away from whole, so the allowance of 1e-9 only undoes rounding.
    def at_least(total: Column) -> Column:
        return F.ceil(total * share - F.lit(1e-9)).cast("int")

    def more_than(total: Column) -> Column:
        return (F.floor(total * share + F.lit(1e-9)) + 1).cast("int")

    smallest = F.col("test_n") + _smallest_in_class(F.col("size_class"), _step(fine))
    probes = (
        test.selectExpr("part", "id AS test_id", "n AS test_n", "front", "features")
        .join(
            bounds.selectExpr(
                "part",
                "test_id",
                "train_id AS bound_id",
                "shared / (shared + either) AS share",
                "shared / either AS bound",
                "2 * shared >= either AS fine",
            ),
            ["part", "test_id"],
        )
        .withColumn(
            "size_class",
            F.explode(
                F.sequence(
                    _size_class(F.ceil(F.expr("test_n * bound - 1e-9")), _step(fine)),
                    _size_class(F.floor(F.expr("test_n / bound + 1e-9")), _step(fine)),
                )
            ),
        )
        .withColumn("reach", _prefix(F.col("test_n"), at_least(smallest), share))
        .withColumn("to_beat", _prefix(F.col("test_n"), more_than(smallest), share))
        .filter("reach > front")
        .selectExpr(
            "part", "test_id", "bound_id", "share", "fine", "size_class", "test_n", "front", "to_beat",
            "posexplode(slice(features, 1, reach - front)) AS (at, f)",
        )
        .selectExpr(
            "part", "test_id", "bound_id", "share", "fine", "size_class", "test_n", "to_beat",
            "front + at + 1 AS test_at", "f.feature",
        )
    )
    postings = (
        train.selectExpr("part AS _part", "id AS train_id", "n AS train_n", "front", "posexplode(features) AS (at, f)")
        .selectExpr(
            "_part", "train_id", "train_n", "front + at + 1 AS train_at", "f.feature",
            "explode(array(true, false)) AS fine",
        )
        .filter("NOT fine OR train_at <= train_n / 2 + 2")
        .withColumn("size_class", _size_class(F.col("train_n"), _step(fine)))
    )
    # Features past ``to_beat`` can only lead to a tie, which needs a smaller train id. The
    # smallest id per posting list drops most of these probes before they meet the list.
    keys = ["fine", "feature", "size_class"]
    heads = postings.groupBy(*keys).agg(F.min("train_id").alias("first_id"), F.count("*").alias("n_postings"))
    probes = probes.join(heads, keys).filter("test_at <= to_beat OR first_id < bound_id").drop("first_id", "to_beat")
    # Lists that nobody probes stop here, and a list is cut into as many cells as its own postings and
    # probes fill, so a posting is copied only as often as there are cells of probes for its list.
    live = probes.groupBy(*keys).agg(F.count("*").alias("n_probes"), F.first("n_postings").alias("n_postings")).select(
        *keys, F.ceil(F.col("n_probes") / cell_rows).cast("int").alias("test_cells"), F.ceil(F.col("n_postings") / cell_rows).cast("int").alias("train_cells")
    )
    probes = (
        probes.join(live, keys)
        .withColumn("test_cell", _own_cell("test_id", "test_cells"))
        .withColumn("train_cell", _cells("train_cells"))
        .drop("test_cells", "train_cells", "n_postings")
    )
    postings = (
        postings.join(live, keys)
        .withColumn("train_cell", _own_cell("train_id", "train_cells"))
        .withColumn("test_cell", _cells("test_cells"))
        .drop("test_cells", "train_cells")
    )
    total = F.col("test_n") + F.col("train_n")
    needed = F.when(F.col("train_id") < F.col("bound_id"), at_least(total)).otherwise(more_than(total))
    met = (
        probes.join(postings, [*keys, "test_cell", "train_cell"])
        .filter("part = _part AND train_id <> bound_id")
        .withColumn("needed", needed)
        .filter(F.col("test_at") <= _prefix(F.col("test_n"), F.col("needed"), share))
        .filter(F.col("train_at") <= _prefix(F.col("train_n"), F.col("needed"), share))
        .withColumn("slack", _slack(F.col("needed"), share))
        .select("part", "test_id", "train_id", "test_n", "train_n", "needed", "slack", "test_at", "train_at")
    )
    # Shared features not seen yet all come later in both sets, and past a prefix in one of them.
    return (
        _spread(met)
        .groupBy("part", "test_id", "train_id", "test_n", "train_n", "needed", "slack")
        .agg(F.count("*").alias("seen"), F.max("test_at").alias("test_at"), F.max("train_at").alias("train_at"))
        .filter("seen + least(test_n - test_at, train_n - train_at, needed - 1 - slack) >= needed")
        .select("part", "test_id", "train_id")
    )


def _spread(pairs: DataFrame) -> DataFrame:
    """Hash pairs over the session's full number of shuffle partitions.

    Pairs are a few bytes each but costly to count, so adaptive execution must not merge their
    partitions by size. The grouping that follows finds them already in place.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "part", "test_id", "train_id")


def _verify(pairs: DataFrame, test: DataFrame, train: DataFrame) -> DataFrame:
    """Exact intersection and union size of each pair; sets meet in cells and do not travel with the pairs."""
    return shared_sizes(pairs, test, train)


def _best(pairs: DataFrame) -> DataFrame:
    """The most similar train set per test set, ties to the smallest id."""
    rank = F.struct((-F.col("shared") / F.col("either")).alias("d"), "train_id", "shared", "either")
    return (
        pairs.groupBy("part", "test_id")
        .agg(F.min(rank).alias("m"))
        .select("part", "test_id", "m.train_id", "m.shared", "m.either")
    )


def _answer_rows(rows: DataFrame, answers: DataFrame, by: tuple[str, ...]) -> DataFrame:
    first = pinned(
        rows.filter("split = 'train'").groupBy(*by).agg(
            F.min("record_id").alias("_first_id"), F.min_by("label", "record_id").alias("_first_label")
        )
    )
    test = rows.filter("split = 'test'").select(*by, "part", "record_id", "label", "n", "h1", "h2")
    matched = lookup(test, answers, ["part", "h1", "h2"], "copies", "record_id")
    return attach(matched, first, by).select(
        *by,
        "record_id",
        "label",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("nn_id", "_first_id").alias("nn_id"),
        F.coalesce("nn_label", "_first_label", F.lit(0.0)).alias("nn_label"),
        (F.col("n").isNotNull() & F.col("_first_id").isNotNull()).alias("measured"),
    )


def similarity_check(neighbors: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean nearest similarity and the fraction strictly above 0.8, over measured rows."""
    s = F.when(F.col("measured"), F.col("similarity"))
    above = F.count_if(s > TWIN_SIMILARITY)
    return (
        neighbors.groupBy(*by)
        .agg(
            F.count(s).alias("n_measured"),
            F.coalesce(F.avg(s), F.lit(0.0)).alias("nn_mean"),
            safe_ratio(above, F.count(s)).alias("fraction_above_0_8"),
        )
        .withColumn(
            "similarity_message",
            F.format_string(
                "%s%% of test records have a train record more similar than 0.8 (mean nearest similarity %s).",
                fixed(percent(F.col("fraction_above_0_8")), 1),
                fixed(F.col("nn_mean"), 2),
            ),
        )
    )


def similarity_histogram(neighbors: DataFrame, by: tuple[str, ...] = BY, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per bin on [0, 1] with empty bins shown; height is the percentage of the fullest."""
    s = F.col("similarity")
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(s * bins))).cast("int")
    filled = neighbors.filter("measured").groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"))
    grid = filled.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(filled, [*by, "bin"], "left").withColumn("n_rows", F.coalesce("n", F.lit(0)).cast("long"))
    fullest = F.greatest(F.lit(1), F.max("n_rows").over(Window.partitionBy(*by)))
    return full.select(
        *by,
        "bin",
        (F.col("bin") / bins).alias("low"),
        "n_rows",
        F.floor(F.col("n_rows") * 100 / fullest + 0.5).cast("int").alias("height"),
    )
