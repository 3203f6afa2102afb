"""The registered queries. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.catalog.frames import (
    conversation_frame,
    document_frame,
    judged_documents,
    labelled_documents,
    order_frame,
    split_documents,
    split_judged,
    table,
)
from splitguard.functions.labels import label_kind, normalized_split
from splitguard.functions.records import (
    char_shingles,
    fold_features,
    identity_key,
    leading_tokens,
    row_key,
    token_set,
    url_host,
    word_shingles,
)
from splitguard.operators.detect import find_key_column
from splitguard.operators.duplicates import duplicate_check, leaked_rows
from splitguard.operators.groups import group_check, groups_only_in_test, shared_groups
from splitguard.operators.neighbors import hashed, nearest_neighbors, similarity_check, similarity_histogram
from splitguard.operators.prepare import load_strict, missing_sides, prepare, project_record, unexpected_splits
from splitguard.operators.scoring import baseline_check, metric_name
from splitguard.operators.splits import group_split, random_split
from splitguard.plans.checks import audit, collapse_bars, fix_split, split_sizes
from splitguard.plans.sweep import sweep_frame, validation_table
from splitguard.sources.writers import corrected_rows, report_json
from splitguard.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
_DIGITS = 6


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, _DIGITS) for n in names})


# --- raw table with the usual defects, derived from whole columns ---------------------------


def messy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the source decides how the split, label or text is spelled, and many have no label."""
    source = F.col("source")
    docs = labelled_documents(spark, sf_dir)
    spelled = (
        F.when(source == "src0", "Train").when(source == "src1", " VALID ").when(source == "src2", "validation")
        .when(source == "src3", "testing").when(source == "src4", "holdout").when(source == "src5", None)
        .when(source == "src6", "Test").when(source == "src7", "\tval\n").when(source == "src8", "training")
        .when(source == "src14", "test\t").when(source == "src15", " train\n")
        .when(F.col("lang") == "en", "train").otherwise("TEST")
    )
    label = (
        F.when(source == "src9", None).when(source == "src10", "unknown").when(source == "src11", "NaN")
        .when(source == "src16", "Infinity").when(source == "src17", "-Infinity")
        .otherwise(F.col("quality").cast("string"))
    )
    text = F.when(source == "src12", None).when(source == "src13", "  \n ").otherwise(F.col("text"))
    return docs.select("record_id", text.alias("text"), label.alias("label"), spelled.alias("split"), "source")


def prepare_notes(spark, sf_dir):
    return prepare(messy_documents(spark, sf_dir), dataset="messy").notes


def prepare_frame(spark, sf_dir):
    frame = prepare(messy_documents(spark, sf_dir), group_key=F.col("source"), dataset="messy").frame
    return frame.select("record_id", "key", "group_key", F.size("features").alias("n_features"), "label", "split")


def prepare_without_split(spark, sf_dir):
    """No split column: one is created and disclosed."""
    return prepare(messy_documents(spark, sf_dir).drop("split"), dataset="messy").notes


def load_strict_notes(spark, sf_dir):
    return load_strict(messy_documents(spark, sf_dir), key_col="text", dataset="messy").notes


def split_modes(spark, sf_dir):
    raw = messy_documents(spark, sf_dir)
    return raw.groupBy(
        F.col("split").alias("raw_split"),
        normalized_split("split").alias("lenient"),
        normalized_split("split", "strict").alias("strict"),
    ).agg(F.count("*").alias("n_rows"))


def unexpected_split_values(spark, sf_dir):
    return unexpected_splits(messy_documents(spark, sf_dir), "split")


def missing_side_flags(spark, sf_dir):
    """Per source: which side is empty under the strict split names."""
    strict = load_strict(messy_documents(spark, sf_dir), key_col="text", dataset=F.col("source")).frame
    return missing_sides(strict)


def label_kinds(spark, sf_dir):
    def one(frame, name, column):
        return frame.agg(
            label_kind(F.col(column).cast("double")).alias("label_type"),
            metric_name(F.col(column).cast("double")).alias("metric_name"),
        ).select(F.lit(name).alias("label_name"), "label_type", "metric_name")

    labels = table(spark, sf_dir, "labels")
    return (
        one(labels, "quality", "quality")
        .unionByName(one(labels, "toxic", "toxic"))
        .unionByName(one(table(spark, sf_dir, "documents"), "n_chars", "n_chars"))
        .unionByName(one(table(spark, sf_dir, "orders"), "o_totalprice", "o_totalprice"))
        .unionByName(one(table(spark, sf_dir, "embeddings"), "embedding_label", "label"))
    )


# --- features, keys, groups -----------------------------------------------------------------


def feature_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", identity_key("text").alias("key"), F.size(token_set("text")).alias("n_tokens")
    )


def folded_features(spark, sf_dir):
    folded = fold_features(token_set("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", folded.alias("bits"))
    return docs.select(
        "doc_id",
        F.size("bits").alias("n_bits"),
        F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b).alias("bit_sum"),
    )


def shingle_sets(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.size(word_shingles("text", 3)).alias("n_word_runs"),
        F.size(char_shingles("text", 5)).alias("n_char_runs"),
    )


def group_keys(spark, sf_dir):
    """Two group keys of a page: its host, and the first two tokens of its html (an opening is meant to be short)."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", url_host("url").alias("host"), leading_tokens("html", 2).alias("opening")
    )


# --- splits ---------------------------------------------------------------------------------


def _assignment(frame):
    return frame.select("record_id", "split")


def random_split_documents(spark, sf_dir):
    return _assignment(split_documents(spark, sf_dir))


def random_split_orders(spark, sf_dir):
    return _assignment(random_split(order_frame(spark, sf_dir)))


def group_split_documents(spark, sf_dir):
    return _assignment(group_split(document_frame(spark, sf_dir)))


def group_split_orders(spark, sf_dir):
    return _assignment(group_split(order_frame(spark, sf_dir)))


def group_split_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "record_id")
    frame = project_record(
        events, key=F.col("record_id").cast("string"), label=F.col("value"),
        group_key=F.col("user_id").cast("string"), dataset="events",
    )
    return _assignment(group_split(frame, test_frac=0.3))


def group_split_conversations(spark, sf_dir):
    return _assignment(group_split(conversation_frame(spark, sf_dir)))


def group_split_disjoint(spark, sf_dir):
    """Groups on both sides after the group-safe split: none, for documents and for orders."""
    counts = [
        shared_groups(group_split(frame)).agg(F.count("*").alias("n_shared")).select(F.lit(name).alias("dataset"), "n_shared")
        for name, frame in (("documents", document_frame(spark, sf_dir)), ("orders", order_frame(spark, sf_dir)))
    ]
    return counts[0].unionByName(counts[1])


def sizes(spark, sf_dir):
    return split_sizes(random_split(order_frame(spark, sf_dir)))


# --- duplicates and groups ------------------------------------------------------------------


def _no_message(frame):
    return _rounded(frame.drop(*[c for c in frame.columns if c.endswith("_message")]), *[
        c for c in frame.columns if c.startswith("fraction")
    ])


def duplicates(spark, sf_dir):
    return _no_message(duplicate_check(split_documents(spark, sf_dir)))


def duplicates_orders_customer(spark, sf_dir):
    return _no_message(duplicate_check(random_split(order_frame(spark, sf_dir))))


def duplicates_conversations(spark, sf_dir):
    return _no_message(duplicate_check(random_split(conversation_frame(spark, sf_dir))))


def duplicates_messy(spark, sf_dir):
    """Blank and missing texts have no key; such rows count as test rows, not as copies."""
    raw = messy_documents(spark, sf_dir)
    frame = project_record(raw, key=identity_key("text"), label=F.lit(0.0), split=normalized_split("split"), dataset="messy")
    return _no_message(duplicate_check(frame.filter(F.col("split").isNotNull())))


def leaked_messy(spark, sf_dir):
    raw = messy_documents(spark, sf_dir)
    frame = project_record(raw, key=identity_key("text"), label=F.lit(0.0), split=normalized_split("split"), dataset="messy")
    return leaked_rows(frame).select("record_id", "key")


def row_keys_lineitem(spark, sf_dir):
    """Rows of lineitem by content: how many there are per key, and how many keys."""
    keyed = table(spark, sf_dir, "lineitem").select(
        row_key("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").alias("key")
    )
    return keyed.groupBy("key").agg(F.count("*").alias("n_rows"))


def find_key_by_content(spark, sf_dir):
    """A key column that no name gives away, found by the share of values that look like one, over all rows."""
    raw = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("a"), F.when(F.col("doc_id") % 4 == 0, F.lit("no")).otherwise(F.col("source")).alias("b"), F.col("source").alias("c")
    )
    found = find_key_column(raw, lambda c: c.startswith("src"))
    shares = raw.agg(*[F.round(F.avg(F.col(c).startswith("src").cast("double")), _DIGITS).alias(f"share_{c}") for c in raw.columns])
    return shares.withColumn("key_col", F.lit(found))


def leaked_documents(spark, sf_dir):
    return leaked_rows(split_documents(spark, sf_dir)).select("record_id", "key")


def group_overlap(spark, sf_dir):
    return _no_message(group_check(split_documents(spark, sf_dir)))


def group_overlap_orders(spark, sf_dir):
    return _no_message(group_check(random_split(order_frame(spark, sf_dir))))


def group_overlap_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "record_id")
    frame = project_record(
        pages, key=F.md5("html"), label=F.lit(0.0), group_key=url_host("url"), dataset="pages"
    )
    return _no_message(group_check(random_split(frame)))


def shared_customers(spark, sf_dir):
    return shared_groups(random_split(order_frame(spark, sf_dir))).select("group_key")


def conversations_only_in_test(spark, sf_dir):
    return groups_only_in_test(random_split(conversation_frame(spark, sf_dir))).select("group_key")


# --- nearest neighbours and baseline --------------------------------------------------------


def _split_and_neighbors(spark, sf_dir, label="quality"):
    frame = hashed(split_judged(spark, sf_dir, label))
    return frame, materialize(nearest_neighbors(frame), "neighbors")


def nn_similarity(spark, sf_dir):
    frame = split_judged(spark, sf_dir)
    return _rounded(nearest_neighbors(frame).select("record_id", "similarity"), "similarity")


def nn_label_copy(spark, sf_dir):
    frame = split_judged(spark, sf_dir)
    return _rounded(
        nearest_neighbors(frame).select("record_id", "label", "similarity", "nn_id", "nn_label"), "similarity"
    )


def nn_label_copy_conversations(spark, sf_dir):
    """Short records: many equal sets, many ties, and rows that share nothing with train."""
    frame = random_split(conversation_frame(spark, sf_dir))
    return _rounded(
        nearest_neighbors(frame).select("record_id", "label", "similarity", "nn_id", "nn_label"), "similarity"
    )


def nn_label_copy_shingles(spark, sf_dir):
    """Three-word runs as features instead of single tokens."""
    docs = labelled_documents(spark, sf_dir).filter("quality IS NOT NULL")
    frame = project_record(
        docs, key=identity_key("text"), label=F.col("quality").cast("double"), group_key=F.col("source"),
        features=word_shingles("text", 3), dataset="documents",
    )
    frame = random_split(frame)
    return _rounded(nearest_neighbors(frame).select("record_id", "similarity", "nn_id", "nn_label"), "similarity")


def nn_summary(spark, sf_dir):
    _, neighbors = _split_and_neighbors(spark, sf_dir)
    return _rounded(similarity_check(neighbors).drop("similarity_message"), "nn_mean", "fraction_above_0_8")


def nn_histogram(spark, sf_dir):
    _, neighbors = _split_and_neighbors(spark, sf_dir)
    return similarity_histogram(neighbors)


def _baseline(frame, neighbors):
    return _rounded(
        baseline_check(frame, neighbors).select("dataset", "metric_name", "score", "chance"), "score"
    )


def baseline_auroc(spark, sf_dir):
    return _baseline(*_split_and_neighbors(spark, sf_dir))


def baseline_r2(spark, sf_dir):
    return _baseline(*_split_and_neighbors(spark, sf_dir, "n_chars"))


def baseline_one_class(spark, sf_dir):
    """Test keeps only its positive class: AUROC is undefined, and says so."""
    frame = split_judged(spark, sf_dir).filter((F.col("split") == "train") | (F.col("label") == 1))
    frame = hashed(frame)
    neighbors = materialize(nearest_neighbors(frame), "neighbors")
    scores = baseline_check(frame, neighbors)
    return scores.select("dataset", "metric_name", "score", F.col("score").isNull().alias("inconclusive"))


# --- whole jobs -----------------------------------------------------------------------------

_FRACTIONS = ("fraction_leaked", "nn_mean", "fraction_above_0_8", "fraction_shared", "score")
_MESSAGES = ("duplicates_message", "similarity_message", "groups_message", "baseline_message", "summary")


def audit_documents(spark, sf_dir):
    return _rounded(audit(split_judged(spark, sf_dir, runs=True)).drop(*_MESSAGES), *_FRACTIONS)


def audit_numeric_label(spark, sf_dir):
    return _rounded(audit(split_judged(spark, sf_dir, "n_chars")).drop(*_MESSAGES), *_FRACTIONS)


def audit_conversations(spark, sf_dir):
    return _rounded(audit(random_split(conversation_frame(spark, sf_dir))).drop(*_MESSAGES), *_FRACTIONS)


def audit_messy(spark, sf_dir):
    """Detection, cleaning, provided split, then all checks."""
    clean = prepare(messy_documents(spark, sf_dir), group_key=F.col("source"), dataset="messy")
    return _rounded(audit(clean.frame).drop(*_MESSAGES), *_FRACTIONS)


def audit_summary(spark, sf_dir):
    return audit(split_judged(spark, sf_dir, runs=True)).select("dataset", "verdict", *_MESSAGES)


def audit_report_json(spark, sf_dir):
    report = report_json(audit(split_judged(spark, sf_dir, runs=True)))
    field = lambda path: F.get_json_object("report", path)
    return report.select(
        "dataset",
        field("$.verdict").alias("verdict"),
        field("$.checks.duplicates.n_leaked").cast("long").alias("n_leaked"),
        field("$.checks.groups.n_shared").cast("long").alias("n_shared"),
        F.round(field("$.checks.similarity.mean").cast("double"), _DIGITS).alias("nn_mean"),
        F.round(field("$.checks.baseline.score").cast("double"), _DIGITS).alias("score"),
        field("$.checks.baseline.metric_name").alias("metric_name"),
    )


def fix_report(spark, sf_dir):
    return _rounded(fix_split(split_judged(spark, sf_dir, runs=True)).report, "score_before", "score_after")


def fixed_rows(spark, sf_dir):
    frame = split_documents(spark, sf_dir)
    return corrected_rows(group_split(frame).select(*frame.columns))


def collapse_chart(spark, sf_dir):
    bars = collapse_bars(fix_split(split_judged(spark, sf_dir, runs=True)).report)
    return _rounded(bars, "score", "height", "leaking_height", "chance_height")


def sweep_languages(spark, sf_dir):
    return sweep_frame(judged_documents(spark, sf_dir, dataset="lang", runs=True))


def validation_controls(spark, sf_dir):
    """Known answers: test is a copy of train; and distinct records with labels drawn by hash."""
    docs = judged_documents(spark, sf_dir, runs=True)
    both_sides = docs.drop("split").withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    copied = both_sides.withColumn("dataset", F.lit("copy")).withColumn(
        "record_id", F.col("record_id") * 2 + (F.col("split") == "test").cast("long")
    )
    one_per_key = docs.groupBy("key").agg(F.min("record_id").alias("record_id")).drop("key")
    bit = F.substring(F.md5(F.concat(F.col("record_id").cast("string"), F.lit(":label"))), 1, 1) < "8"
    drawn = (
        docs.join(one_per_key, "record_id", "left_semi")
        .withColumn("label", bit.cast("double"))
        .withColumn("dataset", F.lit("drawn"))
    )
    frame = copied.unionByName(random_split(materialize(drawn, "drawn")).select(*docs.columns))
    expected = spark.createDataFrame([("copy", "LEAKING"), ("drawn", "not LEAKING")], "dataset string, expected string")
    return validation_table(frame, expected)


QUERIES: dict[str, Query] = {
    "duplicates": duplicates,
    "duplicates_orders_customer": duplicates_orders_customer,
    "duplicates_conversations": duplicates_conversations,
    "duplicates_messy": duplicates_messy,
    "leaked_messy": leaked_messy,
    "leaked_documents": leaked_documents,
    "row_keys_lineitem": row_keys_lineitem,
    "find_key_by_content": find_key_by_content,
    "prepare_notes": prepare_notes,
    "prepare_frame": prepare_frame,
    "prepare_without_split": prepare_without_split,
    "load_strict_notes": load_strict_notes,
    "split_modes": split_modes,
    "unexpected_splits": unexpected_split_values,
    "missing_sides": missing_side_flags,
    "label_kind": label_kinds,
    "feature_sets": feature_sets,
    "folded_features": folded_features,
    "shingle_sets": shingle_sets,
    "group_keys": group_keys,
    "random_split": random_split_documents,
    "random_split_orders": random_split_orders,
    "group_split": group_split_documents,
    "group_split_orders": group_split_orders,
    "group_split_events": group_split_events,
    "group_split_conversations": group_split_conversations,
    "group_split_disjoint": group_split_disjoint,
    "split_sizes": sizes,
    "group_overlap": group_overlap,
    "group_overlap_orders": group_overlap_orders,
    "group_overlap_pages": group_overlap_pages,
    "shared_groups": shared_customers,
    "groups_only_in_test": conversations_only_in_test,
    "nn_similarity": nn_similarity,
    "nn_label_copy": nn_label_copy,
    "nn_label_copy_conversations": nn_label_copy_conversations,
    "nn_label_copy_shingles": nn_label_copy_shingles,
    "nn_summary": nn_summary,
    "nn_histogram": nn_histogram,
    "baseline_auroc": baseline_auroc,
    "baseline_r2": baseline_r2,
    "baseline_one_class": baseline_one_class,
    "audit": audit_documents,
    "audit_numeric_label": audit_numeric_label,
    "audit_conversations": audit_conversations,
    "audit_messy": audit_messy,
    "audit_summary": audit_summary,
    "audit_report_json": audit_report_json,
    "fix_report": fix_report,
    "fixed_rows": fixed_rows,
    "collapse_bars": collapse_chart,
    "sweep": sweep_languages,
    "validation_table": validation_controls,
}
