"""Turn a raw labelled table into the frame the checks work on, with notes on every decision."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitguard.config import TEXT_KEY_NAMES
from splitguard.functions.labels import label_kind, normalized_split, numeric_label, split_name
from splitguard.functions.records import identity_key, structure_key, structure_tokens, token_set
from splitguard.operators.detect import find_key_column, find_label_column, find_split_column
from splitguard.operators.splits import make_split, split_source_note
from splitguard.sources.readers import require_columns

FRAME_COLUMNS = ("dataset", "record_id", "key", "group_key", "features", "label", "split")
Expr = Callable[[Column], Column]


class Prepared(NamedTuple):
    frame: DataFrame
    notes: DataFrame


def project_record(
    raw: DataFrame,
    key: Column,
    label: Column,
    split: Column | None = None,
    group_key: Column | None = None,
    features: Column | None = None,
    dataset: Column | str = "data",
) -> DataFrame:
    """Project any table with a ``record_id`` onto the fixed columns."""
    require_columns(raw, "record_id")
    return raw.select(
        (F.lit(dataset) if isinstance(dataset, str) else dataset).alias("dataset"),
        "record_id",
        key.alias("key"),
        (F.lit(None) if group_key is None else group_key).cast("string").alias("group_key"),
        (F.lit(None).cast("array<string>") if features is None else features).alias("features"),
        label.alias("label"),
        (F.lit(None).cast("string") if split is None else split).alias("split"),
    )


def prepare(
    raw: DataFrame,
    key_col: str | None = None,
    label_col: str | None = None,
    split_col: str | None = None,
    make_split_method: str = "random",
    test_frac: float = 0.2,
    seed: int = 42,
    key: Expr | None = None,
    features: Expr | None = None,
    group_key: Column | None = None,
    is_record: Expr | None = None,
    dataset: Column | str = "data",
    split_mode: str = "lenient",
) -> Prepared:
    """Detect columns, derive the key, feature set and group, clean labels, settle the split.

    A named column wins over detection. Rows are dropped for a NULL key first, then for a
    label that is missing or no number, then for a split that is neither train nor test.
    Without ``key`` and ``features``, case is folded only where the key column is called like a text;
    elsewhere two records that differ in case are different records.
    Column detection by content, and creating a split, run jobs here; the rest is lazy.
    """
    key_col = key_col or find_key_column(raw, is_record or (lambda c: (key or structure_key)(c).isNotNull()))
    if key_col is None or key_col not in raw.columns:
        raise ValueError(f"no key column found; name one of {raw.columns}")
    if split_col is not None:
        require_columns(raw, split_col)
    else:
        split_col = find_split_column(raw)
    label_col = label_col or find_label_column(raw, key_col, split_col)
    if label_col is None or label_col not in raw.columns:
        raise ValueError(f"no label column found; name one of {raw.columns}")
    is_text = key_col.strip().lower() in TEXT_KEY_NAMES
    key = key or (identity_key if is_text else structure_key)
    features = features or (token_set if is_text else structure_tokens)

    record = F.col(f"`{key_col}`")
    split_raw = F.lit(None).cast("string") if split_col is None else normalized_split(F.col(f"`{split_col}`"), split_mode)
    staged = project_record(
        raw, key(record), numeric_label(F.col(f"`{label_col}`")), split_raw, group_key, features(record), dataset
    )
    clean = staged.filter(F.col("key").isNotNull() & F.col("label").isNotNull())
    if split_col is None:
        frame = make_split(clean, make_split_method, test_frac, seed)
        source = split_source_note(make_split_method, test_frac, seed)
    else:
        frame = clean.filter(F.col("split").isNotNull())
        source = f"provided column '{split_col}'" + (" (valid folded into train)" if split_mode == "lenient" else "")
    frame = frame.select(*FRAME_COLUMNS)
    return Prepared(frame, _notes(staged, frame, key_col, label_col, split_col, source))


def _notes(
    staged: DataFrame, frame: DataFrame, key_col: str, label_col: str, split_col: str | None, source: str
) -> DataFrame:
    has_key, has_label = F.col("key").isNotNull(), F.col("label").isNotNull()
    dropped = staged.groupBy("dataset").agg(
        F.count("*").alias("n_input"),
        F.count_if(~has_key).alias("dropped_bad_key"),
        F.count_if(has_key & ~has_label).alias("dropped_missing_label"),
        (
            F.count_if(has_key & has_label & F.col("split").isNull()) if split_col is not None else F.lit(0)
        ).cast("long").alias("dropped_unusable_split"),
    )
    kept = frame.groupBy("dataset").agg(
        label_kind("label").alias("label_type"),
        F.count("*").alias("n_kept"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    return dropped.join(kept, "dataset", "left").select(
        "dataset",
        "n_input",
        F.lit(key_col).alias("key_col"),
        F.lit(label_col).alias("label_col"),
        "dropped_bad_key",
        "dropped_missing_label",
        "dropped_unusable_split",
        F.coalesce("label_type", F.lit("continuous")).alias("label_type"),
        F.lit(source).alias("split_source"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_kept", "n_train", "n_test")],
    )


def load_strict(
    raw: DataFrame,
    key_col: str = "smiles",
    label_col: str = "label",
    split_col: str = "split",
    **options,
) -> Prepared:
    """The strict loader: all three columns must exist and only train / test are kept."""
    require_columns(raw, key_col, label_col, split_col)
    return prepare(raw, key_col, label_col, split_col, split_mode="strict", **options)


def unexpected_splits(raw: DataFrame, split_col: str) -> DataFrame:
    """Distinct split values (trimmed, lower case) other than train and test, with row counts."""
    name = split_name(F.col(f"`{split_col}`"))
    return (
        raw.select(name.alias("split_value"))
        .filter(~F.coalesce(F.col("split_value").isin("train", "test"), F.lit(False)))
        .groupBy("split_value")
        .agg(F.count("*").alias("n_rows"))
    )


def missing_sides(frame: DataFrame) -> DataFrame:
    """Which of train / test hold no row at all, per data set."""
    return frame.groupBy("dataset").agg(
        (F.count_if(F.col("split") == "train") == 0).alias("train_missing"),
        (F.count_if(F.col("split") == "test") == 0).alias("test_missing"),
    )


def require_rows(frame: DataFrame) -> DataFrame:
    """Guard at the boundary of a job: a frame without rows is an error."""
    if frame.isEmpty():
        raise ValueError("no usable rows left; check the key, label and split columns")
    return frame
