"""Label coercion, label kind and split-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitguard.config import SPLIT_SYNONYMS


def numeric_label(raw: Column | str) -> Column:
    """The label as a double; text that is no number, NaN and infinities become NULL."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    value = raw.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def is_binary(label: Column | str) -> Column:
    """Aggregate: the distinct labels are exactly {0, 1}. Constant state, no distinct."""
    v = F.col(label) if isinstance(label, str) else label
    return F.coalesce(
        (F.min(v) == 0.0) & (F.max(v) == 1.0) & (F.count_if((v != 0.0) & (v != 1.0)) == 0),
        F.lit(False),
    )


def label_kind(label: Column | str) -> Column:
    """Aggregate: 'binary' or 'continuous'."""
    return F.when(is_binary(label), F.lit("binary")).otherwise(F.lit("continuous"))


def split_name(raw: Column) -> Column:
    """The split name in lower case, without white space of any kind at its ends."""
    return F.lower(F.regexp_replace(raw.cast("string"), r"^\s+|\s+$", ""))


def normalized_split(raw: Column | str, mode: str = "lenient") -> Column:
    """Trimmed, lower-case split name, or NULL if it is neither train nor test.

    ``lenient`` folds validation spellings into train; ``strict`` accepts only train and test.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    name = split_name(raw)
    if mode == "lenient":
        folded = name
        for spelling, side in SPLIT_SYNONYMS.items():
            folded = F.when(name == spelling, F.lit(side)).otherwise(folded)
        name = folded
    elif mode != "strict":
        raise ValueError(f"unknown split mode {mode!r}")
    return F.when(name.isin("train", "test"), name)
