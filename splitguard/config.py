"""Fixed values and tunable limits."""

from __future__ import annotations

# --- fixed values: they decide verdicts and column detection, so they must not drift ---

# Verdict limits. Every comparison with them is strict (>).
THRESHOLDS = {
    "dup_leaking": 0.05,
    "sim_leaking": 0.50,
    "scaffold_suspect": 0.50,
    "baseline_leaking": 0.85,
    "baseline_clean": 0.65,
    "r2_leaking": 0.70,
    "r2_clean": 0.40,
}

# A nearest train record above this similarity counts as a twin.
TWIN_SIMILARITY = 0.8

# A side with fewer rows than this makes the verdict low-confidence.
MIN_RELIABLE_ROWS = 50

# Column names recognised when the caller names none (trimmed, lower case).
KEY_NAMES = ("smiles", "mol", "smi", "canonical_smiles", "structure")
SPLIT_NAMES = ("split", "model", "set", "subset", "group")
SPLIT_WORDS = ("train", "test", "valid", "validation", "val")
LABEL_NAMES = ("label", "class", "target", "y", "activity", "p_np", "active", "outcome")
NOT_LABEL_NAMES = ("id", "cid", "num", "name", "compound id", "cmpd_chemblid")

# Split spellings folded onto train / test by the lenient normaliser.
SPLIT_SYNONYMS = {
    "validation": "train",
    "valid": "train",
    "val": "train",
    "training": "train",
    "testing": "test",
}

# Key detection by content: the share of non-null values that must look valid.
SNIFF_SHARE = 0.7

# Similarity histogram bins and folded feature width.
HISTOGRAM_BINS = 10
FOLDED_WIDTH = 2048

# --- our own limits ---

# Words tried after KEY_NAMES when the records are text rather than structures.
TEXT_KEY_NAMES = ("text", "content", "html", "document", "record", "sequence")

# Facts with one row per data set are broadcast up to this number of rows, and joined by shuffle beyond.
LOCAL_FACTS = 10_000
