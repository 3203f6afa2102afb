"""Identity keys, feature sets and group keys as column expressions, all but ``char_run_hashes`` on the JVM's side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from splitguard.config import FOLDED_WIDTH

RUN_CHARS = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_text(text: Column | str, fold_case: bool = True) -> Column:
    """Runs of white space folded to one blank, ends trimmed, and lower case if wanted."""
    text = F.lower(_col(text)) if fold_case else _col(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def identity_key(text: Column | str, fold_case: bool = True) -> Column:
    """One spelling per record; NULL for a NULL or blank record."""
    norm = normalized_text(text, fold_case)
    return F.when(F.length(norm) > 0, F.md5(norm))


def structure_key(record: Column | str) -> Column:
    """Identity of a record in which case carries meaning."""
    return identity_key(record, fold_case=False)


def structure_tokens(record: Column | str) -> Column:
    """Tokens of a record in which case carries meaning."""
    return token_set(record, fold_case=False)


def row_key(*cols: Column | str) -> Column:
    """Identity of a row by several columns; NULL if any of them is NULL.

    Each value goes in with its length, so no two rows with different values share a key by their joins.
    """
    parts = [_col(c).cast("string") for c in cols]
    complete = F.lit(True)
    for p in parts:
        complete = complete & p.isNotNull()
    return F.when(complete, F.md5(F.concat_ws(",", *[F.concat_ws(":", F.length(p).cast("string"), p) for p in parts])))


def token_set(text: Column | str, fold_case: bool = True) -> Column:
    """The distinct blank-separated tokens of the normalised text."""
    return F.array_remove(F.array_distinct(F.split(normalized_text(text, fold_case), " ")), "")


def _with_value(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once per row.

    A lambda that mentions an outer expression computes it again for every element; bound to
    a lambda variable it is computed once.
    """
    return F.element_at(F.transform(F.array(value), build), 1)


def _starts(length: Column, width: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(length - F.lit(width - 1), F.lit(1)))


def word_runs(text: Column | str, width: int) -> Column:
    """The run of ``width`` tokens at each place, in order; a shorter text gives its one run, a blank one ''."""
    words = F.array_remove(F.split(normalized_text(text), " "), "")
    return _with_value(
        words,
        lambda w: F.transform(_starts(F.size(w), width), lambda i: F.array_join(F.slice(w, i, width), " ")),
    )


def word_shingles(text: Column | str, width: int) -> Column:
    """Distinct runs of ``width`` tokens; a shorter text gives its one run."""
    return F.array_remove(F.array_distinct(word_runs(text, width)), "")


def char_shingles(text: Column | str, width: int) -> Column:
    """Distinct runs of ``width`` characters of the normalised text."""
    # As an array, so that a run is found without counting characters from the start of the text.
    runs = _with_value(
        F.regexp_extract_all(normalized_text(text), F.lit("(?s)."), 0),
        lambda t: F.transform(_starts(F.size(t), width), lambda i: F.array_join(F.slice(t, i, width), "")),
    )
    return F.array_remove(F.array_distinct(runs), "")


def char_run_hashes(text: Column | str, width: int) -> Column:
    """``char_shingles`` as 64-bit hashes of their characters; the runs themselves are never built.

    A few documents at a time are laid out as code points, so memory does not follow the size of a batch. Workers have to find this package.
    """
    return F.arrow_udf(lambda texts: _run_hashes(texts, width), "array<bigint>")(normalized_text(text))


def _run_hashes(texts: pa.Array, width: int) -> pa.Array:
    plain = [t or "" for t in texts.to_pylist()]
    found: list[np.ndarray] = []
    while len(found) < len(plain):
        at = stop = len(found)
        size = 0
        while stop < len(plain) and (stop == at or size + len(plain[stop]) <= RUN_CHARS):
            size += len(plain[stop])
            stop += 1
        found += _distinct_hashes(plain[at:stop], width)
    # A missing text has one run that is missing, as ``char_shingles`` has it.
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    found = [np.zeros(1, np.int64) if m else f for m, f in zip(missing, found)]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    values = pa.array(np.concatenate([np.empty(0, np.int64), *found]), mask=np.repeat(missing, sizes))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _distinct_hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's runs. A shorter text is filled up with what is no character."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    filled = np.where(sizes > 0, np.maximum(sizes, width), 0)
    starts = np.append(0, np.cumsum(filled))
    chars = np.full(starts[-1], 0x110000, dtype=np.uint64)
    chars[np.repeat(starts[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(points))] = points
    chars *= np.uint64(0xD6E8FEB86659FD93)
    code = np.zeros(max(len(chars) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        code = (code ^ chars[k : k + len(code)]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    code = code.view(np.int64)
    return [np.unique(code[start : max(stop - width + 1, start)]) for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist())]


def fold_features(features: Column | str, width: int = FOLDED_WIDTH) -> Column:
    """Fold features onto ``width`` bit positions (the sorted set of bits that are on).

    The position comes from md5, so other engines can reproduce it.
    """
    slot = lambda f: F.conv(F.substring(F.md5(f.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(width)
    return F.array_sort(F.array_distinct(F.transform(_col(features), slot)))


def set_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard (Tanimoto) similarity of two sets; two empty sets give 0."""
    both = F.size(F.array_intersect(_col(a), _col(b)))
    either = F.size(_col(a)) + F.size(_col(b)) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def url_host(url: Column | str) -> Column:
    """Host part of a URL as a group key."""
    return F.regexp_extract(F.lower(_col(url)), r"^[a-z]+://([^/:?#]+)", 1)


def leading_tokens(text: Column | str, n: int) -> Column:
    """The first ``n`` tokens as a group key; a blank text gives ''."""
    return F.array_join(F.slice(F.split(normalized_text(text), " "), 1, n), " ")
