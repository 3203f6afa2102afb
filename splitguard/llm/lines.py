"""Line dedup over a range-partitioned, sorted stream of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.storage import materialize

MIN_CHARS = 10
HOT_LINES = 1000  # a line that holds at least 1/HOT_LINES of all lines is split; there can be no more of them
HOT_PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    """The text split at line feeds; a NULL or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case and other letters as they are."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_keeps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Which lines of each document stay: doc_id, mark, n_lines, n_dropped, keep_runs. No text is returned.

    A key of at least ``min_chars`` code points found in several documents loses all its lines but those
    in the document with the smallest id; all lines there stay. ``keep_runs`` is the keep bitmap in
    run-length form: (first line, number of lines) of each run that stays. A document that loses all
    lines has no runs. A NULL id sorts before all others, rows with one id count as one document, and
    ``mark`` (hash of the text) tells their rows apart. Other columns are not read; an empty table gives
    no rows.

    The 128-bit hashes of the lines are range-partitioned and sorted by document and position; the first
    document of each hash is read off that stream. A hash with a large share of all lines is spread over
    parts, each of them sorted likewise, and its first document comes from a pre-aggregated table of
    at most ``HOT_LINES`` rows.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("mark"), text_lines(text).alias("lines"))
    exploded = source.select("doc_id", "mark", F.posexplode("lines").alias("pos", "line"))
    keyed = exploded.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashes = materialize(
        keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "mark", "pos"), "line_hashes"
    )

    hot = _hot_hashes(hashes)
    part = F.when(F.col("first_of_all").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    placed = hashes.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("part", part)
    stream = Window.partitionBy("h1", "h2", "part").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.repartitionByRange("h1", "h2", "part").withColumn("first_here", F.first(F.struct("doc_id")).over(stream))
    first = F.coalesce("first_of_all", "first_here")["doc_id"]
    dropped = marked.filter(~F.col("doc_id").eqNullSafe(first)).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))

    sizes = docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("mark"), F.size(text_lines(text)).alias("n_lines"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "dropped")
    found = sizes.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return found.select(
        "doc_id", "mark", F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        _keep_runs(F.col("n_lines"), F.coalesce("dropped", F.array().cast("array<int>"))).alias("keep_runs"),
    )


def _hot_hashes(hashes: DataFrame) -> DataFrame:
    """The hashes with a large share of all lines, and the first document of each.

    Counting by the low 16 bits finds the few slots that can hold one; only their hashes are counted in full.
    """
    slot = F.col("h1").bitwiseAND(F.lit(0xFFFF))
    slots = hashes.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    total = slots.agg(F.sum("n")).scalar()
    heavy = slots.filter(F.col("n") * HOT_LINES >= total).select("slot")
    counted = (
        hashes.join(F.broadcast(heavy), slot == F.col("slot"), "left_semi")
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("first_of_all"))
    )
    return counted.filter(F.col("n") * HOT_LINES >= total).select("h1", "h2", "first_of_all")


def _keep_runs(n: Column, dropped: Column) -> Column:
    """The runs of 0..n-1 that hold no dropped position, from the sorted dropped positions."""
    # Each gap lies between one dropped position (or the start) and the next (or the end).
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n))
    gaps = F.zip_with(before, after, lambda b, a: F.struct((b + 1).alias("first"), (a - b - 1).alias("n")))
    return F.filter(gaps, lambda g: g["n"] > 0)


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The kept lines joined by line feeds."""
    # The lines are bound to a lambda variable, so the text is split once and not once per run.
    joined = F.transform(
        F.array(text_lines(text)),
        lambda lines: F.array_join(F.flatten(F.transform(keep_runs, lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n"),
    )
    return F.element_at(joined, 1)


def apply_keeps(docs: DataFrame, keeps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: row (a struct of all its columns), kept_text, n_lines, n_dropped."""
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    right = keeps.dropDuplicates(["doc_id", "mark"])
    joined = left.join(right, F.col("id").eqNullSafe(F.col("doc_id")) & (F.hash("text") == F.col("mark")), "left")
    return joined.select("row", kept_text(F.col("text"), F.col("keep_runs")).alias("kept_text"), "n_lines", "n_dropped")
