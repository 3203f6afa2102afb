"""Gapless row numbers within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_CELL = 1000  # groups up to this size are numbered in one piece
MAX_CELLS = 20_000  # all larger groups together are cut into about so many pieces


def ranked(frame: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (0.. within the group) and ``place`` (0.. over all rows, groups in ascending order).

    ``frame`` should be a materialized table: it is read three times. ``group`` must have a bounded
    number of values whatever the data (a curve cell, a length up to a capacity). A large group is cut
    into pieces by a hash of ``order``; the rows of a piece are numbered by ``order``, and the pieces
    follow one another. Counts per piece are at most MAX_CELLS plus one per group value and one per
    MIN_CELL-sized remainder, so the table of their offsets is small and broadcast.
    Rows alike in ``group`` and ``order`` get different numbers in any order.
    """
    sizes = frame.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    per_piece = F.greatest(F.lit(MIN_CELL), F.ceil(total / MAX_CELLS))
    pieces = sizes.select("_g", F.ceil(F.col("_n") / per_piece).alias("_pieces"))
    cut = frame.join(F.broadcast(pieces), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(
        "_piece", F.pmod(F.xxhash64(*order), F.col("_pieces"))
    )
    counts = cut.groupBy("_g", "_piece").agg(F.count("*").alias("_n"))
    # One row per piece, so the single-partition window is over a bounded table.
    before = Window.orderBy("_g", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_g").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_g").alias("_og"), F.col("_piece").alias("_op"),
        F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_in_group"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in_all"),
    )
    row = F.row_number().over(Window.partitionBy("_g", "_piece").orderBy(*order)) - 1
    numbered = cut.withColumn("_row", row).join(
        F.broadcast(offsets), F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_piece") == F.col("_op")), "left"
    )
    return numbered.select(
        *[frame[c] for c in frame.columns],
        (F.col("_in_group") + F.col("_row")).alias("rank"), (F.col("_in_all") + F.col("_row")).alias("place"),
    )
