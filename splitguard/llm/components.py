"""Connected components of a graph given by its edges, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of an edge of ``edges`` (columns a, b): the smallest id reachable.

    Alternates large-star and small-star steps: each hangs the neighbours of a vertex on the smallest of
    them, first those above it, then those below. When nothing changes, every vertex hangs on the
    smallest one of its component. Each round is written out, so lineage stays short. Edges with a NULL
    end and loops are ignored.
    """
    stars = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("low")).distinct(), "edges"
    )
    seen = _state(stars)
    while seen[0]:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        now = _state(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("low").alias("v"), F.col("low").alias("component")).distinct()
    return stars.select("v", F.col("low").alias("component")).unionByName(roots)


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("v", "low").cast("decimal(38,0)"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select("low", "v"))
    least = both.groupBy(F.col("v").alias("u")).agg(F.min("low").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, F.col("v") == F.col("u")).filter(F.col("low") > F.col("u"))
    return hung.select(F.col("low").alias("v"), F.col("m").alias("low")).filter("v <> low").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    below = stars.select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("w"))
    least = below.groupBy(F.col("u").alias("x")).agg(F.min("w").alias("m"))
    hung = below.join(least, F.col("u") == F.col("x")).select(F.col("w").alias("v"), F.col("m").alias("low"))
    return hung.union(least.select("x", "m")).filter("v <> low").distinct()
