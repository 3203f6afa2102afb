"""Items found in the texts of an outer corpus, by how much of the item one stretch of matches covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.functions.records import word_runs
from splitguard.operators.extended import OVERLAP
from splitguard.storage import materialize

COVERAGE = 0.90
WIDTH = 8
BROADCAST_RUNS = 500_000
SALTS = 64


def corpus_hits(
    items: DataFrame, corpus: DataFrame, item_id: str, corpus_id: str, width: int = WIDTH, window: int = WIDTH,
    overlap: float = OVERLAP, coverage: float = COVERAGE, broadcast_runs: int = BROADCAST_RUNS, salts: int = SALTS,
) -> DataFrame:
    """One row per item and text of the corpus that holds it: item_id, corpus_id, first_word, last_word, overlap, coverage.

    A word of the item is matched if a run of ``width`` words over it occurs anywhere in the text. Matched
    runs with at most ``window`` unmatched words between them form one stretch; ``coverage`` is the share of the
    item that the longest stretch spans (ties to the first), ``overlap`` the share of matched words in it. Both must
    reach their bounds. Items shorter than a run are one run, blank and NULL ones match nothing; ids should be unique.

    The items' runs are broadcast up to ``broadcast_runs`` of them; beyond that they are copied onto ``salts``
    keys each, over which the texts that share one run are spread. A stretch is found among the runs of one item in one text.
    """
    cut = items.select(F.col(item_id).alias("_item"), word_runs("text", width).alias("runs"))
    n_words = F.when(F.size("runs") > 1, F.size("runs") + width - 1).otherwise(F.size(F.split(F.get("runs", F.lit(0)), " ")))
    own = materialize(cut.select("_item", n_words.alias("n_words"), F.posexplode("runs").alias("at", "run")).filter("run <> ''"), "item_runs")
    there = corpus.select(F.col(corpus_id).alias("_text"), F.explode(F.array_distinct(word_runs("text", width))).alias("run"))
    if own.count() <= broadcast_runs:
        met = there.join(F.broadcast(own), "run")
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = there.withColumn("salt", F.pmod(F.xxhash64("_text"), F.lit(salts)).cast("int")).join(salted, ["run", "salt"])
    return _stretches(met.select("_item", "_text", "at", "n_words"), width, window).filter((F.col("overlap") >= overlap) & (F.col("coverage") >= coverage)).select(
        F.col("_item").alias(item_id), F.col("_text").alias(corpus_id), "first_word", "last_word", "overlap", "coverage"
    )


def _stretches(met: DataFrame, width: int, window: int) -> DataFrame:
    """The longest stretch per item and text; words count from 1."""
    pair = Window.partitionBy("_item", "_text").orderBy("at")
    length: Column = F.least(F.lit(width), F.col("n_words"))
    step = F.col("at") - F.lag("at").over(pair)
    marked = met.withColumn("step", step).withColumn("opens", F.col("step").isNull() | (F.col("step") > length + window))
    numbered = marked.withColumn("stretch", F.sum(F.col("opens").cast("int")).over(pair))
    new_words = F.when(F.col("opens"), length).otherwise(F.least(length, F.col("step")))
    found = numbered.groupBy("_item", "_text", "stretch").agg(
        (F.min("at") + 1).alias("first_word"), F.max(F.col("at") + length).alias("last_word"), F.sum(new_words).alias("matched"), F.first("n_words").alias("n_words")
    )
    span = F.col("last_word") - F.col("first_word") + 1
    sized = found.select("_item", "_text", F.struct(span.alias("span"), (-F.col("first_word")).alias("back"), "first_word", "last_word", "matched", "n_words").alias("s"))
    best = sized.groupBy("_item", "_text").agg(F.max("s").alias("s")).select("_item", "_text", "s.*")
    return best.select("_item", "_text", "first_word", "last_word", (F.col("matched") / F.col("span")).alias("overlap"), (F.col("span") / F.col("n_words")).alias("coverage"))


def corpus_contamination(items: DataFrame, hits: DataFrame, item_id: str) -> DataFrame:
    """One row per item: n_texts that hold it, its greatest coverage, and severity (HIGH for any)."""
    seen = hits.groupBy(item_id).agg(F.count("*").alias("n"), F.max("coverage").alias("coverage"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return items.select(item_id).join(seen, item_id, "left").select(item_id, n.alias("n_texts"), "coverage", F.when(n > 0, "HIGH").otherwise("PASS").alias("severity"))
