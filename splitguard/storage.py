"""Where intermediate tables go, and the joins whose broadcast side has a proven size."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitguard.config import LOCAL_FACTS


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting, where driver and tasks share one disk, gets a temporary
    folder of its own; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="splitguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, also if it is not installed."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back.

    A table used by several later stages is then computed once, survives lost executors,
    stays column-prunable, and gives the optimizer its true size. Everything lies under one
    ``splitguard`` folder there, which may be deleted once no result that reads it is needed any more.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/splitguard/{uuid.uuid4().hex}/{name}"
    # zstd frees its buffers when a file is closed; snappy's direct ones wait for a full collection.
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def pinned(facts: DataFrame, limit: int = LOCAL_FACTS) -> DataFrame:
    """Compute facts that hold one row per data set, once.

    Plans built on top start from these values instead of repeating the job that found them. Up to
    ``limit`` rows they are a local table and are broadcast; beyond that they are a written table and
    joins shuffle it. There is no limit to their number.
    """
    rows = facts.limit(limit + 1).collect()
    if len(rows) > limit:
        return materialize(facts, "facts")
    return F.broadcast(facts.sparkSession.createDataFrame(rows, facts.schema))


def attach(rows: DataFrame, facts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Left-join pinned facts."""
    return rows.join(facts, list(by), "left")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    weight: str,
    spread_by: str,
    hot_keys: int = 1000,
) -> DataFrame:
    """Left-join ``rows`` to ``table`` (one row per key) when few keys may hold most rows.

    ``weight`` is a column of ``table`` with the number of ``rows`` of that key. A key that
    holds at least 1/hot_keys of all rows is answered from a broadcast: there can be at most
    ``hot_keys`` such keys, whatever the data. The shuffle join answers the rest, and rows
    already answered travel under scattered keys, so no partition gathers a hot key.
    NULL keys match NULL keys. ``weight`` is not kept.
    """
    values = [c for c in table.columns if c not in on and c != weight]
    total = table.agg(F.sum(weight).alias("n")).scalar()
    share = F.col(weight) * F.lit(hot_keys)

    def side(part: DataFrame, tag: str) -> DataFrame:
        keys = [F.col(k).alias(f"_{tag}_{k}") for k in on]
        return part.select(*keys, *[F.col(v).alias(f"_{tag}_{v}") for v in values], F.lit(True).alias(f"_{tag}"))

    def same(tag: str):
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{tag}_{k}"))
        return cond

    hot = side(table.filter(share >= total), "hot")
    cold = side(table.filter(share < total), "cold").withColumn("_cold_place", F.lit(0))
    answered = rows.join(F.broadcast(hot), same("hot"), "left")
    placed = answered.withColumn(
        "_place",
        F.when(F.col("_hot"), F.lit(1) + F.pmod(F.xxhash64(spread_by), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)),
    )
    joined = placed.join(cold, same("cold") & (F.col("_place") == F.col("_cold_place")), "left")
    return joined.select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values],
    )
