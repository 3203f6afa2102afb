"""Nearest train vector of every test record, exactly, and what closeness in vectors but not in features says of a split.

Train vectors lie in cells around a few of them and are read cell by cell in blocks; test vectors go
through in blocks of bounded size, broadcast for one pass each. Within a block of train vectors angles to
its middle bound all cosines (triangle inequality on the sphere), so test vectors that no member could
serve are left out; the rest is one matrix product. A task hands back one row per test record, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitguard.functions.numbers import safe_ratio
from splitguard.functions.records import set_similarity
from splitguard.operators.extended import QUARTILES
from splitguard.operators.order_stats import exact_percentiles
from splitguard.operators.splits import BY
from splitguard.storage import attach, let_workers_import, materialize, pinned

PIVOTS = 64
BLOCK = 4096  # train vectors compared at once
ASKED = 512  # test vectors compared at once
TEST_VALUES = 4_000_000  # components of test vectors that go through train in one pass
ROUNDING = 1e-12  # products this close are compared again, summed in one fixed order

FOUND = "part long, record_id {id}, near_id {id}, cosine double, n_close long"


def usable_vector(vector: Column) -> Column:
    """Neither NULL, empty, zero nor with a component that is NULL or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest_vectors(frame: DataFrame, limit: float, by: tuple[str, ...] = BY, vec_col: str = "vector", test_values: int = TEST_VALUES) -> DataFrame:
    """One row per test record with a usable vector: near_id, cosine, n_close.

    ``near_id`` is the train record of its data set with the largest cosine, ties to the smallest id; ``n_close``
    counts train records with a cosine above ``limit``. NULL and 0 where train has no usable vector. Vectors
    of another length than most are not usable. Ids should name records; test records that share one come out once each.
    """
    let_workers_import(frame.sparkSession)
    rows = frame.select(F.xxhash64(*by).alias("part"), *by, "record_id", "split", F.col(vec_col).cast("array<double>").alias("vec")).filter(usable_vector(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.filter(F.size("vec") == dim)
    train = _celled(rows.filter("split = 'train'").select("part", "record_id", "vec"), dim)
    test = rows.filter("split = 'test'").select("part", *by, "record_id", "vec")
    n_blocks = max(1, -(-test.count() * dim // test_values))
    block = F.pmod(F.xxhash64("part", "record_id"), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        asked = test.select("part", "record_id", "vec").filter(block == b).toArrow()
        part = materialize(_compared(train, asked, dim, limit), f"nearest_{b}")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("part", "record_id").agg(F.min(F.struct((-F.col("cosine")).alias("d"), "near_id")).alias("m"), F.sum("n_close").alias("n_close"))
    out = test.drop("vec").join(best, ["part", "record_id"], "left")
    return out.select(*by, "record_id", F.col("m.near_id").alias("near_id"), (-F.col("m.d")).alias("cosine"), F.coalesce("n_close", F.lit(0)).cast("long").alias("n_close"))


def _celled(train: DataFrame, dim: int) -> DataFrame:
    """Train vectors written cell by cell. The cells only decide what can be left out, so any pivots do."""
    picked = train.orderBy(F.xxhash64("part", "record_id")).limit(PIVOTS).select("vec").toArrow()
    pivots = _units(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((1, dim))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.argmax(_units(batch.column(2), dim) @ pivots.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["part", "record_id", "vec", "cell"])

    kind = train.schema["record_id"].dataType.simpleString()
    named = train.mapInArrow(cells, f"part long, record_id {kind}, vec array<double>, cell int")
    n = train.sparkSession.sparkContext.defaultParallelism
    return materialize(named.repartitionByRange(max(n, 2 * PIVOTS), "part", "cell", "record_id").sortWithinPartitions("part", "cell"), "train_vectors")


def _compared(train: DataFrame, asked: pa.Table, dim: int, limit: float) -> DataFrame:
    ids = asked.column(1).combine_chunks()
    parts = asked.column(0).to_numpy()
    vectors = _units(asked.column(2).combine_chunks(), dim) if asked.num_rows else np.empty((0, dim))
    shared = train.sparkSession.sparkContext.broadcast((ids, parts, vectors))
    kind = train.schema["record_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, vectors = shared.value
        best = [(-2.0, None)] * len(ids)
        top, close = np.full(len(ids), -2.0), np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                own = piece.column(0).to_numpy()
                for part in np.unique(own):
                    here = np.flatnonzero(own == part)
                    _block(piece.column(1).take(pa.array(here)).to_pylist(), _units(piece.column(2).take(pa.array(here)), dim), np.flatnonzero(parts == part), vectors, best, top, close, limit)
        met = np.flatnonzero(top > -2.0)
        if len(met):
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[met]), ids.take(pa.array(met)), pa.array([best[i][1] for i in met], ids.type), pa.array([best[i][0] for i in met], pa.float64()), pa.array(close[met])],
                names=["part", "record_id", "near_id", "cosine", "n_close"],
            )

    return train.select("part", "record_id", "vec").mapInArrow(compare, FOUND.format(id=kind))


def _block(ids: list, block: np.ndarray, asked: np.ndarray, vectors: np.ndarray, best: list, top: np.ndarray, close: np.ndarray, limit: float) -> None:
    """Compares the ``asked`` test vectors that the block could serve with all of its vectors."""
    middle = block.sum(axis=0)
    middle /= max(np.sqrt((middle * middle).sum()), 1e-300)
    radius = np.arccos(np.clip((block @ middle).min(), -1.0, 1.0))
    highest = np.cos(np.maximum(np.arccos(np.clip(vectors[asked] @ middle, -1.0, 1.0)) - radius, 0.0)) + 1e-7
    asked = asked[(highest > limit) | (highest >= top[asked])]
    for at in range(0, len(asked), ASKED):
        some = asked[at : at + ASKED]
        cosines = vectors[some] @ block.T
        close[some] += np.count_nonzero(cosines > limit, axis=1)
        most = cosines.max(axis=1)
        for row in np.flatnonzero(most >= top[some] - ROUNDING):
            i = some[row]
            near = np.flatnonzero(cosines[row] >= most[row] - ROUNDING)
            exact = (block[near] * vectors[i]).sum(axis=1)
            value = float(exact.max())
            own = min(ids[k] for k, e in zip(near, exact) if e == value)
            if value > best[i][0] or (value == best[i][0] and own < best[i][1]):
                best[i] = (value, own)
                top[i] = value


def danger_quadrant(frame: DataFrame, cosine_limit: float, set_limit: float, by: tuple[str, ...] = BY, vec_col: str = "vector") -> DataFrame:
    """Per test record: the nearest train record by vector, its cosine and set similarity, and whether it is in the danger quadrant.

    That is a cosine above ``cosine_limit`` with a set similarity below ``set_limit``: close to a model that
    reads vectors, though the split by features let it pass. One pair per test record; severity HIGH if in the quadrant.
    Records without usable vector, or without a train vector to compare with, are SKIPPED.
    """
    near = materialize(nearest_vectors(frame, cosine_limit, by, vec_col), "near")
    train = frame.filter("split = 'train'").select(*by, F.col("record_id").alias("near_id"), F.col("features").alias("_near_features"))
    test = frame.filter("split = 'test'").select(*by, "record_id", "features")
    pairs = test.join(near, [*by, "record_id"], "left").join(train, [*by, "near_id"], "left")
    similarity = F.when(F.col("near_id").isNotNull(), F.coalesce(set_similarity("features", "_near_features"), F.lit(0.0)))
    danger = (F.col("cosine") > cosine_limit) & (F.col("set_similarity") < set_limit)
    return pairs.withColumn("set_similarity", similarity).select(
        *by, "record_id", "near_id", "cosine", "set_similarity", F.coalesce("n_close", F.lit(0)).cast("long").alias("n_close"),
        F.when(F.col("cosine").isNull(), "SKIPPED").when(danger, "HIGH").otherwise("PASS").alias("severity"),
    )


def confidence_inflation(near: DataFrame, predictions: DataFrame, by: tuple[str, ...] = BY) -> tuple[DataFrame, DataFrame]:
    """How the confidence of given predictions goes with the distance to train, 1 - cosine.

    Returns (per data set: n, quartiles of the distance, Pearson r and slope of confidence against 1 / distance;
    per data set and quartile: n, mean distance and confidence). A record exactly at the limit of a
    quartile belongs to the lower one. A distance below 1e-9, as of a copy, has no inverse and is left out of r and slope.
    ``predictions`` has record_id and confidence per data set; records without one do not count.
    """
    rows = near.filter("cosine IS NOT NULL").join(predictions.filter("confidence IS NOT NULL").select(*by, "record_id", "confidence"), [*by, "record_id"])
    rows = materialize(rows.select(*by, (1 - F.col("cosine")).alias("value"), F.col("confidence").cast("double").alias("confidence")), "distances")
    cuts = exact_percentiles(rows, list(by), QUARTILES)
    inverse = F.when(F.col("value") >= 1e-9, 1 / F.col("value"))
    fits = rows.withColumn("inverse", inverse).groupBy(*by).agg(F.corr("inverse", "confidence").alias("correlation"), F.regr_slope("confidence", "inverse").alias("slope"))
    quartile = F.lit(1) + sum((F.col("value") > F.col(q)).cast("int") for q in QUARTILES)
    groups = attach(rows, pinned(cuts.drop("n")), by).groupBy(*by, quartile.alias("quartile")).agg(
        F.count("*").alias("n_rows"), F.avg("value").alias("mean_distance"), F.avg("confidence").alias("mean_confidence")
    )
    return cuts.join(fits, list(by)), groups


def near_far_score(quadrant: DataFrame, predictions: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Share of right predictions in the danger quadrant and outside: one row per data set and group that has records."""
    rows = quadrant.filter("severity <> 'SKIPPED'").join(predictions.select(*by, "record_id", "label", "prediction"), [*by, "record_id"]).filter("label IS NOT NULL AND prediction IS NOT NULL")
    right = F.count_if(F.col("label") == F.col("prediction"))
    return rows.groupBy(*by, F.when(F.col("severity") == "HIGH", "near").otherwise("far").alias("side")).agg(
        F.count("*").alias("n_rows"), safe_ratio(right, F.count("*")).alias("right"), F.avg("cosine").alias("mean_cosine")
    )
