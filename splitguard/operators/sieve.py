"""Leaves out features that a table surely does not hold, before they are sent to be looked up in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.storage import let_workers_import

BITS_PER_FEATURE = 16
LEAST_BITS, MOST_BITS = 16, 28
LEAST_CROSSED = 1_000_000


def sieved(sets: DataFrame, table: DataFrame, weight: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``sets`` (with ``n`` and ``feats``, hashes) without features that ``table`` (``feature``, and in ``weight`` the sets that hold it) does not have.

    A bitmap of the table's features is broadcast, of at most 2**``most_bits`` bits (32 MB) however many there are. A few features
    that the table does not have may pass, none that it has is lost; sets left without features are dropped. Where
    the table holds most of the features the sets are returned as they are.
    """
    spark = sets.sparkSession
    found = table.agg(F.count("*").alias("k"), F.sum(weight).alias("w")).first()
    if 2 * (found["w"] or 0) >= (sets.agg(F.sum("n").alias("n")).first()["n"] or 0):
        return sets
    let_workers_import(spark)
    bits = min(most_bits, max(LEAST_BITS, int(found["k"] * BITS_PER_FEATURE).bit_length()))
    place = F.col("feature").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast((feature & {(1 << bits) - 1}L) & 63 AS int))")
    words = table.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return _kept(sets, bitmap, bits)


def crossed(sets: DataFrame, most_bits: int = MOST_BITS, least: int = LEAST_CROSSED) -> DataFrame:
    """``sets`` (with ``n``, ``feats`` and ``in_train``) without most features that only one of train and test has; sets left without any are dropped.

    Counting features to find the shared ones sends all of them. Here the tasks mark what test holds in a bitmap of at most
    2**``most_bits`` bits, of which some two bytes a feature are sent; what is left of train is marked in the same way for test. No
    feature is lost that both sides have. Fewer than ``least`` features are not worth it.
    """
    found = sets.agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("in_train"), F.col("n"))).alias("test")).first()
    if (found["n"] or 0) < least:
        return sets
    let_workers_import(sets.sparkSession)
    bits = min(most_bits, max(LEAST_BITS, int((found["test"] or 0) * BITS_PER_FEATURE).bit_length()))
    train, test = sets.filter("in_train"), sets.filter(~F.col("in_train"))
    train = _kept(train, _marked(test, bits), bits)
    return train.unionByName(_kept(test, _marked(train, bits), bits))


def crossed_sides(sets: DataFrame, most_bits: int = MOST_BITS, least: int = LEAST_CROSSED) -> DataFrame:
    """The same for ``sides`` in the place of ``in_train``: 1 for a set of test, 2 for one of train; a set of both (3) is left whole, one of neither dropped."""
    found = sets.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sides").bitwiseAND(1) > 0, F.col("n"))).alias("test")).first()
    if (found["n"] or 0) < least:
        return sets
    let_workers_import(sets.sparkSession)
    bits = min(most_bits, max(LEAST_BITS, int((found["test"] or 0) * BITS_PER_FEATURE).bit_length()))
    both = sets.filter("sides = 3")
    train = _kept(sets.filter("sides = 2"), _marked(sets.filter("sides IN (1, 3)"), bits), bits)
    return train.unionByName(_kept(sets.filter("sides = 1"), _marked(train.unionByName(both), bits), bits)).unionByName(both)


def _marked(sets: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the features of ``sets``. A task marks its own and sends pieces of 65,536 bits, those with few marks as their places."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << (bits - 16), 1024), dtype=np.uint64)
        words = own.reshape(-1)
        for batch in batches:
            at = np.unique(batch.column("feats").flatten().to_numpy() & ((1 << bits) - 1))
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                words[word] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        for k in np.flatnonzero(own.any(axis=1)).tolist():
            places = np.flatnonzero(np.unpackbits(own[k].view(np.uint8), bitorder="little"))
            data = places.astype(np.uint16).tobytes() if len(places) < 4096 else own[k].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["piece", "data"])

    def merge(pieces: pa.Table) -> pa.Table:
        return pa.table({"piece": pieces.column("piece").slice(0, 1), "data": pa.array([_union(pieces.column("data")).tobytes()], pa.binary())})

    sent = sets.select("feats").mapInArrow(mark, "piece int, data binary")
    table = sent.groupBy("piece").applyInArrow(merge, "piece int, data binary").toArrow()
    bitmap = np.zeros((1 << (bits - 16), 1024), dtype=np.int64)
    for piece, data in zip(table.column("piece").to_pylist(), table.column("data").to_pylist()):
        bitmap[piece] = np.frombuffer(data, np.int64)
    return bitmap.reshape(-1)


def _union(pieces: pa.ChunkedArray) -> np.ndarray:
    out = np.zeros(65_536, dtype=bool)
    for data in pieces.to_pylist():
        if len(data) == 8192:
            out |= np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
        else:
            out[np.frombuffer(data, np.uint16)] = True
    return np.packbits(out, bitorder="little")


def _kept(sets: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    held = sets.sparkSession.sparkContext.broadcast(bitmap)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = batch.column("feats")
            values = feats.flatten().to_numpy()
            at = values & ((1 << bits) - 1)
            passed = (held.value[at >> 6] >> (at & 63)) & 1 == 1
            offsets = feats.offsets.to_numpy()
            ends = np.append(0, np.cumsum(passed))[offsets - offsets[0]]
            some = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[passed]))
            place = batch.schema.get_field_index("feats")
            full = pa.RecordBatch.from_arrays([some if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
            yield full.filter(pa.array(np.diff(ends) > 0))

    return sets.mapInArrow(kept, sets.schema)
