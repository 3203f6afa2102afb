"""Nearest train set of those test sets whose features are mostly frequent, block against block.

Where the similarity to beat is low, a test set has to look through lists of frequent features that
together hold most train sets, some of them many times. Meeting them in a join would make one row per
shared feature and pair. Here a task holds a cell of train sets of about one size, indexed by feature, and
test sets stream past it. Shared features are counted in numpy; one row per test set and cell leaves the
task, if it reaches the bound at all. Cells whose sizes cannot reach the bound are not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.storage import attach, let_workers_import, pinned

CELL_FEATURES = 8_000_000
CHUNK_SHARE = 4
LEAST_CELL, CELLS = 250_000, 12
PAIR_FEATURES = 4_000_000
PAIR_CELLS, PAIR_CHUNKS = 8, 3
COUNTERS = 4_000_000
SIZE_STEP = 1.25
KEY = ("part", "sizes", "cell", "chunk")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP)) + F.lit(1e-9)).cast("int")


def best_in_blocks(test: DataFrame, train: DataFrame, bounds: DataFrame, cell_features: int = CELL_FEATURES) -> DataFrame:
    """(part, test_id, train_id, shared, either): per test set of ``bounds`` and train cell the best train set, if it reaches the bound.

    ``test`` and ``train`` hold part, id, n (size of the set) and features (those both sides have), ``bounds``
    part, test_id, shared and either of a train set that was compared already. Of equally similar sets of a
    cell the smallest id is returned. Neighbouring classes of sizes lie in one range while they hold at most
    ``cell_features`` train features together, and a larger class is cut into cells of about that many. A test set
    is sent once to each cell of a range that it can reach, not once per class. Test sets stream past a cell, so
    only the train features bound its memory; they are cut into chunks of CHUNK_SHARE times ``cell_features``, and
    each cell meets each chunk of its range.
    """
    let_workers_import(test.sparkSession)
    hashes = F.transform("features", lambda f: f["feature"])
    held = train.select("part", "id", "n", hashes.alias("features"), F.lit(None).cast("double").alias("bound"), _size_class(F.col("n")).alias("size_class"))
    ranges = pinned(_ranges_of_sizes(held, cell_features))
    reached = ranges.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("sizes", "low", "high"))).alias("ranges"))
    asked = (
        test.select("part", F.col("id").alias("test_id"), "n", hashes.alias("features"))
        .join(bounds.select("part", "test_id", (F.col("shared") / F.col("either")).alias("bound")), ["part", "test_id"])
        .withColumn("least", _size_class(F.ceil(F.col("n") * F.col("bound") - 1e-9)))
        .withColumn("most", _size_class(F.floor(F.col("n") / F.col("bound") + 1e-9)))
    )
    asked = attach(asked, pinned(reached), ("part",)).select(
        "part", F.col("test_id").alias("id"), "n", "features", "bound",
        F.explode(F.expr("transform(filter(ranges, r -> r.low <= most AND r.high >= least), r -> r.sizes)")).alias("sizes"),
    )
    classes = ranges.select("part", F.explode(F.sequence("low", "high")).alias("size_class"), "sizes")
    held = attach(held, pinned(classes), ("part", "size_class"))

    chunks = asked.groupBy("part", "sizes").agg(F.ceil(F.sum(F.size("features")) / (cell_features * CHUNK_SHARE)).cast("int").alias("chunks"))
    places = pinned(ranges.select("part", "sizes", "cells").join(chunks, ["part", "sizes"]))

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        placed = attach(rows, places, ("part", "sizes")).filter("cells IS NOT NULL")
        own, other = ("cells", "chunks") if side == 0 else ("chunks", "cells")
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        place = {"cell": mine, "chunk": each} if side == 0 else {"cell": each, "chunk": mine}
        return placed.select(
            "part", "sizes", *[c.alias(k) for k, c in place.items()], F.lit(side).alias("side"), "id", "n", "features", "bound"
        )

    # Few cells in few partitions would often share one.
    n = 2 * int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt(held, 0).unionByName(dealt(asked, 1)).repartition(n, *KEY).sortWithinPartitions(*KEY, "side", "id")
    kind = test.schema["id"].dataType.simpleString()
    return met.mapInArrow(_compare, f"part long, test_id {kind}, train_id {kind}, shared int, either int")


def _ranges_of_sizes(held: DataFrame, cell_features: int) -> DataFrame:
    """(part, sizes, low, high, cells): neighbouring classes of sizes as one range of about ``cell_features`` features, or a large class cut into cells."""
    classes = held.groupBy("part", "size_class").agg(F.sum(F.size("features")).alias("held"))
    # Where a data set has work for several tasks it has at least some CELLS cells.
    wanted = F.greatest(F.floor(F.sum("held").over(Window.partitionBy("part")) / CELLS), F.lit(LEAST_CELL))
    classes = classes.withColumn("wanted", F.least(wanted, F.lit(cell_features)))
    # One row per class of sizes of a data set: some dozens each.
    upto = F.sum("held").over(Window.partitionBy("part").orderBy("size_class"))
    numbered = classes.withColumn("sizes", F.floor((upto - F.col("held")) / F.col("wanted")).cast("int"))
    return numbered.groupBy("part", "sizes").agg(
        F.min("size_class").alias("low"), F.max("size_class").alias("high"), F.ceil(F.greatest(F.sum("held"), F.lit(1)) / F.first("wanted")).cast("int").alias("cells")
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, waiting, cell = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in (*KEY, "side")]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts[:-1], starts[1:]):
            piece, own = batch.slice(start, stop - start), tuple(c[start] for c in columns[:-1])
            if own != key:
                key, waiting, cell = own, [], None
            if columns[-1][start] == 0:
                waiting.append(piece)
            elif waiting or cell:
                cell = cell or _Cell(pa.Table.from_batches(waiting))
                waiting = []
                yield from cell.best(piece)


def _flat(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of an array of sets, and how many each set has."""
    return features.flatten().to_numpy(), np.diff(features.offsets.to_numpy())


class _Cell:
    """Train sets in order of their ids, found by feature."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("id").combine_chunks()
        self.n = rows.column("n").to_numpy().astype(np.int64)
        found, sizes = _flat(rows.column("features").combine_chunks())
        order = np.argsort(found, kind="stable")
        self.features = found[order]
        self.rows = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes)[order]

    def best(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Per test set that some train set of the cell serves: the best one."""
        step = max(1, COUNTERS // len(self.ids))
        for at in range(0, asked.num_rows, step):
            some = asked.slice(at, step)
            shared = self._shared(some.column("features"))
            either = some.column("n").to_numpy().astype(np.int64)[:, None] + self.n[None, :] - shared
            alike = shared / either
            # The first of the highest is the one with the smallest id.
            top = alike.argmax(axis=1)
            every = np.arange(len(top))
            good = np.flatnonzero((alike[every, top] >= some.column("bound").to_numpy()) & (shared[every, top] > 0))
            if len(good):
                top = top[good]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(good)), some.column("id").take(pa.array(good)), self.ids.take(pa.array(top)),
                        pa.array(shared[good, top], pa.int32()), pa.array(either[good, top], pa.int32()),
                    ],
                    names=["part", "test_id", "train_id", "shared", "either"],
                )

    def _shared(self, features: pa.Array) -> np.ndarray:
        """Features shared by each test set (row) and each train set of the cell (column)."""
        found, sizes = _flat(features)
        width = len(self.ids)
        out = np.zeros(len(sizes) * width, dtype=np.int64)
        first = np.searchsorted(self.features, found, "left")
        count = np.searchsorted(self.features, found, "right") - first
        places = np.repeat(np.arange(len(sizes)) * width, sizes)
        # Lists are laid out a bounded number of entries at a time; one list is no longer than the cell has sets.
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTERS, "right")))
            k = count[at:stop]
            entry = np.repeat(first[at:stop] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            out += np.bincount(np.repeat(places[at:stop], k) + self.rows[entry], minlength=len(out))
            at = stop
        return out.reshape(len(sizes), width)


def shared_sizes(pairs: DataFrame, test: DataFrame, train: DataFrame, cell_features: int = PAIR_FEATURES) -> DataFrame:
    """(part, test_id, train_id, shared, either): exact sizes of the intersection and union of each pair of sets.

    No set travels with a pair. Train sets are dealt over cells and test sets over chunks of about
    ``cell_features`` features, PAIR_CELLS and PAIR_CHUNKS of them at least; a set is sent once to each
    chunk or cell that holds a partner, so what is sent is bounded by the sets and not by the pairs. Where
    ids repeat, each set of an id is compared.
    """
    let_workers_import(test.sparkSession)

    def dealt(rows: DataFrame, name: str, least: int) -> DataFrame:
        return rows.groupBy("part").agg(F.greatest(F.ceil(F.sum(F.size("features")) / cell_features), F.lit(least)).cast("int").alias(name))

    places = pinned(dealt(train, "cells", PAIR_CELLS).join(dealt(test, "chunks", PAIR_CHUNKS), "part"))
    own = lambda record, count: F.pmod(F.xxhash64(F.lit(7), record), F.col(count)).cast("int")
    placed = attach(pairs, places, ("part",)).select("part", "test_id", "train_id", own("train_id", "cells").alias("cell"), own("test_id", "chunks").alias("chunk"))
    hashes = F.array_distinct(F.transform("features", lambda f: f["feature"]))
    columns = ("part", "cell", "chunk", "side", "id", "n", "features", "partners")
    asked = placed.groupBy("part", "cell", "chunk", "test_id").agg(F.collect_list("train_id").alias("partners"))
    asked = asked.join(test.select("part", F.col("id").alias("test_id"), "n", hashes.alias("features")), ["part", "test_id"])
    asked = asked.select("part", "cell", "chunk", F.lit(1).alias("side"), F.col("test_id").alias("id"), "n", "features", "partners")
    held = placed.select("part", "cell", "chunk", "train_id").distinct()
    held = held.join(train.select("part", F.col("id").alias("train_id"), "n", hashes.alias("features")), ["part", "train_id"])
    held = held.select("part", "cell", "chunk", F.lit(0).alias("side"), F.col("train_id").alias("id"), "n", "features", F.lit(None).cast(asked.schema["partners"].dataType).alias("partners"))
    n = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = columns[:3]
    met = held.select(*columns).unionByName(asked.select(*columns)).repartition(n, *keys).sortWithinPartitions(*keys, "side", "id")
    kind = test.schema["id"].dataType.simpleString()
    return met.mapInArrow(_count, f"part long, test_id {kind}, train_id {kind}, shared int, either int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, waiting, sets = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in ("part", "cell", "chunk", "side")]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts[:-1], starts[1:]):
            piece, own = batch.slice(start, stop - start), tuple(c[start] for c in columns[:-1])
            if own != key:
                key, waiting, sets = own, [], None
            if columns[-1][start] == 0:
                waiting.append(piece)
            elif waiting or sets:
                sets = sets or _Sets(pa.Table.from_batches(waiting))
                waiting = []
                yield from sets.shared(piece)


class _Sets:
    """Train sets of a cell in order of their ids, their features as numbers of the cell."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("id").combine_chunks()
        self.n = rows.column("n").to_numpy().astype(np.int64)
        found, sizes = _flat(rows.column("features").combine_chunks())
        self.vocabulary, self.features = np.unique(found, return_inverse=True)
        self.features = self.features.astype(np.int32)
        self.starts = np.append(0, np.cumsum(sizes))
        self.known = pc.unique(self.ids)
        # Rows lie in order of their ids, so those of one id lie side by side.
        self.rows = np.append(0, np.cumsum(np.bincount(pc.index_in(self.ids, self.known).to_numpy(), minlength=len(self.known))))

    def shared(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, sizes = _flat(asked.column("features"))
        place = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == found
        ends = np.append(0, np.cumsum(sizes))
        partners = asked.column("partners")
        wanted = pc.fill_null(pc.index_in(partners.flatten(), self.known), -1).to_numpy()
        stops = np.append(0, np.cumsum(np.diff(partners.offsets.to_numpy())))
        n = asked.column("n").to_numpy().astype(np.int64)
        flags = np.zeros(len(self.vocabulary), dtype=np.int32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for i in range(asked.num_rows):
            mine = place[ends[i] : ends[i + 1]][hit[ends[i] : ends[i + 1]]]
            flags[mine] = 1
            others = wanted[stops[i] : stops[i + 1]]
            others = _ranges(self.rows, others[others >= 0])
            # A bounded number of features is laid out at a time.
            sent = np.cumsum(self.starts[others + 1] - self.starts[others])
            at = 0
            while at < len(others):
                stop = max(at + 1, int(np.searchsorted(sent, (sent[at - 1] if at else 0) + COUNTERS, "right")))
                some = others[at:stop]
                held = np.append(0, np.cumsum(flags[self.features[_ranges(self.starts, some)]]))
                bounds = np.append(0, np.cumsum(self.starts[some + 1] - self.starts[some]))
                out.append((np.full(len(some), i), some, held[bounds[1:]] - held[bounds[:-1]]))
                waiting += len(some)
                at = stop
            flags[mine] = 0
            if waiting > 100_000:
                yield self._rows(asked, n, out)
                out, waiting = [], 0
        if waiting:
            yield self._rows(asked, n, out)

    def _rows(self, asked: pa.RecordBatch, n: np.ndarray, out: list) -> pa.RecordBatch:
        tests, trains, shared = (np.concatenate(c) for c in zip(*out))
        either = n[tests] + self.n[trains] - shared
        return pa.RecordBatch.from_arrays(
            [asked.column("part").take(pa.array(tests)), asked.column("id").take(pa.array(tests)), self.ids.take(pa.array(trains)), pa.array(shared, pa.int32()), pa.array(either, pa.int32())],
            names=["part", "test_id", "train_id", "shared", "either"],
        )


def _ranges(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The positions from ``starts[k]`` up to ``starts[k + 1]`` for each k of ``which``, one after the other."""
    first, count = starts[which], starts[which + 1] - starts[which]
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
