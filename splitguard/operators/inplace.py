"""Nearest train set of every test set where most features are frequent, without sending a set anywhere.

Tokens are few and shared by most sets. Meeting them in joins sends a row per shared feature, or a set once per cell
it has to meet. Here the table of shared features is broadcast (it must be small, see ``fits``), and the tasks that read
the sets write them as blocks: features are the numbers of their rank by cost, so a set is its cheapest features first. Every
block of test sets then meets every block of train sets of its data set as one row each, read where they were written; only
the best train set of each test set leaves the task. What is written grows with the sets, what is read and counted with
test x train sets.

Rare features (runs of words) are too many to broadcast, but hardly any are shared. They keep their hashes and are all counted: their
lists are short, and what only one side has is left out before (``sieve``). That is done while all pairs together share at
most MOST_HITS features, which is known from the vocabulary.

In a pair of blocks a few train sets give a first bound. A train set that reaches the bound of a test set shares one of
its cheapest features (prefix rule); these are counted for all train sets of the block at once, and those that
could still reach the bound with all other features shared are counted exactly. Bounds rise from block to block.
Where a test set would go through many entries of common features, all its features are counted at once instead: those
that many sets of the block hold by a product of two matrices of zeros and ones, the others by their lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.operators.blocks import _flat, _ranges
from splitguard.storage import let_workers_import, materialize

MOST_FEATURES = 2_000_000
MOST_PARTS = 64
MOST_HITS, MOST_PAIRS = 3e10, 1e12
CELL_FEATURES, CHUNK_FEATURES = 2_000_000, 1_000_000
MOST_SETS = 50_000
COUNTERS = 4_000_000
FIRST_SETS = 256
# A common feature costs a product of matrices as much for ENTRY_COST pairs as an entry of its list; TABLE bounds the matrix (64 MB).
COMMON_SHARE, ENTRY_COST, TABLE = 0.03, 2000, 16_000_000


def fits(sets: DataFrame, vocabulary: DataFrame) -> bool:
    """Whether the shared features can be broadcast, hold most of what the sets hold, and the data sets are few."""
    found = vocabulary.agg(F.count("*").alias("k"), F.sum("_weight").alias("w")).first()
    held = sets.agg(F.sum("n").alias("n"), F.approx_count_distinct("part", 0.02).alias("parts")).first()
    return found["k"] <= MOST_FEATURES and 2 * (found["w"] or 0) >= (held["n"] or 0) and held["parts"] <= MOST_PARTS


def countable(sets: DataFrame, vocabulary: DataFrame) -> bool:
    """Whether all pairs share no more than MOST_HITS features together, though perhaps more different ones than can be broadcast."""
    hits = vocabulary.agg(F.sum("cost").alias("hits")).first()["hits"] or 0
    sides = sets.groupBy("part").agg(F.count("train_id").alias("train"), F.count_if(F.col("train_id").isNull()).alias("test"))
    found = sides.agg(F.count("*").alias("parts"), F.sum(F.col("train").cast("double") * F.col("test")).alias("pairs")).first()
    return hits <= MOST_HITS and found["parts"] <= MOST_PARTS and (found["pairs"] or 0) <= MOST_PAIRS


def best_in_place(held: DataFrame, vocabulary: DataFrame | None, cell_features: int = CELL_FEATURES, chunk_features: int = CHUNK_FEATURES) -> DataFrame:
    """(part, test_id, train_id, shared, either): for each test set and block of train sets the best one, if it reaches what the task found before.

    ``held`` has part, id, in_train, n (size of the set) and feats (hashes), ``vocabulary`` feature and cost of the features
    that both sides have; without it features stay hashes and all are counted. Of equally similar sets of a block the smallest id is returned.
    """
    let_workers_import(held.sparkSession)
    ranked = vocabulary is not None
    known = held.sparkSession.sparkContext.broadcast(_ranks(vocabulary) if ranked else None)
    kind = held.schema["id"].dataType.simpleString()
    named = held.filter("id IS NOT NULL")

    def blocks(side: DataFrame, name: str, size: int, indexed: bool) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _pack(batches, known.value, size, indexed)

        rows = side.select("part", "id", "n", "feats")
        return materialize(rows.mapInArrow(pack, f"part long, block long, ids array<{kind}>, n binary, sizes binary, features binary, seen binary, lists binary, rows binary"), name)

    cells = blocks(named.filter("in_train"), "cells", cell_features, True)
    chunks = blocks(named.filter(~F.col("in_train")), "chunks", chunk_features, False)
    cells = cells.select("part", *[F.col(c).alias(f"cell_{c}") for c in ("ids", "n", "sizes", "features", "seen", "lists", "rows")])
    chunks = chunks.select(F.col("part").alias("_part"), "block", "ids", "n", "sizes", "features")
    # Not a join by key: that would send every block to the one task of its data set.
    met = cells.join(chunks, F.col("part").bitwiseXOR(F.col("_part")) == 0).drop("_part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, ranked)

    return met.mapInArrow(compare, f"part long, test_id {kind}, train_id {kind}, shared int, either int")


def _ranks(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features in order, and the rank of each by cost."""
    table = vocabulary.select("feature", "cost").toArrow()
    features, cost = (table.column(c).to_numpy() for c in ("feature", "cost"))
    rank = np.empty(len(features), dtype=np.int32)
    rank[np.lexsort((features, cost))] = np.arange(len(features), dtype=np.int32)
    order = np.argsort(features)
    return features[order], rank[order]


def _ranked(values: np.ndarray, sizes: np.ndarray, features: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known features of each set as ranks in order, and how many there are."""
    if not len(features):
        return np.empty(0, dtype=np.int32), np.zeros(len(sizes), dtype=np.int64)
    at = np.minimum(np.searchsorted(features, values), len(features) - 1)
    hit = features[at] == values
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[hit]
    ranks = (np.sort(owner << 32 | rank[at[hit]]) & 0xFFFFFFFF).astype(np.int32)
    return ranks, np.bincount(owner, minlength=len(sizes))


def _pack(batches: Iterator[pa.RecordBatch], known: tuple | None, size: int, indexed: bool) -> Iterator[pa.RecordBatch]:
    """Sets as blocks of about ``size`` features of one data set, or MOST_SETS sets; those without shared features are left out."""
    waiting: dict[int, list[tuple]] = {}
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ranks, sizes = _flat(batch.column("feats"))
        if known is not None:
            ranks, sizes = _ranked(ranks, sizes, *known)
        starts = np.append(0, np.cumsum(sizes))
        parts, n = batch.column("part").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
        for part in np.unique(parts).tolist():
            some = np.flatnonzero((parts == part) & (sizes > 0))
            if not len(some):
                continue
            pieces = waiting.setdefault(part, [])
            pieces.append((batch.column("id").take(pa.array(some)), n[some], sizes[some], ranks[_ranges(starts, some)]))
            if sum(len(p[3]) for p in pieces) >= size or sum(len(p[1]) for p in pieces) >= MOST_SETS:
                yield _block(part, count, waiting.pop(part), indexed)
                count += 1
    for part, pieces in waiting.items():
        yield _block(part, count, pieces, indexed)
        count += 1


def _block(part: int, count: int, pieces: list[tuple], indexed: bool) -> pa.RecordBatch:
    ids = pa.concat_arrays([p[0] for p in pieces])
    n, sizes, features = (np.concatenate([p[k] for p in pieces]) for k in (1, 2, 3))
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    features = features[_ranges(np.append(0, np.cumsum(sizes)), order)]
    ids, n, sizes = ids.take(pa.array(order)), n[order], sizes[order].astype(np.int32)
    index = _index(features, sizes) if indexed else (None, None, None)
    raw = lambda a: pa.array([None if a is None else a.tobytes()], pa.binary())
    block = (TaskContext.get().partitionId() << 32) + count
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), raw(n), raw(sizes), raw(features), *map(raw, index)],
        names=["part", "block", "ids", "n", "sizes", "features", "seen", "lists", "rows"],
    )


def _index(features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that occur, how many sets hold each, and these sets one list after the other."""
    order = np.argsort(features, kind="stable")
    seen, lists = np.unique(features, return_counts=True)
    return seen, lists.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]


class _Sets:
    """The sets of a block in order of their ids, their features cheapest first."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, features: np.ndarray):
        self.ids, self.n, self.sizes, self.features = ids, n.astype(np.int64), sizes.astype(np.int64), features
        self.starts = np.append(0, np.cumsum(self.sizes))


def _compare(batches: Iterator[pa.RecordBatch], ranked: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"features": np.int32 if ranked else np.int64, "seen": np.int32 if ranked else np.int64}
    bounds: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column("part")[i].as_py()

            def sets(side: str) -> _Sets:
                n, sizes, features = (np.frombuffer(batch.column(side + c)[i].as_buffer(), kinds.get(c, np.int32)) for c in ("n", "sizes", "features"))
                return _Sets(batch.column(side + "ids")[i].values, n, sizes, features)

            train, test = sets("cell_"), sets("")
            index = tuple(np.frombuffer(batch.column(f"cell_{c}")[i].as_buffer(), kinds.get(c, np.int32)) for c in ("seen", "lists", "rows"))
            key = part, batch.column("block")[i].as_py()
            if key not in bounds:
                bounds[key] = np.zeros(len(test.n))
                if ranked and len(train.n) > 4 * FIRST_SETS:
                    some = np.linspace(0, len(train.n) - 1, FIRST_SETS).astype(np.int64)
                    few = _Sets(train.ids.take(pa.array(some)), train.n[some], train.sizes[some], train.features[_ranges(train.starts, some)])
                    yield from _best(part, test, few, _index(few.features, few.sizes), bounds[key], ranked)
            yield from _best(part, test, train, index, bounds[key], ranked)


def _best(part: int, test: _Sets, train: _Sets, index: tuple, bounds: np.ndarray, ranked: bool) -> Iterator[pa.RecordBatch]:
    """The best train set per test set, if it reaches the bound, which is raised to it."""
    seen, lists, rows = index
    heads = np.append(0, np.cumsum(lists, dtype=np.int64))
    flags = np.zeros(int(max(seen[-1], test.features.max())) + 1 if ranked else 0, dtype=np.uint8)
    width = len(train.n)
    common = _common(lists, width)
    table = _table(common, heads, rows, width)
    number = np.full(len(seen), -1, dtype=np.int32)
    number[common] = np.arange(len(common), dtype=np.int32)
    step = max(1, COUNTERS // width)
    for at in range(0, len(test.n), step):
        some = np.arange(at, min(at + step, len(test.n)))
        n, bound = test.n[some], bounds[some]
        # Who reaches the bound shares at least ``least`` features, so one that is not among the last least - 1.
        least = np.maximum(np.ceil(n * bound - 1e-6), 1).astype(np.int64)
        ahead = np.clip(test.sizes[some] - least + 1, 0, test.sizes[some]) if ranked else test.sizes[some]
        found = _Found(test, some, ahead, seen, lists, number)
        listed, rare = found.entries(found.ahead), found.entries(~found.common)
        product = listed > rare + len(common) * width / ENTRY_COST
        for whole, which in ((True, np.flatnonzero(product)), (False, np.flatnonzero(~product))):
            if not len(which):
                continue
            if whole:
                shared = _products(found, which, table, heads, rows, width)
                rest = np.zeros(len(which), dtype=np.int64)
            else:
                shared = _counts(found, which, found.ahead, heads, rows, width)
                rest = (test.sizes[some] - ahead)[which]
            place, other = _reaching(shared, rest, n[which], train.n, bound[which])
            count = shared[place, other].astype(np.int64)
            ends = np.searchsorted(place, np.arange(len(which) + 1))
            for k in np.flatnonzero((rest > 0) & (ends[1:] > ends[:-1])).tolist():
                count[ends[k] : ends[k + 1]] = _exact(test, int(some[which[k]]), train, other[ends[k] : ends[k + 1]], flags)
            place = which[place]
            either = n[place] + train.n[other] - count
            alike = count / either
            # The best of each test set; of equals the first, which has the smallest id.
            order = np.lexsort((other, -alike, place))
            first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
            first = first[alike[first] >= bound[place[first]]]
            if len(first):
                bounds[some[place[first]]] = alike[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), part)), test.ids.take(pa.array(some[place[first]])), train.ids.take(pa.array(other[first])),
                        pa.array(count[first], pa.int32()), pa.array(either[first], pa.int32()),
                    ],
                    names=["part", "test_id", "train_id", "shared", "either"],
                )


def _common(lists: np.ndarray, width: int) -> np.ndarray:
    """The features that so many sets of the block hold that a product of matrices counts them sooner than their lists, within TABLE entries."""
    often = np.flatnonzero(lists > width * COMMON_SHARE)
    most = max(1, TABLE // width)
    return often if len(often) <= most else np.sort(often[np.argsort(-lists[often], kind="stable")[:most]])


def _table(common: np.ndarray, heads: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """1 where a set (column) holds a common feature (row)."""
    table = np.zeros((len(common), width), dtype=np.float32)
    table[np.repeat(np.arange(len(common)), heads[common + 1] - heads[common]), rows[_ranges(heads, common)]] = 1
    return table


class _Found:
    """The features of some test sets that the block holds: of which set, where in the index, whether ahead and whether common."""

    def __init__(self, test: _Sets, some: np.ndarray, ahead: np.ndarray, seen: np.ndarray, lists: np.ndarray, number: np.ndarray):
        sizes = test.sizes[some]
        values = test.features[_ranges(test.starts, some)]
        at = np.minimum(np.searchsorted(seen, values), len(seen) - 1)
        hit = seen[at] == values
        owner = np.repeat(np.arange(len(some), dtype=np.int64), sizes)
        first = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(ahead, sizes)
        self.owner, self.at, self.ahead = owner[hit], at[hit], first[hit]
        self.number, self.sets = number[self.at], len(some)
        self.common, self.lists = self.number >= 0, lists

    def entries(self, which: np.ndarray) -> np.ndarray:
        """How many entries the lists of these features hold, for each test set."""
        return np.bincount(self.owner, np.where(which, self.lists[self.at], 0), minlength=self.sets)


def _products(found: _Found, which: np.ndarray, table: np.ndarray, heads: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """How many features each of these test sets shares with each train set: common ones by a product of matrices, the others by their lists.

    Sums of ones are exact in single precision up to 2**24, and a table has fewer rows.
    """
    out = _counts(found, which, ~found.common, heads, rows, width)
    place = np.full(found.sets, -1, dtype=np.int64)
    place[which] = np.arange(len(which))
    mine = np.flatnonzero(found.common & (place[found.owner] >= 0))
    asked = np.zeros((len(which), len(table)), dtype=np.float32)
    asked[place[found.owner[mine]], found.number[mine]] = 1
    out += asked @ table
    return out


def _reaching(shared: np.ndarray, rest: np.ndarray, n: np.ndarray, sizes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test set, train set) of the pairs that share a feature and could reach the bound, in order.

    All pairs are sieved in single precision with an allowance above its rounding, what is left in double.
    """
    share = bound / (1 + bound)
    allowance = 1e-5 * (n + rest + int(sizes.max(initial=0)) + 1)
    short = np.multiply.outer(share.astype(np.float32), sizes.astype(np.float32))
    np.subtract(shared, short, out=short)
    place, other = np.nonzero(short >= (share * n - rest - allowance).astype(np.float32)[:, None])
    count = shared[place, other]
    good = (count > 0) & (count.astype(np.float64) + rest[place] >= share[place] * (n[place] + sizes[other]) - 1e-6)
    return place[good], other[good]


def _counts(found: _Found, which: np.ndarray, some: np.ndarray, heads: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """How many of the found features marked in ``some`` each of the test sets ``which`` (row) shares with each train set (column)."""
    place = np.full(found.sets, -1, dtype=np.int64)
    place[which] = np.arange(len(which))
    mine = np.flatnonzero(some & (place[found.owner] >= 0))
    at, places = found.at[mine], place[found.owner[mine]] * width
    count = heads[at + 1] - heads[at]
    out = np.zeros(len(which) * width, dtype=np.float32)
    ends = np.cumsum(count)
    # Lists are laid out a bounded number of entries at a time, whole test sets' counters at once only.
    start = 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COUNTERS, "right")))
        low, high = int(places[start]), int(places[stop - 1]) + width
        some_rows = rows[_ranges(heads, at[start:stop])]
        out[low:high] += np.bincount(np.repeat(places[start:stop] - low, count[start:stop]) + some_rows, minlength=high - low).astype(np.float32)
        start = stop
    return out.reshape(len(which), width)


def _exact(test: _Sets, k: int, train: _Sets, others: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Features that test set ``k`` shares with each of ``others``."""
    mine = test.features[test.starts[k] : test.starts[k + 1]]
    flags[mine] = 1
    out = np.empty(len(others), dtype=np.int64)
    # A bounded number of features is laid out at a time.
    sent = np.cumsum(train.sizes[others])
    at = 0
    while at < len(others):
        stop = max(at + 1, int(np.searchsorted(sent, (sent[at - 1] if at else 0) + COUNTERS, "right")))
        some = others[at:stop]
        laid = np.append(0, np.cumsum(flags[train.features[_ranges(train.starts, some)]], dtype=np.int64))
        ends = np.append(0, np.cumsum(train.sizes[some]))
        out[at:stop] = laid[ends[1:]] - laid[ends[:-1]]
        at = stop
    flags[mine] = 0
    return out
