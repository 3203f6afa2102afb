"""Approximate nearest neighbours by counting collisions of single projections in windows around the query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.storage import materialize

PROJECTIONS = 128
WIDTH = 1.0  # half the window, in radii
MISS = 0.005  # share of vectors right at the radius that may stay below the threshold
DIRECTIONS = 20_000  # random directions the threshold is read off
START, STEP = 0.25, 1.5  # first radius where no distance is known, and the factor between rounds
BLOCK = 4096  # vectors whose sorted arrays are held at once
TOGETHER = 256  # queries that count together, so counts take BLOCK * TOGETHER numbers
QUERY_VALUES = 4_000_000  # components of queries that go through the index in one pass
CODE_BITS = 16

FOUND = "query int, query_id {id}, vec_id {id}, score double"


class Projections:
    """``count`` projections of vectors with ``dim`` components, and how many must collide.

    They come in orthogonal groups, scaled so that a difference of length 1 has a mean square of 1 under
    each. Of differences of length R, a share of 1 - MISS has at least ``threshold`` projections of at
    most WIDTH * R.
    """

    def __init__(self, dim: int, count: int = PROJECTIONS, seed: int = 12, miss: float = MISS):
        rng = np.random.default_rng(seed)
        groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(dim, count)] for _ in range(-(-count // dim))]
        self.matrix = np.concatenate(groups, axis=1)[:, :count] * np.sqrt(dim)
        some = rng.standard_normal((DIRECTIONS, dim))
        some /= np.linalg.norm(some, axis=1, keepdims=True)
        collided = np.concatenate([np.count_nonzero(np.abs(part @ self.matrix) <= WIDTH, axis=1) for part in np.array_split(some, 20)])
        self.threshold = max(1, int(np.quantile(collided, miss)))

    def __call__(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (vectors / norms[:, None]) @ self.matrix


class _Block:
    """Vectors with one sorted array per projection: its values, and whose they are."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, projections: Projections):
        self.ids, self.vectors, self.norms = ids.to_pylist(), vectors, _norms(vectors)
        values = projections(vectors, self.norms).T
        self.places = np.argsort(values, axis=1)
        self.values = np.take_along_axis(values, self.places, axis=1)

    def windows(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and projection: the first place in its window and the first behind."""
        a, b = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for j, own in enumerate(self.values):
            a[:, j] = np.searchsorted(own, low[:, j], side="left")
            b[:, j] = np.searchsorted(own, high[:, j], side="right")
        return a, b


class _Queries:
    """A block of queries, the best k found for each so far, and how far off the last of those is."""

    def __init__(self, ids: list, vectors: np.ndarray, projections: Projections, k: int):
        self.ids, self.vectors, self.norms, self.k = ids, vectors, _norms(vectors), k
        self.projections = projections
        self.values = projections(vectors, self.norms)
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.bound = np.full(len(ids), np.inf)
        self.verified = 0

    def search(self, block: _Block) -> None:
        # A window can only hold what lies between the smallest and largest value of its projection.
        reach = np.minimum(self.bound, 2.0)[:, None] * WIDTH
        meets = (self.values + reach >= block.values[:, 0]) & (self.values - reach <= block.values[:, -1])
        open_ = np.flatnonzero(np.count_nonzero(meets, axis=1) >= self.projections.threshold)
        for at in range(0, len(open_), TOGETHER):
            self._rounds(block, open_[at : at + TOGETHER])

    def _rounds(self, block: _Block, queries: np.ndarray) -> None:
        """Widens the windows round by round; what is counted in a narrow one is not counted again in a wider one.

        Ends for a query when the radius has reached the distance of the last of its k best, or the diameter of the sphere.
        """
        n = len(block.ids)
        counts, seen = np.zeros((len(queries), n), np.int32), np.zeros((len(queries), n), bool)
        radius = np.where(np.isinf(self.bound[queries]), START, self.bound[queries] / STEP)
        start = np.empty(self.values[queries].shape, np.int64)
        for j, own in enumerate(block.values):
            start[:, j] = np.searchsorted(own, self.values[queries, j])
        was_low, was_high = start, start.copy()
        active = np.arange(len(queries))
        while len(active):
            reach = radius[active, None] * WIDTH
            own = self.values[queries[active]]
            low, high = block.windows(own - reach, own + reach)
            for i, at in enumerate(active):
                slices = [block.places[j, a:b] for j, (a, b) in enumerate(zip(low[i], was_low[at])) if a < b]
                slices += [block.places[j, a:b] for j, (a, b) in enumerate(zip(was_high[at], high[i])) if a < b]
                if slices:
                    counts[at] += np.bincount(np.concatenate(slices), minlength=n).astype(np.int32)
                found = np.flatnonzero((counts[at] >= self.projections.threshold) & ~seen[at])
                if len(found):
                    seen[at, found] = True
                    self._verify(block, int(queries[at]), found)
            was_low[active], was_high[active] = np.minimum(low, was_low[active]), np.maximum(high, was_high[active])
            bound = np.minimum(self.bound[queries[active]], 2.0)
            going = radius[active] < bound
            active, bound = active[going], bound[going]
            radius[active] = np.minimum(radius[active] * STEP, bound)

    def _verify(self, block: _Block, query: int, found: np.ndarray) -> None:
        """Exact cosines of what collided often enough."""
        self.verified += len(found)
        scores = (block.vectors[found] * self.vectors[query]).sum(axis=1) / (block.norms[found] * self.norms[query])
        best, own = self.best[query], self.ids[query]
        if len(best) == self.k:
            better = scores >= -best[-1][0]
            found, scores = found[better], scores[better]
        # Beyond the k-th score nothing counts, but all ties with it do, as the smaller id wins.
        if len(scores) > self.k + 1:
            better = scores >= np.partition(scores, -self.k - 1)[-self.k - 1]
            found, scores = found[better], scores[better]
        rows = [(-float(s), block.ids[i] is None, block.ids[i]) for i, s in zip(found.tolist(), scores) if block.ids[i] is None or block.ids[i] != own]
        if not rows:
            return
        best += rows
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            # A little over the distance of the k-th, so that rounding hides no tie.
            self.bound[query] = np.sqrt(max(0.0, 2.0 + 2.0 * best[-1][0])) + 1e-7


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of components, each row times a power of two that brings its largest below 1; cosines stay as they are."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def usable(vector: Column) -> Column:
    """Neither NULL, empty, zero nor with a component that is NULL or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _usable_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(usable(F.col("vec")))


def index_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> tuple[DataFrame, Projections | None]:
    """All usable vectors, written in an order that keeps alike ones together, and the projections they are searched with.

    Usable are vectors that ``usable`` lets pass and that have ``dim`` components; by default the length
    that most of them have, ties to the longer. The order is by the signs of the first projections; blocks
    of it are sorted along every projection where they are searched. Without usable vectors there are no
    projections. Nothing is fitted.
    """
    rows = _usable_rows(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.filter(F.lit(True) if dim is None else F.col("dim") == dim).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return rows.limit(0), None
    dim, n = most["dim"], most["n"]
    projections = Projections(dim)
    signs = projections.matrix[:, :CODE_BITS]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive = _matrix(batch.column(1), dim) @ signs > 0
            code = positive @ (1 << np.arange(positive.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.int64())], names=["vec_id", "vec", "code"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    named = rows.filter(F.size("vec") == dim).mapInArrow(coded, f"vec_id {kind}, vec array<double>, code long").withColumn("row", F.monotonically_increasing_id())
    dealt = named.repartitionByRange(-(-n // BLOCK), "code", "vec_id", "row").sortWithinPartitions("code", "vec_id")
    return materialize(dealt.select("vec_id", "vec"), "vectors"), projections


def nearest(index: tuple[DataFrame, Projections | None], queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_values: int = QUERY_VALUES) -> DataFrame:
    """The k indexed vectors of largest cosine per query: query_id, rank (from 1), vec_id, score; fewer if there are fewer.

    Equal cosines go by ascending id, NULL last; scores are exact, in double precision on the vectors as
    given. A vector with the id of the query is no neighbour of it; rows that repeat an id are vectors
    of their own otherwise. Queries alike in id and vector are one. Queries that are not usable, or of
    another length than the index, give no rows, and so does an empty index.

    The search is approximate: of vectors right at the distance of the k-th best, about MISS stay below
    the threshold, and fewer the nearer they are. Every vector is in the index and there is no cap on
    candidates. The queries are the stated set: they go through the index in blocks of at most about
    ``query_values`` components, each block broadcast for one pass. A task reads its part of the index
    block by block and carries the k best of each query along, so later blocks start with narrow windows.
    """
    vectors, projections = index
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if projections is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim = projections.matrix.shape[0]
    wanted = _usable_rows(queries, id_col, vec_col).filter(F.size("vec") == dim).distinct()
    n_blocks = max(1, -(-wanted.count() * dim // query_values))
    block = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_blocks))
    found, before = None, 0
    for b in range(n_blocks):
        rows = wanted.filter(block == b).toArrow() if n_blocks > 1 else wanted.toArrow()
        part = materialize(_found(vectors, rows, projections, k, FOUND.format(id=kind)), f"found_{b}")
        part = part.withColumn("query", F.col("query") + before)
        before += rows.num_rows
        found = part if found is None else found.unionByName(part)
    # A few rows per query and task.
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(vectors: DataFrame, rows: pa.Table, projections: Projections, k: int, schema: str) -> DataFrame:
    """The best k of each task's part of the index, per query."""
    dim = projections.matrix.shape[0]
    ids = rows.column(0).combine_chunks()
    asked = _matrix(rows.column(1).combine_chunks(), dim) if rows.num_rows else np.empty((0, dim))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, asked, projections))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, projections = shared.value
        queries = _Queries(ids.to_pylist(), asked, projections, k)
        for part in _blocks(batches) if len(asked) else ():
            queries.search(_Block(part.column(0), _matrix(part.column(1), dim), projections))
        for at in range(0, len(asked), 10_000):
            rows = [(q, row[2], -row[0]) for q in range(at, min(at + 10_000, len(asked))) for row in queries.best[q]]
            if rows:
                query, found, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int32()), ids.take(pa.array(query)), pa.array(found, ids.type), pa.array(score, pa.float64())], names=["query", "query_id", "vec_id", "score"]
                )

    return vectors.mapInArrow(search, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in runs of BLOCK."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == BLOCK:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
