"""Near-duplicate groups by an LSH forest over MinHash signatures, every link confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.llm.components import components
from splitguard.storage import lookup, materialize

WIDTH = 5
TREES, MIN_DEPTH, MAX_DEPTH = 12, 3, 8  # at least so many trees
APART = 1.1e-5  # chance at most that a pair just at the bound shares no region in any tree
UNLIKE = 2e-6  # chance at most that it has fewer equal signature values than a likely pair must have
REGION = 512  # a region with more sets is looked at one level deeper
MEETING = 40  # bits of a cell number below the tree number, where two cells of a large region meet
LONG = 50_000  # shingles; longer sets are compared in pairs, so that a block of sets fits in memory
CACHE_WORDS = 500_000
SEED = 42

SKETCH = "doc_id {id}, n_shingles long, c1 long, c2 long, signature binary"


@cache
def trees_for(percent: int) -> int:
    """Trees that leave a pair with this similarity apart with a chance of at most APART; 12 at 85, 16 at 80."""
    trees, meet = TREES, (percent / 100) ** MIN_DEPTH
    while (1 - meet) ** trees > APART:
        trees += 1
    return trees


@cache
def least_alike(percent: int, n: int) -> int:
    """The most equal values, of n, that may be asked of a pair if UNLIKE of those at the bound may have fewer; 64 of 96 at 85."""
    j, below = percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * j**k * (1 - j) ** (n - k)
        if below > UNLIKE:
            return k
    return n


class _Sketcher:
    """Shingle sets as sorted distinct 64-bit numbers, and their signatures."""

    def __init__(self, width: int, trees: int):
        self.width, self.known = width, {}
        rng = np.random.default_rng(SEED)
        n = trees * MAX_DEPTH
        self.mul = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, n, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        # On bytes, lower() touches A-Z only and split() parts at ASCII white space only.
        words = (text or "").encode().lower().split()
        known = self.known
        try:
            numbers = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            numbers = list(map(known.__getitem__, words))
        if not numbers:
            return np.empty(0, dtype=np.uint64)
        h = np.array(numbers, dtype=np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        """The smallest value of each hash function; the values of one tree lie side by side."""
        least = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), block):
            part = shingles[None, at : at + block] * self.mul[:, None]
            part += self.add[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("<u4")


@cache
def _sketcher(width: int, trees: int = TREES) -> _Sketcher:
    """A Python worker keeps the hashes of the words it has seen from task to task."""
    return _Sketcher(width, trees)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """Per row: size of the shingle set, a 128-bit fingerprint of the set (c1, c2), and its signature."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _sketcher(width, trees)
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = own.shingles(text)
                sizes.append(len(shingles))
                prints.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8"))
                signatures.append(own.signature(shingles).tobytes() if len(shingles) else None)
            both = np.array(prints, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "c1", "c2", "signature"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(sketch, SKETCH.format(id=id_type))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = WIDTH, region: int = REGION
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both. A text with fewer
    than ``width`` words is one shingle; one without words has none and is linked with nothing.
    ``component_id`` is the smallest id reachable over links. A row without id links with nothing and has
    component NULL; rows that repeat id and text come out alike. Other columns are not read.

    Equal sets become one vertex. Each tree orders the signatures by its own run of values; a region is a
    common prefix, at least MIN_DEPTH long. A region of more than ``region`` sets is cut into cells that
    share a pivot, and is also taken apart by the next values, down to MAX_DEPTH. A first round confirms,
    per region, a forest of the likeliest pairs. In a second one the task that holds a region confirms
    every likely pair whose ends are not yet in one component; of a large region any two cells that hold
    different components meet, so every two sets of a region do. Only links leave a task, so copies never
    expand into pairs. No pair is dropped for number. A pair just at the bound shares a region with a
    chance of 1 - 1e-5, whatever the size of its regions: the number of trees follows from ``percent``.
    """
    sets = materialize(sketches(docs, id_col, text_col, width, trees_for(percent)), "sketches")
    classes = materialize(
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(
            F.min("doc_id").alias("v"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    vertices = classes.select("v", "n", "signature")
    blocks, crowded = _blocks(vertices, region, trees_for(percent))
    blocks = materialize(blocks, "blocks")
    # From here on only sets that share a region count; the others are alone.
    vertices = materialize(vertices.join(blocks.select("v").distinct().hint("merge"), "v", "left_semi"), "vertices")
    first = materialize(_candidates(blocks, vertices.withColumn("label", F.col("v")), percent, _forest).distinct(), "forest_pairs")

    # Who has a likely partner is an end of a forest pair, or lies in a large region. Their texts are fetched
    # once for both rounds, and by the same plan at every size.
    wanted = first.select(F.explode(F.array("a", "b")).alias("v"))
    if crowded is not None:
        wanted = wanted.unionByName(crowded.select("v"))
    texts = docs.select(F.col(id_col).alias("v"), F.col(text_col).cast("string").alias("text"))
    texts = materialize(texts.join(wanted.distinct().hint("merge"), "v", "left_semi"), "texts")

    links = materialize(_confirmed(first, texts, percent, width), "links")
    labels = materialize(components(links), "labels")
    labelled = vertices.join(labels.withColumnRenamed("component", "label"), "v", "left").withColumn("label", F.coalesce("label", "v"))
    if crowded is not None:
        blocks = blocks.unionByName(materialize(_meetings(crowded, labelled, region), "meetings"))
    more = materialize(_settled(_unsettled(blocks, labelled, percent), texts, percent, width), "more_links")
    # Sets too long to be held by the hundred go in pairs.
    long_sets = labelled.filter(100 * F.col("n") >= percent * LONG)
    if not long_sets.isEmpty():
        long_pairs = _candidates(blocks, long_sets, percent, _long_pairs).distinct().join(first, ["a", "b"], "left_anti")
        more = more.unionByName(materialize(_confirmed(materialize(long_pairs, "long_pairs"), texts, percent, width), "long_links"))
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "all_labels")

    named = classes.select("c1", "c2", "v", "n_rows").join(labels, "v", "left").select(
        "c1", "c2", "n_rows", F.coalesce("component", "v").alias("component")
    )
    rows = sets.select("doc_id", "n_shingles", "c1", "c2")
    out = lookup(rows, materialize(named, "named_classes"), ["c1", "c2"], "n_rows", "doc_id")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _prefix(depth: int):
    """A hash of the tree number and the first values of its order, which lie side by side in the signature."""
    return F.xxhash64("tree", F.expr(f"substring(signature, tree * {4 * MAX_DEPTH} + 1, {4 * depth})"))


def _blocks(vertices: DataFrame, region: int, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """(h, cell, v): sets to be compared with one another, at most ``region`` and a pivot per (h, cell).

    And the rows (h, tree, v) of the regions at MIN_DEPTH that are larger, if there are any: not every two of
    their sets are in one block.
    """
    planted = vertices.select("v", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    deeper = F.array(*[_prefix(depth) for depth in range(MIN_DEPTH + 1, MAX_DEPTH + 1)]).alias("deeper")
    rows, parts, crowded = planted.select("v", "tree", _prefix(MIN_DEPTH).alias("h")), [], None
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        sizes = materialize(
            rows.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("pivot")).filter("n > 1").withColumn("weight", F.col("n")),
            f"regions_{depth}",
        )
        shared = materialize(lookup(rows, sizes, ["h"], "weight", "v").filter("n IS NOT NULL"), f"shared_{depth}")
        parts.append(shared.filter(F.col("n") <= region).select("h", F.lit(0).cast("long").alias("cell"), "v"))
        large = shared.filter(F.col("n") > region)
        if large.isEmpty():
            break
        if depth == MIN_DEPTH:
            crowded = large.select("h", "tree", "v")
            # Deeper prefixes are worked out for the sets of large regions only, and once for all depths.
            large = large.select("v", "tree", "h", "n", "pivot").join(vertices.select("v", "signature"), "v").select("v", "tree", "h", "n", "pivot", deeper)
        if depth in (MIN_DEPTH, MAX_DEPTH):
            cells = F.ceil(F.col("n") / region)
            own = F.array(F.pmod(F.xxhash64("v", "tree"), cells))
            places = F.when(F.col("v") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(own)
            parts.append(large.select("h", F.explode(places).alias("cell"), "v"))
        if depth < MAX_DEPTH:
            rows = large.select("v", "tree", "deeper", F.get("deeper", F.lit(depth - MIN_DEPTH)).alias("h"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, crowded


def _meetings(crowded: DataFrame, labelled: DataFrame, region: int) -> DataFrame:
    """Blocks (h, cell, v) in which every two sets of one large region meet that are not in one component.

    Where all but ``region`` sets are in one component, that one is cut into cells and the others go to
    each of them. Otherwise the region is cut into cells and each two of them make a block.
    """
    rows = crowded.join(labelled.select("v", "label"), "v")
    counts = rows.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most"))
    counts = counts.filter("most.k < n").select("h", "n", F.col("most.k").alias("k"), F.col("most.label").alias("most"), F.col("n").alias("weight"))
    rows = lookup(rows, materialize(counts, "crowded_regions"), ["h"], "weight", "v").filter("n IS NOT NULL")
    half = max(1, region // 2)
    few = F.col("n") - F.col("k") <= region
    cells = F.ceil(F.when(few, F.col("k")).otherwise(F.col("n")) / half)
    own, every = F.pmod(F.xxhash64("v", "tree"), F.col("cells")), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    with_each = F.transform(every, lambda c: F.least(c, F.col("own")) * F.col("cells") + F.greatest(c, F.col("own")))
    places = F.when(few & (F.col("label") == F.col("most")), F.array("own")).when(few, every).otherwise(with_each)
    rows = rows.withColumn("cells", cells).withColumn("own", own)
    marked = (F.col("tree").cast("long") + 1) * F.lit(1 << MEETING)
    return rows.select("h", marked.alias("mark"), "v", F.explode(places).alias("place")).select("h", (F.col("mark") + F.col("place")).alias("cell"), "v")


def _members(blocks: DataFrame, vertices: DataFrame) -> DataFrame:
    """The rows of each block together and in order."""
    rows = blocks.join(vertices, "v").select("h", "cell", "v", "n", "label", "signature")
    return rows.repartition("h", "cell").sortWithinPartitions("h", "cell", "v")


def _candidates(blocks: DataFrame, vertices: DataFrame, percent: int, choose: Callable) -> DataFrame:
    """Those likely pairs (a, b), a < b, within each block that ``choose`` picks."""
    id_type = vertices.schema["v"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ("h", "cell")):
            left, right = choose(*_likely(block, percent), block.column("n").to_numpy())
            if len(left):
                ids = block.column("v")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right))], names=["a", "b"])

    return _members(blocks, vertices).mapInArrow(_gathered(pairs), f"a {id_type}, b {id_type}")


def _likely(block: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with different labels, sizes that allow a link, and enough equal signature values; likeliest first."""
    n = block.column("n").to_numpy()
    label = block.column("label").to_numpy(zero_copy_only=False)
    signature = np.frombuffer(b"".join(block.column("signature").to_pylist()), dtype="<u4").reshape(len(n), -1)
    # Where cells meet, a pair is left to the first tree in which its sets share a region.
    trees = range(max(0, (block.column("cell")[0].as_py() >> MEETING) - 1))
    prefixes = [signature[:, t * MAX_DEPTH : t * MAX_DEPTH + MIN_DEPTH] for t in trees]
    before = np.array([np.unique(p, axis=0, return_inverse=True)[1].reshape(-1) for p in prefixes]).T
    lefts, rights, alike = [], [], []
    for i in range(len(n) - 1):
        possible = np.flatnonzero(
            (label[i + 1 :] != label[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
        ) + i + 1
        if len(trees) and len(possible):
            possible = possible[(before[possible] != before[i]).all(axis=1)]
        if len(possible):
            same = (signature[possible] == signature[i]).sum(axis=1)
            likely = same >= least_alike(percent, signature.shape[1])
            if likely.any():
                rights.append(possible[likely])
                lefts.append(np.full(int(likely.sum()), i))
                alike.append(same[likely])
    if not lefts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    left, right, same = np.concatenate(lefts), np.concatenate(rights), np.concatenate(alike)
    order = np.argsort(-same, kind="stable")
    return left[order], right[order], same[order]


class _Union:
    def __init__(self, labels: list):
        first: dict = {}
        self.root = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


def _forest(left: np.ndarray, right: np.ndarray, same: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the likeliest pairs."""
    union, a, b = _Union(list(range(len(n)))), [], []
    for i, j in zip(left.tolist(), right.tolist()):
        if union.find(i) != union.find(j):
            union.join(i, j)
            a.append(i)
            b.append(j)
    return a, b


def _long_pairs(left: np.ndarray, right: np.ndarray, same: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    long = np.maximum(n[left], n[right]) > LONG if len(left) else np.empty(0, dtype=bool)
    return left[long].tolist(), right[long].tolist()


def _unsettled(blocks: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The rows of each block that have a likely partner in another component, long sets apart."""
    rows = _members(blocks, vertices)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ("h", "cell")):
            left, right, _ = _likely(block, percent)
            if len(left):
                n = block.column("n").to_numpy()
                short = np.maximum(n[left], n[right]) <= LONG
                own = np.unique(np.concatenate([left[short], right[short]]))
                if len(own):
                    yield block.take(pa.array(own))

    return rows.mapInArrow(_gathered(pick), rows.schema)


def _settled(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between components, found within each block on full sets: a spanning forest of them."""
    id_type = members.schema["v"].dataType.simpleString()
    rows = members.join(texts, "v").repartition("h", "cell").sortWithinPartitions("h", "cell", "v")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _sketcher(width)
        for block in _runs(batches, ("h", "cell")):
            union, sets, a, b = _Union(block.column("label").to_pylist()), {}, [], []
            left, right, _ = _likely(block, percent)
            text = block.column("text")
            for i, j in zip(left.tolist(), right.tolist()):
                if union.find(i) == union.find(j):
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = own.shingles(text[k].as_py())
                if _alike(sets[i], sets[j], percent):
                    union.join(i, j)
                    a.append(i)
                    b.append(j)
            if a:
                ids = block.column("v")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    return rows.mapInArrow(_gathered(settle), f"a {id_type}, b {id_type}")


def _alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted batches, also where a run goes on in the next batch."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts[:-1], starts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != held_key:
                yield _joined(held)
                held = []
            held_key = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _gathered(make: Callable, rows: int = 4096) -> Callable:
    """Small batches put together before they go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in make(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    id_type = pairs.schema["a"].dataType.simpleString()
    sides = pairs.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    sides = sides.withColumn("v", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    rows = sides.join(texts, "v").select("a", "b", "side", "text")
    # Where rows repeat an id, its first text stands for it on that side.
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "side", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _sketcher(width)
        last, last_set = None, None
        for pair in _runs(batches, ("a", "b")):
            sides_ = pair.column("side").to_pylist()
            if 0 not in sides_ or 1 not in sides_:
                continue
            a = pair.column("a")[0].as_py()
            if a != last:
                last, last_set = a, own.shingles(pair.column("text")[0].as_py())
            other = own.shingles(pair.column("text")[sides_.index(1)].as_py())
            if _alike(last_set, other, percent):
                yield pair.select(["a", "b"]).slice(0, 1)

    return rows.mapInArrow(_gathered(confirm), f"a {id_type}, b {id_type}")
