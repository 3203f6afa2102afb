"""Ranked lexical search: documents share paths in a frequency-ordered tree, and bounds per subtree steer the search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitguard.storage import materialize

# --- fixed values: how a term is weighed ---
GAIN, SCALE, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 1000, 8, 90

BLOCK_CHARS = 2_000_000  # characters of items searched in one pass over the documents
TREE_ROWS, TREE_POSTINGS = 16_384, 4_000_000  # documents and postings of one tree at most; a document is never parted
LEAF_ROWS = 256
LONG_TEXT = 1_000_000  # bytes of a text whose terms are listed at once

# A-Z to a-z; a blank for every ASCII character that is no letter and no digit.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes | None) -> Counter:
    """The terms of a text in UTF-8 with their numbers; only A-Z are lower-cased."""
    found: Counter = Counter()
    data = (text or b"").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + LONG_TEXT) if len(data) > at + LONG_TEXT else len(data)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split(b" "))
        at = end
    found.pop(b"", None)
    return found


class Weights:
    """The whole corpus in a few figures, and the weight and frequency rank of each term of the items."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        order = np.lexsort((np.arange(len(df)), -df))
        self.rank = np.empty(len(df), np.int64)
        self.rank[order] = np.arange(len(df))
        self.by_rank = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) for t in order], np.int64)

    def length(self, n: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.n_docs) // max(self.n_terms, 1)


class _Columns:
    """Postings by term and then by place (of a document or a node), and what they add to a score."""

    def __init__(self, term: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.width, self.m = len(m), m
        key = term * self.width + place
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.keys, self.tf = key[first], np.maximum.reduceat(tf, first) if len(first) else tf
        self.place = self.keys % self.width

    def totals(self, terms: np.ndarray, weights: np.ndarray, low: int, high: int) -> np.ndarray:
        """Scores of the places from low to high for an item's terms; exact, as all sums stay below 2**53."""
        start = np.searchsorted(self.keys, terms * self.width + low)
        many = np.searchsorted(self.keys, terms * self.width + high) - start
        if not many.any():
            return np.zeros(high - low, np.int64)
        at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        place, tf = self.place[at], self.tf[at]
        gains = np.repeat(weights, many) * ((GAIN * tf) // (TF_WEIGHT * tf + LENGTH_WEIGHT * self.m[place]))
        return np.bincount(place - low, gains, high - low).astype(np.int64)


class Tree:
    """Restricted term vectors as a tree: each is its terms from the most to the least frequent one.

    Vectors with a common beginning lie below one node; paths without a branch are one edge. A node knows the
    largest tf that each term has below it and the smallest m, so no document below it scores more than
    the node does with these. Up to LEAF_ROWS documents stay together in a leaf.
    """

    def __init__(self, ids: list, m: np.ndarray, doc: np.ndarray, rank: np.ndarray, tf: np.ndarray, leaf_rows: int = LEAF_ROWS):
        within = np.lexsort((rank, doc))
        doc, rank, tf = doc[within], rank[within], tf[within]
        size = np.bincount(doc, minlength=len(ids))
        end = np.cumsum(size)
        paths = rank.astype(">u4").tobytes()
        order = np.array(sorted(range(len(ids)), key=lambda i: paths[4 * (end[i] - size[i]) : 4 * end[i]]), np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, m = [ids[i] for i in order], m[order]
        self._grow(self._shared(rank, (end - size)[order], size[order]), leaf_rows)
        self.docs = _Columns(rank, place[doc], tf, m)
        self.nodes = self._maxima(rank, place[doc], tf, m)

    @staticmethod
    def _shared(rank: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many leading terms each document shares with the next one."""
        shared = np.zeros(max(len(start) - 1, 0), np.int64)
        going, depth = np.arange(len(shared)), 0
        while len(going):
            going = going[(size[going] > depth) & (size[going + 1] > depth)]
            going = going[rank[start[going] + depth] == rank[start[going + 1] + depth]]
            depth += 1
            shared[going] = depth
        return shared

    def _grow(self, shared: np.ndarray, leaf_rows: int) -> None:
        """Nodes as runs of documents, level by level; the children of a node have consecutive numbers."""
        low, high, children, level = [0], [len(self.ids)], [], [0]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            inside = shared[a : b - 1]
            depth = inside.min() if b - a > leaf_rows else None
            # Equal vectors stay in one leaf however many there are.
            cuts = np.flatnonzero(inside == depth) + a + 1 if depth is not None and depth < inside.max() else ()
            bounds = self._runs([a, *map(int, cuts), b], leaf_rows) if len(cuts) else [a, b]
            children.append((len(low), len(low) + len(bounds) - 1) if len(bounds) > 2 else None)
            if len(bounds) > 2:
                low += bounds[:-1]
                high += bounds[1:]
                level += [level[at] + 1] * (len(bounds) - 1)
            at += 1
        self.low, self.high, self.children, self.level = low, high, children, np.array(level)

    @staticmethod
    def _runs(bounds: list[int], leaf_rows: int) -> list[int]:
        """Small neighbouring branches go together up to the size of a leaf."""
        out = [bounds[0]]
        for n, b in enumerate(bounds[1:], 1):
            after = bounds[n + 1] if n + 1 < len(bounds) else None
            if after is None or after - out[-1] > leaf_rows:
                out.append(b)
        return out

    def _maxima(self, rank: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray) -> _Columns:
        parent, leaf = np.zeros(len(self.low), np.int64), np.zeros(len(self.ids), np.int64)
        least = np.zeros(len(self.low), np.int64)
        for n, (a, b, own) in enumerate(zip(self.low, self.high, self.children)):
            least[n] = m[a:b].min() if b > a else 0
            if own:
                parent[own[0] : own[1]] = n
            else:
                leaf[a:b] = n
        below = _Columns(rank, leaf[place], tf, least)
        terms, nodes, tops = [below.keys // below.width], [below.place], [below.tf]
        pending = (terms[0], nodes[0], tops[0])
        for depth in range(int(self.level.max(initial=0)), 0, -1):
            deep = self.level[pending[1]] == depth
            up = _Columns(pending[0][deep], parent[pending[1][deep]], pending[2][deep], least)
            made = (up.keys // up.width, up.place, up.tf)
            for kept, new in zip((terms, nodes, tops), made):
                kept.append(new)
            pending = tuple(np.concatenate([old[~deep], new]) for old, new in zip(pending, made))
        return _Columns(np.concatenate(terms), np.concatenate(nodes), np.concatenate(tops), least)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> int:
        """Puts documents that belong there into ``best``, the k best rows (-score, id is NULL, id) so far; returns how many were scored.

        Depth first, the child with the highest bound before the others. A subtree whose bound is below the
        k-th score is left out; one that ties with it is not, as a smaller id may be in it.
        """
        floor = lambda: -best[-1][0] if len(best) == k else 1
        # One call over all nodes costs less than one per node that the search comes to.
        bounds = self.nodes.totals(terms, weights, 0, len(self.low))
        scored, open_ = 0, [0]
        while open_:
            node = open_.pop()
            if bounds[node] < floor():
                continue
            if self.children[node]:
                first, last = self.children[node]
                open_ += (first + np.argsort(bounds[first:last], kind="stable")).tolist()
                continue
            a, b = self.low[node], self.high[node]
            scores = self.docs.totals(terms, weights, a, b)
            scored += b - a
            found = np.flatnonzero(scores >= floor())
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
            if len(found):
                best += [(-int(scores[i]), self.ids[a + i] is None, self.ids[a + i]) for i in found.tolist()]
                best.sort()
                del best[k:]
        return scored


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The k highest-scoring documents per item: item_id, rank (from 1), doc_id, score; only scores above 0.

    Terms are runs of ASCII letters and digits and of any other characters beyond ASCII. With N documents that
    have a term, L terms in all, n terms in a document and df documents with a term, a document scores the
    sum over the item's terms, once each, of w * ((10**9 tf) div (1000 tf + 8 m)), where w is
    floor(1000 ln((2N + 2) / (2 df + 1))) and m is 10 + (90 n N) div L. All documents count, and the result is exact.
    Equal scores go by ascending id, NULL last.

    NULL and empty texts have no terms. Rows that repeat an id are documents of their own; items alike in
    id and text are one, an item without terms gives no rows, and so does an empty table. Other columns are not read.

    Items are the stated query set: they go through in blocks of about ``block_chars`` characters, each
    with one pass over the texts, which writes each document's vector restricted to the block's terms,
    and one over these vectors, in trees of bounded size. A task carries the k best of each item from
    tree to tree.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")).filter(F.length("text") > 0).distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        part = _block_found(source, wanted.filter(block == b), k, kinds, b)
        found = part if found is None else found.unionByName(part)
    # At most k rows per item and task.
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block_found(source: DataFrame, items: DataFrame, k: int, kinds: tuple[str, str], number: int) -> DataFrame:
    """The best k of each task, per item of a block: item, item_id, doc_id, score."""
    spark = source.sparkSession
    rows = items.toArrow()
    texts = [sorted(terms_of(t)) for t in rows.column(1).to_pylist()]
    names = {t: n for n, t in enumerate(sorted({t for own in texts for t in own}))}
    vectors = materialize(_restricted(source, spark.sparkContext.broadcast(names), kinds[0]), f"vectors_{number}")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    # One row per term of the block.
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["t"]] = r["df"]
    weights = Weights(n_docs, n_terms, df)
    asked = [weights.rank[[names[t] for t in own]] for own in texts]
    ids = rows.column(0).combine_chunks()
    shared = spark.sparkContext.broadcast((ids, asked, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, weights = shared.value
        best: list[list[tuple]] = [[] for _ in asked]
        kind = None
        for doc_ids, tree in _trees(batches, weights):
            kind = doc_ids
            for own, top in zip(asked, best):
                tree.search(own, weights.by_rank[own], top, k)
        out = [(n, row[2], -row[0]) for n, top in enumerate(best) for row in top]
        for at in range(0, len(out), 50_000):
            item, doc, score = zip(*out[at : at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number * (1 << 32) + n for n in item], pa.int64()), ids.take(pa.array(item)), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "item_id", "doc_id", "score"]
            )

    held = vectors.filter(F.size("terms") > 0)
    return materialize(held.mapInArrow(search, f"item long, item_id {kinds[1]}, doc_id {kinds[0]}, score long"), f"ranked_{number}")


def _restricted(source: DataFrame, names, id_type: str) -> DataFrame:
    """Per document that has a term: doc_id, n, and of the terms asked for those it has, with their tf."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in batches:
            kept, sizes, terms, tfs = [], [], [], []
            for at in range(batch.num_rows):
                found = terms_of(batch.column(1)[at].as_py())
                if found:
                    own = [(known[t], c) for t, c in found.items() if t in known]
                    kept.append(at)
                    sizes.append(found.total())
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return source.mapInArrow(restrict, f"doc_id {id_type}, n long, terms array<int>, tfs array<long>")


def _trees(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[tuple[pa.DataType, Tree]]:
    """The rows of a task as trees of bounded size."""
    held: list[pa.RecordBatch] = []
    rows = postings = 0
    for batch in batches:
        many = len(batch.column(2).flatten())
        parts = max(1, -(-many // TREE_POSTINGS), -(-batch.num_rows // TREE_ROWS))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            many = len(part.column(2).flatten())
            if held and (rows + part.num_rows > TREE_ROWS or postings + many > TREE_POSTINGS):
                yield _tree(held, weights)
                held, rows, postings = [], 0, 0
            held.append(part)
            rows, postings = rows + part.num_rows, postings + many
    if held:
        yield _tree(held, weights)


def _tree(parts: list[pa.RecordBatch], weights: Weights) -> tuple[pa.DataType, Tree]:
    whole = pa.concat_batches(parts)
    size = whole.column(2).value_lengths().to_numpy()
    doc = np.repeat(np.arange(whole.num_rows), size)
    rank, tf = weights.rank[whole.column(2).flatten().to_numpy()], whole.column(3).flatten().to_numpy()
    return whole.column(0).type, Tree(whole.column(0).to_pylist(), weights.length(whole.column(1).to_numpy()), doc, rank, tf)
