"""Nearest neighbours by collision counts: against brute force, recall and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.llm import collisions
from splitguard.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, vec string, row string, code string, query string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, *["clash"] * 6) for i, v in rows], SCHEMA)


def plain(rows, queries, k):
    """(query, [(vec_id, score)]) by brute force; ties to the smaller id, NULL last."""
    fine = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = lambda v: v / np.abs(v).max()
    cosine = lambda a, b: float((unit(a) * unit(b)).sum() / np.sqrt((unit(a) ** 2).sum()) / np.sqrt((unit(b) ** 2).sum()))
    out = {}
    for q, v in ((i, v) for i, v in fine if i in queries):
        near = sorted(((-round(cosine(v, x), 9), i is None, i) for i, x in fine if i is None or i != q))
        out[q] = [(i, -s) for s, _, i in near[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block,together", [(40, 7), (4096, 256)])
def test_recall_on_the_given_vectors(spark, sf, monkeypatch, block, together):
    monkeypatch.setattr(collisions, "BLOCK", block)
    monkeypatch.setattr(collisions, "TOGETHER", together)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = answers(QUERIES["op12_collision_counts"](spark, sf))
    assert got.keys() == want.keys() and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    scores = {q: dict(plain(rows, {q}, len(rows))[q]) for q in want}
    assert all(scores[q][i] == pytest.approx(s, abs=1e-8) for q in got for i, s in got[q])


def test_clustered_vectors_are_found_with_few_looks():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((50, 96))
    vectors = np.repeat(centres, 80, axis=0) + 0.1 * rng.standard_normal((4000, 96))
    projections = collisions.Projections(96)
    import pyarrow as pa

    queries = collisions._Queries(list(range(0, 4000, 50)), vectors[::50], projections, 5)
    order = rng.permutation(4000)
    for part in np.array_split(order, 4):
        queries.search(collisions._Block(pa.array(part), vectors[part], projections))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for best, q in zip(queries.best, queries.ids):
        near = unit @ unit[q]
        near[q] = -9
        hits += len({i for _, _, i in best} & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.97 * 400
    assert queries.verified < 0.03 * 80 * 4000


def test_the_threshold_holds_its_miss_rate():
    rng = np.random.default_rng(8)
    for dim in (1, 2, 3, 16, 64, 300):
        projections = collisions.Projections(dim)
        at = rng.standard_normal((5000, dim))
        at /= np.linalg.norm(at, axis=1, keepdims=True)
        met = np.count_nonzero(np.abs(at @ projections.matrix) <= collisions.WIDTH, axis=1)
        assert (met < projections.threshold).mean() <= 2.5 * collisions.MISS


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # copies of a query, more than a block holds
    rows += [(200, [1e200 * x for x in rows[1][1]]), (201, [1e-200 * x for x in rows[1][1]]), (None, rows[2][1]), (None, rows[2][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None, *[1.0] * 7]), (304, [float("nan"), *[1.0] * 7]), (305, [float("inf"), *[1.0] * 7])]
    used = [(i, v) for i, v in rows]
    rows += [(400, [1.0, 2.0]), (50, [3.0])]  # other lengths
    rows += [(7, rows[7][1]), (3, rows[3][1])]  # repeated rows
    vectors = frame(spark, rows)
    got = answers(collisions.nearest(collisions.index_vectors(vectors), vectors.filter("vec_id IN (0, 1, 2, 7, 300, 302, 305, 400)"), k=5))
    want = plain([*used, (3, used[3][1])], {0, 1, 2, 7}, 5)
    assert got == want
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104] and got[2][0][0] is None


def test_blocks_of_queries_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    vectors = frame(spark, rows)
    index = collisions.index_vectors(vectors)
    got = answers(collisions.nearest(index, vectors.filter("vec_id < 9"), k=3, query_values=15))
    assert got == plain(rows, set(range(9)), 3)
    assert answers(collisions.nearest(index, vectors.filter("vec_id = 1"), k=100))[1] == plain(rows, {1}, 100)[1]
    assert collisions.nearest(index, vectors.filter(F.lit(False))).collect() == []
    empty = collisions.nearest(collisions.index_vectors(vectors.filter(F.lit(False))), vectors)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    alone = collisions.nearest(collisions.index_vectors(vectors.filter("vec_id = 4")), vectors.filter("vec_id = 4"))
    assert alone.collect() == []
