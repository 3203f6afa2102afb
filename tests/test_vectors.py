import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.operators import vectors

SCHEMA = "dataset string, record_id long, vector array<double>, features array<string>, label double, split string"


def plain_near(rows, limit):
    fine = [r for r in rows if r[2] and None not in r[2] and np.isfinite(r[2]).all() and any(r[2]) and len(r[2]) == 6]
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    out = {}
    for d, i, v, *_ in (r for r in fine if r[5] == "test"):
        near = [(round(float((unit(v) * unit(r[2])).sum()), 9), r[1]) for r in fine if r[0] == d and r[5] == "train"]
        out[d, i] = (*min(((-c, k) for c, k in near), default=(None, None))[::-1], sum(c > limit for c, _ in near))
    return out


def random_rows(seed, n, dataset="a", start=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 6))
    return [
        (dataset, start + i, (centres[i % 5] + 0.4 * rng.standard_normal(6)).tolist(), None, float(i % 2), "test" if i % 4 == 0 else "train") for i in range(n)
    ]


@pytest.mark.parametrize("block,values", [(7, 30), (4096, 4_000_000)])
def test_nearest_match_brute_force(spark, monkeypatch, block, values):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    rows = random_rows(1, 200) + random_rows(2, 60, "b")
    rows += [("a", 500 + i, rows[1][2], None, 0.0, "train") for i in range(30)]  # copies, so ties
    rows += [("a", 600, rows[1][2], None, 0.0, "test"), ("a", 601, [1e200 * x for x in rows[2][2]], None, 0.0, "test"), ("c", 1, rows[0][2], None, 0.0, "test"), ("d", 1, rows[0][2], None, 0.0, "train")]
    rows += [("a", 700 + k, v, None, 0.0, s) for k, v in enumerate([None, [], [0.0] * 6, [None] * 6, [math.nan] * 6, [math.inf] * 6, [1.0, 2.0]]) for s in ("test",)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.dataset, r.record_id): (r.near_id, None if r.cosine is None else -round(r.cosine, 9), r.n_close) for r in vectors.nearest_vectors(frame, 0.9, test_values=values).collect()}
    assert got == plain_near(rows, 0.9)
    assert got["a", 600][0] == 1 and got["c", 1] == (None, None, 0)


def test_far_blocks_are_left_out(monkeypatch):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    block, asked = unit(np.eye(6)[0] + 0.01 * rng.standard_normal((50, 6))), unit(np.eye(6)[1] + 0.01 * rng.standard_normal((20, 6)))
    best, top, close = [(0.5, 1)] * 20, np.full(20, 0.5), np.zeros(20, np.int64)
    monkeypatch.setattr(vectors.np, "count_nonzero", lambda *a, **k: pytest.fail("no test vector should be compared"))
    vectors._block(list(range(50)), block, np.arange(20), asked, best, top, close, 0.9)
    assert set(best) == {(0.5, 1)}


def test_quadrant_and_given_predictions(spark):
    v = lambda angle: [math.cos(angle), math.sin(angle)]
    rows = [("a", 1, v(0.0), ["x", "y"], 1.0, "train"), ("a", 2, v(2.0), ["z"], 0.0, "train")]
    rows += [("a", 10, v(0.1), ["x", "y"], 1.0, "test"), ("a", 11, v(0.2), ["q"], 1.0, "test"), ("a", 12, v(1.0), ["q"], 0.0, "test"), ("a", 13, None, ["q"], 0.0, "test"), ("a", 14, v(2.05), None, 0.0, "test")]
    frame = spark.createDataFrame(rows, SCHEMA)
    quadrant = vectors.danger_quadrant(frame, 0.95, 0.5)
    got = {r.record_id: (r.near_id, r.set_similarity, r.severity) for r in quadrant.collect()}
    assert got == {10: (1, 1.0, "PASS"), 11: (1, 0.0, "HIGH"), 12: (1, 0.0, "PASS"), 13: (None, None, "SKIPPED"), 14: (2, 0.0, "HIGH")}
    predictions = frame.select("dataset", "record_id", "label", F.lit(1.0).alias("prediction"), (1 / F.col("record_id")).alias("confidence"))
    assert {r.side: (r.n_rows, r.right) for r in vectors.near_far_score(quadrant, predictions).collect()} == {"near": (2, 0.5), "far": (2, 0.5)}
    near = vectors.nearest_vectors(frame, 0.95)
    whole, quartiles = vectors.confidence_inflation(near, predictions)
    d = {i: 1 - math.cos(a) for i, a in ((10, 0.1), (11, 0.2), (12, 1.0), (14, 0.05))}
    r = whole.first()
    assert r.n == 4 and r.median == pytest.approx(np.quantile(list(d.values()), 0.5))
    assert r.correlation == pytest.approx(np.corrcoef([1 / x for x in d.values()], [1 / i for i in d])[0, 1])
    assert {q.quartile: q.n_rows for q in quartiles.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.nearest_vectors(empty, 0.5).collect() == [] and vectors.danger_quadrant(empty, 0.5, 0.5).collect() == []
