"""Frequent features: every block of test sets meets every block of train sets where it lies, and no set is sent."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitguard.operators import inplace
from splitguard.operators import neighbors as nb
from splitguard.operators.sieve import crossed

HELD = "part long, id string, in_train boolean, n int, feats array<bigint>"


def token_sets(seed, parts=(1, -7), train=90, test=40):
    rng = random.Random(seed)
    rows = []
    for part in parts:
        for i in range(train + test):
            size = rng.randrange(1, 25)
            feats = {int(50 * rng.random() ** 2) + part * 1000 for _ in range(size)} | ({10_000 + i} if i % 3 else set())
            rows.append((part, f"r{i:03}", i < train, len(feats), sorted(feats)))
    rows += [(1, "r500", True, 4, rows[3][4][:4]), (1, "r501", False, 2, [77_000, 77_001]), (1, None, False, 2, [1001, 1002])]
    return rows


def brute(rows):
    best = {}
    for part, i, in_train, n, feats in rows:
        if in_train or i is None:
            continue
        for p, j, other, m, more in rows:
            both = len(set(feats) & set(more))
            if other and p == part and both:
                key = (-both / (n + m - both), j, both, n + m - both)
                best[part, i] = min(best.get((part, i), key), key)
    return best


@pytest.mark.parametrize("size, counters, first", [(40, 50, 2), (300, 4_000_000, 5), (1_000_000, 4_000_000, 256)])
def test_blocks_in_place_find_what_all_pairs_find(spark, monkeypatch, size, counters, first):
    monkeypatch.setattr(inplace, "COUNTERS", counters)
    monkeypatch.setattr(inplace, "FIRST_SETS", first)
    rows = token_sets(3)
    held = spark.createDataFrame(rows, HELD).repartition(3)
    vocabulary = nb._vocabulary(held, 10)
    found = {}
    for r in inplace.best_in_place(held, vocabulary, size, size).collect():
        key = (-r.shared / r.either, r.train_id, r.shared, r.either)
        found[r.part, r.test_id] = min(found.get((r.part, r.test_id), key), key)
    assert found == brute(rows)
    found = {}
    for r in inplace.best_in_place(held, None, size, size).collect():
        key = (-r.shared / r.either, r.train_id, r.shared, r.either)
        found[r.part, r.test_id] = min(found.get((r.part, r.test_id), key), key)
    assert found == brute(rows)
    assert inplace.best_in_place(held, vocabulary.limit(0)).count() == 0
    assert inplace.best_in_place(held.filter("in_train"), vocabulary).count() == 0


def test_sets_of_frequent_features_are_not_sent(spark, monkeypatch):
    """Neither the sets nor their features go through a shuffle: what is joined are blocks, and not by key."""
    held = spark.createDataFrame(token_sets(4), HELD).repartition(3)
    plan = inplace.best_in_place(held, nb._vocabulary(held, 10))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def written(spark, run):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "splitguard"
    before = set(shared.glob("*/*"))
    run()
    return sorted(p.name for p in set(shared.glob("*/*")) - before)


def test_what_is_joined_by_key_are_rare_features_with_many_pairs(spark, make_frame, monkeypatch):
    frequent = [("a", i, None, None, [f"w{(i * k) % 17}" for k in range(1, 9)] + [f"x{i}"], 0.0, "test" if i % 4 == 0 else "train") for i in range(60)]
    rare = [("a", i, None, None, [f"own{i}-{k}" for k in range(9)] + [f"w{i // 2}"], 0.0, "test" if i % 2 == 0 else "train") for i in range(60)]
    assert {"cells", "chunks"} <= set(written(spark, lambda: nb.nearest_neighbors(make_frame(frequent)).collect()))
    assert {"cells", "chunks"} <= set(written(spark, lambda: nb.nearest_neighbors(make_frame(rare)).collect()))
    monkeypatch.setattr(inplace, "MOST_HITS", 5)
    names = written(spark, lambda: nb.nearest_neighbors(make_frame(rare)).collect())
    assert "ordered_sets" in names and "cells" not in names
    # The features of a record are written once, and sets are told apart by their hashes.
    assert names.count("hashed") == 1 and "frame" not in names


def test_sets_are_found_without_sending_features(spark, make_frame):
    rows = [("a", i % 50, None, None, [f"w{k}" for k in range(i % 7 + 1)], float(i), "test" if i % 3 == 0 else "train") for i in range(100)]
    frame = nb.hashed(make_frame(rows))
    sets = nb._sets_without_features(frame)
    got = nb._with_features(sets, frame)
    assert got.count() == 7 and {r["n"] for r in got.collect()} == set(range(1, 8))
    assert "hashpartitioning" not in nb._with_features(nb.materialize(sets, "sets"), frame)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, nb._with_features(sets, frame, 0).collect())) == sorted(map(str, got.collect()))


def test_features_of_one_side_are_left_out_before_they_are_counted(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        feats = {rng.randrange(-(2**63), 2**63) for _ in range(30)} | {rng.randrange(40) for _ in range(i % 4)}
        rows.append((1, f"r{i}", i % 5 > 0, len(feats), sorted(feats)))
    held = spark.createDataFrame(rows, HELD).repartition(4)
    sides = {s: set().union(*[r[4] for r in rows if r[2] == s]) for s in (True, False)}
    got = crossed(held, least=0).collect()
    left = {(r["id"], f) for r in got for f in r["feats"]}
    assert {(r[1], f) for r in rows for f in r[4] if f in sides[True] & sides[False]} <= left <= {(r[1], f) for r in rows for f in r[4]}
    assert len(left) < 700  # of more than 3,600
    plain, sieved = (sorted(map(str, nb._vocabulary(h, 10).collect())) for h in (held, crossed(held, least=0)))
    assert plain == sieved
    assert crossed(held.limit(0), least=0).count() == 0 and crossed(held.filter("in_train"), least=0).count() == 0
    assert {r["id"] for r in crossed(held, most_bits=16, least=0).collect()} >= {r["id"] for r in got if set(r["feats"]) & sides[True] & sides[False]}


def test_texts_of_a_table_in_many_parts_are_not_dealt_anew(spark, tmp_path):
    from splitguard.catalog.frames import labelled_documents

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        frame = labelled_documents(spark, str(tmp_path))
        assert frame.count() == 40 and "REPARTITION" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("share, cost, table", [(0.0, 1e9, 16_000_000), (0.2, 300, 16_000_000), (0.0, 1e9, 300), (1.0, 300, 16_000_000)])
def test_common_features_are_counted_by_products(spark, monkeypatch, share, cost, table):
    """However the features are dealt between products and lists, the nearest sets are the same."""
    monkeypatch.setattr(inplace, "COMMON_SHARE", share)
    monkeypatch.setattr(inplace, "ENTRY_COST", cost)
    monkeypatch.setattr(inplace, "TABLE", table)
    rows = token_sets(5)
    sets = {s: [r for r in rows if r[0] == 1 and r[1] and r[2] == s] for s in (True, False)}
    vocabulary = {f: (sum(f in r[4] for r in rows), f) for r in rows for f in r[4]}
    rank = {f: i for i, f in enumerate(sorted(vocabulary, key=vocabulary.get))}

    def side(some, kind):
        features = [sorted(rank[f] for f in r[4]) for r in some]
        return inplace._Sets(pa.array([r[1] for r in some]), np.array([r[3] for r in some]), np.array([len(f) for f in features]), np.array(sum(features, []), dtype=kind))

    made = []
    products = inplace._products
    monkeypatch.setattr(inplace, "_products", lambda *a: made.append(1) or products(*a))
    for ranked, kind in ((True, np.int32), (False, np.int64)):
        test, train = (side(sorted(sets[s], key=lambda r: r[1]), kind) for s in (False, True))
        bounds = np.zeros(len(test.n))
        found = {}
        for _ in range(2):  # the second time with bounds that only the best reach
            for batch in inplace._best(1, test, train, inplace._index(train.features, train.sizes), bounds, ranked):
                for r in batch.to_pylist():
                    found[1, r["test_id"]] = (-r["shared"] / r["either"], r["train_id"], r["shared"], r["either"])
            assert found == brute([r for r in rows if r[0] == 1])
    assert bool(made) == (share < 1)
