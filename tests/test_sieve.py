"""What is sent to be looked up or compared: no feature is lost, few are sent for nothing, no set once per class of sizes."""

import random

from pyspark.sql import functions as F

from splitguard.operators.blocks import _ranges_of_sizes
from splitguard.operators.sieve import sieved

SETS = "part long, id string, in_train boolean, n int, feats array<bigint>"


def test_the_sieve_loses_no_feature_and_drops_nearly_all_others(spark):
    rng = random.Random(4)
    known = sorted({rng.randrange(-(2**63), 2**63) for _ in range(300)})
    sets = [(1, f"r{i}", i % 2 == 0, 45, sorted({rng.randrange(-(2**63), 2**63) for _ in range(40)} | set(rng.sample(known, i % 5)))) for i in range(80)]
    table = spark.createDataFrame([(f, 1) for f in known], "feature long, w long")
    frame = spark.createDataFrame(sets, SETS).repartition(3)
    got = {r["id"]: r for r in sieved(frame, table, "w").collect()}
    for part, name, in_train, n, feats in sets:
        wanted = set(feats) & set(known)
        held = set(got[name]["feats"]) if name in got else set()
        assert wanted <= held <= set(feats)
        assert name not in got or (got[name]["part"], got[name]["in_train"], got[name]["n"]) == (part, in_train, n)
    assert sum(len(r["feats"]) for r in got.values()) < 300
    assert {r["id"] for r in sieved(frame, table, "w", most_bits=6).collect()} >= got.keys()
    # No features at all, and a table that holds most of them.
    assert sieved(frame, table.limit(0), "w").count() == 0
    assert sieved(frame.limit(0), table, "w").count() == 0
    assert sieved(frame, table.withColumn("w", F.lit(1000)), "w").count() == len(sets)


def test_neighbouring_classes_of_sizes_share_a_range(spark):
    rows = [(p, c, [0] * n) for p, sizes in ((1, [30, 30, 30, 400_000, 20]), (2, [7])) for c, n in enumerate(sizes)]
    held = spark.createDataFrame(rows, "part long, size_class int, features array<int>")
    got = sorted((r.part, r.low, r.high, r.cells) for r in _ranges_of_sizes(held, 1_000_000).collect())
    assert got == [(1, 0, 3, 2), (1, 4, 4, 1), (2, 0, 0, 1)]
    small = sorted((r.part, r.low, r.high, r.cells) for r in _ranges_of_sizes(held.filter("part = 1"), 60).collect())
    assert small == [(1, 0, 1, 1), (1, 2, 3, 6668), (1, 4, 4, 1)]


def test_labels_meet_the_texts_in_a_broadcast(spark, tmp_path):
    from splitguard.catalog.frames import labelled_documents

    spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1), (3, 0), (9, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    by_broadcast, by_shuffle = (labelled_documents(spark, str(tmp_path), k) for k in (4, 3))
    assert sorted(map(str, by_broadcast.collect())) == sorted(map(str, by_shuffle.collect())) and by_broadcast.count() == 31
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [f.filter("quality IS NOT NULL")._jdf.queryExecution().executedPlan().toString() for f in (labelled_documents(spark, str(tmp_path), k) for k in (4, 3))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
