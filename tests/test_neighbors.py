import random

import pytest
from pyspark.sql import functions as F

from splitguard.operators import neighbors as nb
from splitguard.operators.blocks import best_in_blocks
from splitguard.operators.neighbors import nearest_neighbors, similarity_check, similarity_histogram


def row(record_id, features, split, label=0.0, dataset="a"):
    return (dataset, record_id, None, None, features, label, split)


def brute(rows):
    """(similarity, nn_id, nn_label, measured) per test row, by comparing all pairs."""
    out = {}
    for d, i, _, _, feats, _, split in rows:
        if split != "test":
            continue
        train = sorted((r for r in rows if r[0] == d and r[6] == "train"), key=lambda r: r[1])
        best = (0.0, train[0][1] if train else None, train[0][5] if train else 0.0)
        for r in train:
            if feats is None or r[4] is None:
                continue
            both, either = len(set(feats) & set(r[4])), len(set(feats) | set(r[4]))
            j = both / either if either else 0.0
            if j > best[0]:
                best = (j, r[1], r[5])
        out[d, i] = (*best, feats is not None and bool(train))
    return out


def check(make_frame, rows, **options):
    shuffled = list(rows)
    random.Random(5).shuffle(shuffled)
    got = {
        (r.dataset, r.record_id): (r.similarity, r.nn_id, r.nn_label, r.measured)
        for r in nearest_neighbors(make_frame(shuffled).repartition(5), **options).collect()
    }
    want = brute(rows)
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]


def random_rows(seed, n, vocabulary, longest, dataset="a", start=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(0, longest)
        feats = list({f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(size)})
        rows.append(row(start + i, feats, rng.choice(["train", "train", "test"]), float(rng.randrange(2)), dataset))
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 3, "seed_features": 1}, {"block_share": 0.0, "seed_features": 1}, {"block_share": 1e9}])
def test_random_sets_in_several_data_sets(make_frame, options):
    rows = random_rows(1, 150, 30, 12) + random_rows(2, 150, 400, 40, "b") + random_rows(3, 120, 6, 5, "c")
    check(make_frame, rows, **options)


def test_edge_cases(make_frame):
    rows = [
        row(1, ["x", "y"], "train", 1.0),
        row(2, ["y", "x"], "train", 0.0),  # equal set, later id: never the first choice
        row(3, ["p", "q"], "train", 0.0),
        row(4, [], "train", 1.0),
        row(5, None, "train", 1.0),
        row(10, ["x", "y"], "test"),  # settled by equality, tie on id
        row(11, ["zzz"], "test"),  # shares nothing: first train row, similarity 0
        row(12, [], "test"),  # empty set: similarity 0
        row(13, None, "test"),  # no features: not measured
        row(14, ["x", "p"], "test"),  # ties between sets
        row(20, ["x"], "test", 0.0, "only_test"),  # no train at all
        row(21, ["x"], "train", 0.0, "only_train"),
    ]
    check(make_frame, rows)


def test_copies_that_hold_a_third_of_all_rows(make_frame):
    """A third of train and of test are copies of one set, and everyone shares hot features."""
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(8)]
    rows = []
    for i in range(600):
        side = "test" if i % 4 == 0 else "train"
        feats = hot if i % 3 == 0 else hot[: rng.randrange(1, 8)] + [f"u{rng.randrange(80)}" for _ in range(6)]
        rows.append(row(i, list(dict.fromkeys(feats)), side, float(i % 2)))
    check(make_frame, rows, cell_rows=20)


def test_near_copies_from_one_template(make_frame):
    """All rows share a long boilerplate; what differs is unique to the row."""
    boiler = [f"b{i}" for i in range(30)]
    rows = [row(i, boiler + [f"r{i}-{j}" for j in range(5)], "test" if i % 5 == 0 else "train", float(i % 2)) for i in range(200)]
    check(make_frame, rows, cell_rows=10)


def test_template_rows_do_not_meet_in_pairs(make_frame):
    """Every record shares 30 features with every other; no pair may leave the join for it."""
    boiler = [f"b{i}" for i in range(30)]
    rows = [row(i, boiler + [f"r{i}-{j}" for j in range(5)], "test" if i % 5 == 0 else "train") for i in range(300)]
    sets = nb._distinct_sets(nb._hashed_rows(make_frame(rows), ("dataset",)))
    ordered = nb._ordered_sets(sets, nb.CELL_ROWS)
    test, train = ordered.filter("NOT in_train").drop("in_train"), ordered.filter("in_train").drop("in_train")
    bounds = nb._best(nb._verify(nb._seed_pairs(test, train, nb.SEED_FEATURES), test, train))
    assert bounds.count() == 60
    assert nb._winning_pairs(test, train, bounds).count() == 0


def test_result_does_not_depend_on_partitions(make_frame, spark):
    rows = random_rows(4, 200, 60, 20)
    one = nearest_neighbors(make_frame(rows).coalesce(1)).orderBy("record_id").collect()
    many = nearest_neighbors(make_frame(rows[::-1]).repartition(11)).orderBy("record_id").collect()
    assert one == many


def test_summary_and_histogram(spark):
    nn = spark.createDataFrame(
        [("a", i, 0.0, s, 0, 0.0, m) for i, (s, m) in enumerate([(1.0, True), (0.8, True), (0.81, True), (0.05, True), (0.9, False)])],
        "dataset string, record_id long, label double, similarity double, nn_id long, nn_label double, measured boolean",
    )
    s = similarity_check(nn).first()
    assert (s.n_measured, round(s.nn_mean, 6), s.fraction_above_0_8) == (4, 0.665, 0.5)
    bins = {r.bin: (r.n_rows, r.height) for r in similarity_histogram(nn).collect()}
    assert len(bins) == 10
    assert bins[0] == (1, 50) and bins[8] == (2, 100) and bins[9] == (1, 50) and bins[5] == (0, 0)
    assert similarity_check(nn.filter(~F.col("measured"))).first().nn_mean == 0.0


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr("splitguard.operators.blocks.COUNTERS", 40)
    rng = random.Random(9)
    sets = {side: {i: {rng.randrange(60) for _ in range(rng.randrange(1, 30))} for i in range(60)} for side in ("test", "train")}
    sets["train"][7] = sets["train"][3]  # a tie: the smaller id is returned
    kind = "part long, id long, n int, features array<struct<cost: double, feature: long>>"
    test, train = (spark.createDataFrame([(1, i, len(s) + 2, [(0.0, f) for f in s]) for i, s in sets[side].items()], kind) for side in ("test", "train"))
    jaccard = lambda a, b: (len(a & b), len(a) + len(b) + 4 - len(a & b))
    start = {i: jaccard(s, sets["train"][3]) for i, s in sets["test"].items()}
    start = {i: (c, e) for i, (c, e) in start.items() if c}
    bounds = spark.createDataFrame([(1, i, 3, c, e) for i, (c, e) in start.items()], "part long, test_id long, train_id long, shared int, either int")
    for cell_features in (50, 1_000_000):
        found = {}
        for r in best_in_blocks(test, train, bounds, cell_features).collect():
            assert (r.shared, r.either) == jaccard(sets["test"][r.test_id], sets["train"][r.train_id])
            found[r.test_id] = min(found.get(r.test_id, (0.0, 0)), (-r.shared / r.either, r.train_id))
        want = {}
        for i in start:
            c, j = max(((jaccard(sets["test"][i], t), -j) for j, t in sets["train"].items()), key=lambda x: (x[0][0] / x[0][1], x[1]))
            want[i] = (-c[0] / c[1], -j)
        assert found == want
    assert best_in_blocks(test, train.limit(0), bounds).count() == 0
    assert best_in_blocks(test.limit(0), train, bounds).count() == 0


def test_shared_sizes_against_plain_python(spark):
    """Every pair of sets, in one cell and in many, with an id that two sets have."""
    from splitguard.operators.blocks import shared_sizes

    def ordered(sets):
        rows = [(1, i, len(s), [(0.0, f) for f in sorted(s)]) for i, s in sets]
        return spark.createDataFrame(rows, "part long, id long, n int, features array<struct<cost: double, feature: long>>")

    train = [(i, {f for f in range(40) if (f * 7 + i) % (i % 5 + 2) == 0}) for i in range(30)] + [(3, {100, 101, 102})]
    test = [(i, {f for f in range(40) if (f * 3 + i) % (i % 4 + 2) == 0}) for i in range(100, 112)] + [(112, set(range(200, 205)))]
    pairs = spark.createDataFrame([(1, t, r) for t, _ in test for r in range(30)], "part long, test_id long, train_id long")
    want = sorted((t, r, len(a & b), len(a | b)) for t, a in test for r, b in train)
    for size in (10, 1_000_000):
        got = shared_sizes(pairs, ordered(test), ordered(train), cell_features=size).collect()
        assert sorted((g["test_id"], g["train_id"], g["shared"], g["either"]) for g in got) == want


def test_sets_do_not_travel_with_pairs_and_seeds_are_few(spark):
    """What is compared for a bound does not grow with the seed features, and no join carries the sets of both sides."""
    from splitguard.operators import neighbors as nb

    rows = [("d", i, float(i % 2), "test" if i < 5 else "train", [f"w{(i * 3 + k) % 90}" for k in range(30)] + [f"own{i}"]) for i in range(120)]
    frame = spark.createDataFrame(rows, "dataset string, record_id long, label double, split string, features array<string>")
    ordered = nb._ordered_sets(nb._distinct_sets(nb._hashed_rows(frame, ("dataset",))), nb.CELL_ROWS)
    test, train = ordered.filter("NOT in_train").drop("in_train"), ordered.filter("in_train").drop("in_train")
    pairs = nb._seed_pairs(test, train, nb.SEED_FEATURES)
    counts = [r["count"] for r in pairs.groupBy("test_id").count().collect()]
    assert len(counts) == 5 and max(counts) <= nb.SEED_PAIRS
    assert pairs.count() == pairs.distinct().count()
    assert "array_intersect" not in nb._verify(pairs, test, train)._jdf.queryExecution().toString()


def test_sets_with_many_entries_to_look_through_go_to_blocks(spark):
    features = "array<struct<cost:double,feature:long,test_cells:int,n_train:long>>"
    lists = {1: (15, 15), 2: (3, 3)}
    tests = [(7, k, 2, 0, [(1.0, 10 * k + i, 1, n) for i, n in enumerate(each)]) for k, each in lists.items()]
    test = spark.createDataFrame(tests, f"part long, id long, n int, front int, features {features}")
    train = spark.createDataFrame([(7, 100 + i) for i in range(100)], "part long, id long")
    bounds = spark.createDataFrame([(7, k, 100, 1, 3) for k in lists], "part long, test_id long, train_id long, shared int, either int")
    # Entries that leave a join are shuffled, so a tenth of the train sets is enough to compare with all of them in blocks.
    routed = nb._routed(bounds, test, train, nb.BLOCK_SHARE)
    assert {r.test_id: r.by_blocks for r in routed.collect()} == {1: True, 2: False}
