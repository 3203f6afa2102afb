import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.operators.duplicates import duplicate_check, leaked_rows
from splitguard.operators.groups import group_check, groups_only_in_test, shared_groups, sides_disjoint
from splitguard.operators.scoring import auroc, r_squared
from splitguard.operators.verdict import low_confidence, verdict
from splitguard.plans.checks import audit, collapse_bars, fix_split
from splitguard.sources.writers import report_json


def row(i, key, split, group=None, label=0.0, dataset="a"):
    return (dataset, i, key, group, key.split(), label, split)


def test_duplicates_keep_test_multiplicity(make_frame):
    rows = [row(1, "x", "train"), row(2, "x", "train"), row(3, "x", "test"), row(4, "x", "test"), row(5, "y", "test")]
    frame = make_frame(rows)
    r = duplicate_check(frame).first()
    assert (r.n_test, r.n_leaked) == (3, 2)
    assert r.duplicates_message.startswith("2 of 3 test records (66.7%)")
    assert {x.record_id for x in leaked_rows(frame).collect()} == {3, 4}
    none = duplicate_check(make_frame([row(1, "x", "train")])).first()
    assert (none.n_test, none.n_leaked, none.fraction_leaked) == (0, 0, 0.0)


def test_group_overlap(make_frame):
    rows = [
        row(1, "a", "train", "g"), row(2, "b", "train", ""), row(3, "c", "test", "g"), row(4, "d", "test", ""),
        row(5, "e", "test", "h"), row(6, "f", "test", None), row(7, "g", "train", None),
    ]
    frame = make_frame(rows)
    r = group_check(frame).first()
    assert (r.n_test_groups, r.n_shared) == (3, 2)
    assert {x.group_key for x in shared_groups(frame).collect()} == {"g", ""}
    assert {x.group_key for x in groups_only_in_test(frame).collect()} == {"h"}
    assert not sides_disjoint(frame)


@pytest.mark.parametrize("distinct", [3, 40, 10_000])
def test_auroc_equals_counting_pairs(spark, distinct):
    rng = random.Random(distinct)
    data = [("a", float(rng.randrange(2)), rng.randrange(distinct + 1) / distinct) for _ in range(300)]
    pos, neg = [s for _, y, s in data if y == 1], [s for _, y, s in data if y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    got = auroc(spark.createDataFrame(data, "dataset string, label double, score double")).first().auroc
    assert abs(got - want) < 1e-12


def test_auroc_of_one_class_is_undefined(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.3)], "dataset string, label double, score double")
    assert auroc(frame).first().auroc is None


def test_r_squared(spark):
    def r2(pairs):
        return spark.createDataFrame(pairs, "y double, p double").agg(r_squared("y", "p")).first()[0]

    assert abs(r2([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)]) - (1 - 1.25 / (14 / 3))) < 1e-12
    assert r2([(2.0, 2.0), (2.0, 2.0)]) == 1.0
    assert r2([(2.0, 2.0), (2.0, 3.0)]) == 0.0
    assert r2([(2.0, 2.0)]) is None


@pytest.mark.parametrize(
    "dup, n_leaked, sim, group, metric, score, want",
    [
        (0.0, 0, 0.0, 0.0, "AUROC", 0.5, "CLEAN"),
        (0.05, 5, 0.0, 0.0, "AUROC", 0.5, "SUSPECT"),
        (0.051, 5, 0.0, 0.0, "AUROC", 0.5, "LEAKING"),
        (0.0, 0, 0.5, 0.5, "AUROC", 0.65, "CLEAN"),
        (0.0, 0, 0.51, 0.0, "AUROC", 0.5, "SUSPECT"),
        (0.0, 0, 0.0, 0.51, "AUROC", 0.5, "SUSPECT"),
        (0.0, 0, 0.0, 0.0, "AUROC", 0.85, "SUSPECT"),
        (0.0, 0, 0.0, 0.0, "AUROC", 0.86, "LEAKING"),
        (0.0, 0, 0.0, 0.0, "R2", 0.4, "CLEAN"),
        (0.0, 0, 0.0, 0.0, "R2", 0.7, "SUSPECT"),
        (0.0, 0, 0.0, 0.0, "R2", 0.71, "LEAKING"),
        (0.0, 0, 1.0, 1.0, "AUROC", None, "SUSPECT"),
        (0.0, 0, 0.0, 0.0, "AUROC", None, "CLEAN"),
        (0.0, 0, 0.0, 0.0, "AUROC", float("nan"), "CLEAN"),
    ],
)
def test_verdict_limits_are_strict_and_undefined_never_triggers(spark, dup, n_leaked, sim, group, metric, score, want):
    facts = spark.createDataFrame(
        [(dup, n_leaked, sim, group, metric, score)],
        "fraction_leaked double, n_leaked int, fraction_above_0_8 double, fraction_shared double, metric_name string, score double",
    )
    assert facts.select(verdict()).first()[0] == want


def test_low_confidence_below_fifty(spark):
    flags = [spark.sql(f"SELECT {a} n_train, {b} n_test").select(low_confidence()).first()[0] for a, b in ((49, 99), (99, 49), (50, 50))]
    assert flags == [True, True, False]


def rounded(r):
    """Averages depend on summation order in the last digits."""
    return {k: round(v, 12) if isinstance(v, float) else v for k, v in r.asDict().items()}


def words(rng, n, vocabulary):
    return " ".join(sorted({f"w{rng.randrange(vocabulary)}" for _ in range(n)}))


def test_test_that_copies_train_leaks(make_frame):
    rng = random.Random(1)
    keys = [words(rng, 10, 500) for _ in range(24)]
    rows = [row(i, k, "train", label=float(i % 2)) for i, k in enumerate(keys)]
    rows += [row(100 + i, k, "test", label=float(i % 2)) for i, k in enumerate(keys)]
    r = audit(make_frame(rows)).first()
    assert (r.verdict, r.fraction_leaked, r.low_confidence) == ("LEAKING", 1.0, True)
    assert r.score >= 0.95 and r.summary.startswith("LOW CONFIDENCE")


def test_similar_records_with_random_labels_do_not_leak(make_frame):
    rng = random.Random(0)
    base = [f"c{i}" for i in range(20)]
    rows = [
        row(i, " ".join(base + [f"u{i}"]), "test" if i % 5 == 0 else "train", label=float(rng.randrange(2)))
        for i in range(300)
    ]
    frame = make_frame(rows)
    r = audit(frame).first()
    assert r.verdict == "SUSPECT" and r.fraction_above_0_8 == 1.0 and r.score < 0.75
    assert rounded(audit(make_frame(rows[::-1]).repartition(9)).first()) == rounded(r)


def test_one_class_in_test_is_inconclusive(make_frame):
    rng = random.Random(2)
    rows = [row(i, words(rng, 8, 300), "train", label=float(i % 2)) for i in range(27)]
    rows += [row(50 + i, words(rng, 8, 300), "test", label=1.0) for i in range(6)]
    r = audit(make_frame(rows)).first()
    assert r.metric_name == "AUROC" and r.score is None and r.verdict != "LEAKING"
    assert "inconclusive" in r.baseline_message


def test_audit_without_test_or_without_train(make_frame):
    rows = [row(1, "a b", "train", dataset="tr"), row(2, "c", "train", label=1.0, dataset="tr")]
    rows += [row(1, "a b", "test", dataset="te"), row(2, "c", "test", label=1.0, dataset="te")]
    found = {r.dataset: r for r in audit(make_frame(rows)).collect()}
    only_train, only_test = found["tr"], found["te"]
    assert (only_train.n_test, only_train.n_measured, only_train.fraction_leaked, only_train.score) == (0, 0, 0.0, None)
    assert (only_test.n_train, only_test.n_measured, only_test.nn_mean) == (0, 0, 0.0)


def test_several_data_sets_do_not_mix(make_frame):
    rng = random.Random(6)
    rows = []
    for d in ("p", "q"):
        keys = [words(rng, 6, 40) for _ in range(60)]
        rows += [row(i, k, "test" if i % 4 == 0 else "train", f"g{i % 9}", float(i % 2), d) for i, k in enumerate(keys)]
    both = {r.dataset: r for r in audit(make_frame(rows)).collect()}
    alone = audit(make_frame([r for r in rows if r[0] == "q"])).first()
    assert len(both) == 2 and rounded(alone) == rounded(both["q"])


def test_fix_makes_groups_disjoint_and_reports_both_scores(make_frame):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        fam = i % 10
        rows.append(row(i, " ".join([f"f{fam}w{j}" for j in range(30)] + [words(rng, 3, 50)]), "test" if i % 7 == 0 else "train", f"fam{fam}", float(fam % 2)))
    fixed = fix_split(make_frame(rows))
    r = fixed.report.first()
    assert sides_disjoint(fixed.rows) and fixed.rows.count() == 200
    assert r.score_before > 0.95 and r.improved and (r.n_train, r.n_test) == (160, 40)
    bars = {b.bar: b for b in collapse_bars(fixed.report).collect()}
    assert bars["before"].hot and bars["before"].height > 90
    assert audit(fixed.rows).first().n_shared == 0


def test_report_json_holds_all_checks(make_frame, spark):
    rows = [row(i, f"a b{i % 3}", "test" if i % 2 else "train", "g", float(i % 2)) for i in range(10)]
    text = report_json(audit(make_frame(rows))).first().report
    parsed = spark.createDataFrame([(text,)], "t string").select(
        F.get_json_object("t", "$.verdict"), F.get_json_object("t", "$.checks.similarity.mean"),
        F.get_json_object("t", "$.checks.baseline.metric_name"), F.get_json_object("t", "$.checks.groups.n_shared"),
    ).first()
    assert all(v is not None for v in parsed)
