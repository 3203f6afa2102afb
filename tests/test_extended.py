import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.operators import extended
from splitguard.operators.order_stats import exact_percentiles
from splitguard.sources.readers import read_table


def test_copied_records_of_a_key_that_most_rows_hold(make_frame):
    split = lambda i: "test" if i % 3 == 0 else "train"
    rows = [("a", i, "hot" if i % 5 else f"k{i // 10}", None, [], 0.0, split(i)) for i in range(3000)]
    rows += [("b", i, None, None, [], 0.0, split(i)) for i in range(6)]
    first, count = {}, {}
    for d, i, key, *_, side in rows:
        if side == "train" and key is not None:
            first[d, key] = min(first.get((d, key), i), i)
            count[d, key] = count.get((d, key), 0) + 1
    want = {(d, i, key, first[d, key], count[d, key]) for d, i, key, *_, side in rows if side == "test" and (d, key) in first}
    got = [(r.dataset, r.test_id, r.key, r.train_id, r.n_train_copies) for r in extended.copied_records(make_frame(rows)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert extended.copied_records(make_frame(rows).limit(0)).count() == 0


def test_copied_records_pair_with_the_first_train_row(make_frame):
    rows = [("a", i, "k", "g", None, 0.0, "train" if i < 50 else "test") for i in range(1, 100)] + [("a", 200, None, "g", None, 0.0, s) for s in ("train", "test")]
    got = extended.copied_records(make_frame(rows)).collect()
    assert len(got) == 50 and {(r.train_id, r.n_train_copies) for r in got} == {(1, 49)}
    r = extended.duplicate_severity(make_frame(rows)).first()
    assert (r.n_test, r.n_flagged, r.severity) == (51, 50, "CRITICAL")


def test_temporal(make_frame):
    day = lambda n: datetime.datetime(2020, 1, n)
    frame = make_frame([("a", 1, "k", "g", None, 0.0, "train"), ("a", 2, "k", "g", None, 0.0, "test"), ("b", 1, "k", "g", None, 0.0, "train"), ("b", 2, "k", "g", None, 0.0, "test"), ("c", 1, "k", "g", None, 0.0, "train")])
    times = frame.withColumn("time", F.when(F.col("split") == "train", F.lit(day(5))).when(F.col("dataset") == "a", F.lit(day(3))).otherwise(F.lit(day(9))))
    got = {r.dataset: (r.n_flagged, r.severity) for r in extended.temporal_check(times).collect()}
    assert got == {"a": (1, "HIGH"), "b": (0, "PASS"), "c": (0, "SKIPPED")}


def test_confound_from_none_to_full(make_frame):
    rows = [("a", i, "k", None, None, float(i % 2), "train") for i in range(40)]
    frame = make_frame(rows)
    at = lambda c: extended.confound_check(frame.withColumn("batch", c)).first()
    full, none, one = at(F.col("label")), at(F.floor(F.col("record_id") / 2) % 2), at(F.lit("x"))
    assert full.measured == pytest.approx(1.0) and full.severity == "HIGH"
    assert none.measured == pytest.approx(0.0, abs=1e-6) and none.severity == "PASS"
    assert one.measured is None and one.severity == "SKIPPED"


def test_feature_that_is_the_label(make_frame):
    frame = make_frame([("a", i, "k", None, None, float(i % 2), "train") for i in range(40)])
    frame = frame.withColumns({"same": -F.col("label"), "other": F.col("record_id").cast("double"), "constant": F.lit(3)})
    got = {r.feature: r for r in extended.feature_leaks(frame, ["same", "other", "constant"]).collect()}
    assert got["same"].measured == 1.0 and got["same"].severity == "HIGH"
    assert got["other"].severity == got["constant"].severity == "PASS"


def test_features_are_counted_per_value_before_they_are_scaled(make_frame):
    frame = make_frame([("a", i, "k", None, None, float(i % 2), "train") for i in range(40)] + [(None, 50, "k", None, None, 1.0, "train")])
    frame = frame.withColumns({"low": F.col("record_id") % 3 - 1.0, "bad": F.when(F.col("record_id") > 2, float("nan")).otherwise(F.lit(1.0))})
    found = extended.feature_leaks(frame, ["low", "bad"])
    # What scales and ranks starts from the counts: no row with its features is joined or shuffled there.
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.dataset, r.feature): (r.measured, r.severity) for r in found.collect()}
    rows = [(i % 3, i % 2) for i in range(40)]
    ones, zeros = [x for x, y in rows if y], [x for x, y in rows if not y]
    won = sum((p > n) + (p == n) / 2 for p in ones for n in zeros) / len(ones) / len(zeros)
    assert got.keys() == {("a", "low"), ("a", "bad")} and got["a", "low"] == (pytest.approx(max(won, 1 - won)), "PASS")


def test_companion_split_and_roll_up(spark, make_frame):
    frame = make_frame([("a", i, "k", "g", None, 0.0, None) for i in range(5)])
    listed = spark.createDataFrame([(0, "train"), (1, "test"), (1, "test"), (2, "train"), (2, "test")], "record_id long, split string")
    out, counts = extended.with_companion_split(frame, listed)
    assert tuple(counts.first()) == (5, 2, 2, 1)
    assert {r.record_id: r.split for r in out.collect()} == {0: "train", 1: "test", 2: None, 3: None, 4: None}
    found = extended.findings({"groups": extended.group_severity(out.fillna("test", ["split"])), "dup": extended.duplicate_severity(out)})
    r = extended.roll_up(found).first()
    assert (r.n_findings, r.worst, r.failed) == (2, "CRITICAL", "dup,groups")


def test_moments_of_a_copy_are_equal(make_frame):
    rows = [("a", i, "k", None, None, 0.0, s) for i in range(4) for s in ("train", "test")]
    got = extended.moment_check(make_frame(rows), ["record_id"]).first()
    assert got.mean_all == got.mean_test == 1.5 and got.p50_all == got.p50_test == 1.5 and got.severity == "PASS"
    alone = extended.moment_check(make_frame([r for r in rows if r[6] == "test"]), ["record_id"]).first()
    assert alone.std_all == alone.std_test == pytest.approx(1.2909944487358056) and alone.severity == "MEDIUM"
    one = extended.moment_check(make_frame(rows[:1]), ["record_id"]).first()
    assert one.mean_all == 0.0 and one.mean_test is None and one.severity == "SKIPPED"


def test_moments_do_not_depend_on_the_order_of_rows(spark, make_frame):
    rng = random.Random(3)
    frame = make_frame([("a", i, "k", None, None, 0.0, rng.choice(["train", "test"])) for i in range(3000)])
    frame = frame.withColumn("price", F.round(F.rand(5) * 1e5, 2) + 1e9)
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    one, two = (extended.moment_check(f, ["price"]).first() for f in (frame.repartition(1), frame.repartition(13)))
    assert one == two


@pytest.mark.parametrize("slots", [100, 2048])
def test_percentiles_are_exact(spark, slots):
    rng = np.random.default_rng(slots)
    groups = {
        "normal": rng.standard_normal(500), "ties": rng.integers(0, 4, 300).astype(float), "heavy": np.exp(rng.standard_normal(400) * 30),
        "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), "same": np.full(50, 7.0), "wide": np.array([-1.7e308, 0.0, 1.0, 1.7e308]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan")), ("none", None)]
    shares = {"least": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, value double").repartition(3), ["g"], shares, slots).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, share in shares.items():
            values = np.sort(values)
            place = (len(values) - 1) * share
            a, b = values[int(np.floor(place))], values[int(np.ceil(place))]
            assert got[g][name] == a + (b - a) * (place - np.floor(place))


def test_settings_hash_ignores_order():
    assert extended.settings_hash({"a": 1, "b": 2}) == extended.settings_hash({"b": 2, "a": 1}) != extended.settings_hash({"a": 1})


def test_fasta_and_tsv(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a one\nACGT\nAC>T\n>b\n\n>c two words\r\nTT\r\n")
    got = sorted((r.name, r.description, r.sequence) for r in read_table(spark, str(tmp_path / "x.fasta")).collect())
    assert got == [("a", "one", "ACGTAC>T"), ("b", "", ""), ("c", "two words", "TT")]
    (tmp_path / "x.tsv").write_text("a\tb\n1\tx,y\n")
    assert read_table(spark, str(tmp_path / "x.tsv"), id_col="a").first().b == "x,y"
