import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from splitguard.operators import corpus, extended, gaps, target
from splitguard.sources.evidence import append_evidence, content_hash, evidence, read_evidence


def labelled(make_frame, n, label, dataset="a"):
    return make_frame([(dataset, i, "k", None, None, float(label(i)), "train" if i % 5 else "test") for i in range(n)])


def test_information_of_a_copy_a_part_and_noise(make_frame):
    frame = labelled(make_frame, 1000, lambda i: i // 8 % 4).withColumns(
        {"copy": F.col("label") * 7, "half": F.floor(F.col("label") / 2), "noise": F.lit(0.0), "missing": F.lit(None).cast("double")}
    )
    got = {r.feature: (r.n_rows, r.information) for r in target.mutual_information(frame, ["copy", "half", "noise", "missing"]).collect()}
    assert got.keys() == {"copy", "half", "noise"} and got["copy"] == (800, pytest.approx(1.0))
    assert got["noise"][1] == pytest.approx(0.0, abs=1e-9)
    labels = [i // 8 % 4 for i in range(1000) if i % 5]
    h = -sum(p * math.log(p) for p in (labels.count(c) / 800 for c in range(4)))
    low = sum(c < 2 for c in labels) / 800
    assert got["half"][1] == pytest.approx(-(low * math.log(low) + (1 - low) * math.log(1 - low)) / h)
    leaks = {r.feature: (r.auroc, r.severity) for r in target.target_leaks(frame, ["copy", "half", "noise"]).collect()}
    assert leaks == {"copy": (None, "CRITICAL"), "half": (None, "PASS"), "noise": (None, "PASS")}


def test_information_where_the_label_has_many_values_or_one(make_frame):
    many = labelled(make_frame, 500, lambda i: i * i, "many")
    frame = many.unionByName(labelled(make_frame, 50, lambda i: 3, "one")).withColumns({"rising": F.col("record_id").cast("double"), "bad": F.lit(float("nan"))})
    got = {r.dataset: r for r in target.target_leaks(frame, ["rising", "bad"]).collect()}
    assert got["many"].information == pytest.approx(1.0) and got["many"].severity == "CRITICAL"
    assert got["one"].information is None and got["one"].severity in ("PASS", "SKIPPED")


def test_evidence_rows_of_a_leak(make_frame):
    frame = labelled(make_frame, 200, lambda i: i % 2).withColumns({"same": -F.col("label"), "other": F.floor(F.col("record_id") / 2) % 2})
    leaks = target.target_leaks(frame, ["same", "other"])
    rows = target.leak_evidence(frame, leaks, shown=2).collect()
    assert len(rows) == 4 and {(r.feature, r.value + r.label) for r in rows} == {("same", 0.0)}
    assert target.leak_evidence(frame, target.target_leaks(frame, ["other"])).collect() == []
    assert target.target_leaks(make_frame([]).withColumn("x", F.lit(1.0)), ["x"]).collect() == []


def test_leaks_are_found_once_for_their_evidence(spark, make_frame):
    frame = labelled(make_frame, 200, lambda i: i % 2).withColumn("same", -F.col("label"))
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    leaks = spark.createDataFrame([("a", "same", "CRITICAL")], "dataset string, feature string, severity string").coalesce(1)
    rows = target.leak_evidence(frame, leaks.mapInPandas(counted, leaks.schema), shown=2).collect()
    assert len(rows) == 4 and runs.value == 1


def timed(spark, rows):
    return spark.createDataFrame([("a", e, s, t and datetime.datetime(2024, 1, t, 13)) for e, s, t in rows], "dataset string, group_key string, split string, time timestamp")


def test_gaps_per_entity(spark):
    rows = [("x", "train", d) for d in (1, 1, 2, 9, 10)] + [("x", "test", d) for d in (1, 5, 5, 9, 20)] + [("y", "train", d) for d in (3, 5)]
    rows += [("z", "test", 4), (None, "train", 30), ("x", "train", None), ("x", None, 4)]
    frame = timed(spark, rows)
    got = [(r.entity, r.last_day.day, r.next_day.day, r.gap_days, r.n_test_inside) for r in gaps.train_gaps(frame, 2).collect()]
    assert got == [("x", 2, 9, 7, 2)]
    r = gaps.gap_check(frame, 2).first()
    assert (r.n_entities, r.n_gaps, r.longest_days, r.n_test_inside, r.severity) == (2, 1, 7, 2, "MEDIUM") and r.measured == pytest.approx(7 / 11)
    assert gaps.gap_check(timed(spark, [("y", "train", 3), ("y", "train", 5)]), 1).first().severity == "LOW"
    assert gaps.gap_check(timed(spark, [("y", "train", 3)]), 1).first().severity == "PASS"
    assert gaps.gap_check(timed(spark, [("y", "test", 3)]), 1).collect() == []


def plain_hits(items, texts, width, window):
    out = {}
    for i, item in items:
        words = (item or "").lower().split()
        k = min(width, len(words))
        for t, text in texts:
            other = (text or "").lower().split()
            there = {tuple(other[p : p + width]) for p in range(max(len(other) - width + 1, 1))}
            starts = [p for p in range(max(len(words) - width + 1, 1)) if words and tuple(words[p : p + width]) in there]
            stretches = []
            for p in starts:
                if not stretches or p - stretches[-1][-1] > k + window:
                    stretches.append([])
                stretches[-1].append(p)
            if stretches:
                first, matched = min(((-(s[-1] + k - s[0]), s[0], s) for s in stretches))[1:]
                span = matched[-1] + k - first
                covered = {w for p in matched for w in range(p, p + k)}
                if len(covered) / span >= 0.8 and span / len(words) >= 0.9:
                    out[i, t] = (first + 1, first + span, len(covered) / span, span / len(words))
    return out


@pytest.mark.parametrize("broadcast_runs", [500_000, 0])
def test_corpus_hits_against_all_pairs(spark, broadcast_runs):
    rng = random.Random(4)
    passage = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n)]
    items = [(i, passage(rng.choice([2, 5, 20, 60]))) for i in range(30)] + [(90, []), (91, ["a", "a", "a", "a", "a", "a", "a"])]
    texts = []
    for t in range(60):
        body = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 1, 3, 8])):
            if body:
                body[rng.randrange(len(body))] = "changed"
        cut = rng.choice([0, 0, 1, 4])
        texts.append((t, " ".join(passage(10) + body[cut:] + passage(10))))
    texts += [(100, None), (101, ""), (102, "a a a a a a a a a a"), (103, " ".join(items[0][1]).upper())]
    items = [(i, "\n ".join(w)) for i, w in items] + [(95, None), (96, " \t")]
    item_rows = spark.createDataFrame(items, "item_id long, text string")
    found = corpus.corpus_hits(item_rows, spark.createDataFrame(texts, "doc_id long, text string").repartition(4), "item_id", "doc_id", 4, 3, broadcast_runs=broadcast_runs)
    got = {(r.item_id, r.doc_id): (r.first_word, r.last_word, pytest.approx(r.overlap), pytest.approx(r.coverage)) for r in found.collect()}
    assert got == plain_hits(items, texts, 4, 3) and 10 < len(got) < 100
    per = {r.item_id: (r.n_texts, r.severity) for r in corpus.corpus_contamination(item_rows, found, "item_id").collect()}
    assert len(per) == len(items) and per[95] == per[96] == (0, "PASS")
    assert sum(n for n, _ in per.values()) == len(got)


def test_a_store_keeps_one_row_per_finding(spark, make_frame, tmp_path):
    frame = make_frame([("a", i, f"k{i % 7}", "g", None, 0.0, "train" if i % 2 else "test") for i in range(20)])
    checks = lambda f: {"duplicates": (extended.duplicate_severity(f), "share", 0.0), "confound": (extended.confound_check(f.withColumn("batch", F.lit("one"))), "V", None)}
    inputs = lambda f: f.groupBy("dataset").agg(content_hash(f, "record_id", "key", "split").alias("input_hash"))
    path, run = str(tmp_path / "store"), lambda f, s: evidence(checks(f), inputs(f), extended.settings_hash(s))
    assert read_evidence(spark, path) is None
    first = append_evidence(run(frame, {"seed": 1}), path).collect()
    again = append_evidence(run(frame.repartition(7), {"seed": 1}), path).collect()
    assert sorted(first) == sorted(again) and {(r.check, r.severity) for r in first} == {("duplicates", "CRITICAL"), ("confound", "SKIPPED")}
    assert {r.evidence for r in first if r.check == "duplicates"} == {'{"n_test":10,"n_flagged":10}'}
    other = append_evidence(run(frame, {"seed": 2}), path).collect()
    assert len(other) == 4 and {r.finding_id for r in first} < {r.finding_id for r in other}
    changed = append_evidence(run(frame.filter("record_id <> 3"), {"seed": 1}), path).collect()
    assert len(changed) == len({r.finding_id for r in changed}) == 6
