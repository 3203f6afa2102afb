import gzip
from pathlib import Path

import pytest

from splitguard.operators.prepare import prepare
from splitguard.plans.checks import audit_table, fix_table
from splitguard.plans.sweep import Source, probe, sweep
from splitguard.sources.readers import read_table
from splitguard.sources.writers import write_reports, write_split

# The two hand-made tables of ten rows; group is the ring core noted by hand.
LEAKY = [
    ("CCO", 1, "train", ""), ("CCOC", 1, "train", ""), ("CCOCC", 1, "train", ""), ("c1ccccc1", 0, "train", "benzene"),
    ("c1ccccc1C", 0, "train", "benzene"), ("c1ccccc1CC", 0, "train", "benzene"), ("CCO", 1, "test", ""),
    ("c1ccccc1", 0, "test", "benzene"), ("CCOC", 1, "test", ""), ("c1ccccc1C", 0, "test", "benzene"),
]
CLEAN = [
    ("CCO", 1, "train", ""), ("CCN", 1, "train", ""), ("CCC", 0, "train", ""), ("c1ccccc1", 0, "train", "benzene"),
    ("CC(=O)O", 1, "train", ""), ("CCBr", 0, "train", ""), ("C1CCCCC1", 0, "test", "cyclohexane"),
    ("c1ccncc1", 1, "test", "pyridine"), ("CC(C)CO", 1, "test", ""), ("ClCCl", 0, "test", ""),
]


@pytest.fixture
def files(tmp_path):
    def write(name, rows):
        text = "smiles,label,split,core\n" + "".join(",".join(map(str, r)) + "\n" for r in rows)
        path = tmp_path / name
        if name.endswith(".gz"):
            with gzip.open(path, "wt") as f:
                f.write(text)
        else:
            path.write_text(text)
        return str(path)

    return write


def test_known_answers_of_the_small_tables(spark, files):
    from pyspark.sql import functions as F

    group = F.coalesce("core", F.lit(""))
    leaky, notes = audit_table(spark, files("leaky.csv", LEAKY), group_key=group)
    r = leaky.first()
    assert (r.verdict, r.n_leaked, r.n_test, r.n_shared, r.n_test_groups, r.low_confidence) == ("LEAKING", 4, 4, 2, 2, True)
    assert r.score == 1.0 and notes.first().key_col == "smiles"
    c = audit_table(spark, files("clean.csv", CLEAN), group_key=group)[0].first()
    assert (c.n_leaked, c.n_shared, c.n_test_groups) == (0, 1, 3) and c.verdict != "LEAKING"


def test_formats_give_the_same_rows(spark, files, tmp_path):
    plain = read_table(spark, files("t.csv", LEAKY))
    gz = read_table(spark, files("t.csv.gz", LEAKY), partitions=3)
    assert gz.rdd.getNumPartitions() == 3
    plain.write.parquet(str(tmp_path / "t.parquet"))
    plain.write.json(str(tmp_path / "t.json"))
    want = sorted((r.smiles, r.label, r.split) for r in plain.collect())
    for frame in (gz, read_table(spark, str(tmp_path / "t.parquet")), read_table(spark, str(tmp_path / "t.json"))):
        assert sorted((r.smiles, r.label, r.split) for r in frame.collect()) == want
    ids = {r.record_id for r in plain.collect()}
    assert len(ids) == len(LEAKY) and ids == {r.record_id for r in gz.collect()}


def test_ids_and_splits_do_not_depend_on_file_splits(spark, files):
    rows = [(f"s{i % 900}", i % 2, "x", f"g{i % 7}") for i in range(2000)]
    path, splits = files("many.csv", rows), []
    for size in ("1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            frame = prepare(read_table(spark, path).drop("split")).frame
            splits.append({r.record_id: r.split for r in frame.select("record_id", "split").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(splits[0]) == 2000 and splits[0] == splits[1]


def test_repeated_ids_are_refused(spark, files):
    with pytest.raises(ValueError, match="does not name each row"):
        audit_table(spark, files("t.csv", LEAKY), id_col="smiles")


def test_one_audit_writes_each_table_once(spark, files):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "splitguard"
    before = {p for p in shared.glob("*/*")}
    audit_table(spark, files("t.csv", LEAKY))[0].collect()
    names = sorted(p.name for p in set(shared.glob("*/*")) - before)
    assert names.count("prepared") == 1 and names.count("raw") == 1 and "frame" not in names
    assert len(names) <= 8, names


def test_reader_errors(spark, files):
    with pytest.raises(ValueError):
        read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        read_table(spark, files("t.csv", LEAKY), id_col="nope")
    with pytest.raises(ValueError, match="no usable rows"):
        audit_table(spark, files("t.csv", [(" ", 1, "train", "")]))


def test_writers(spark, files, tmp_path):
    fixed = fix_table(spark, files("t.csv", LEAKY))
    write_split(fixed.rows, str(tmp_path / "csv"), key_name="smiles")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert back.columns == ["smiles", "label", "split"] and back.count() == 10
    write_split(fixed.rows, str(tmp_path / "pq"), "parquet")
    assert (tmp_path / "pq" / "split=test").exists()
    report, notes = audit_table(spark, files("u.csv", LEAKY))
    write_reports(report, str(tmp_path / "rep"), notes)
    one = spark.read.json(str(tmp_path / "rep")).first()
    assert one.verdict == "LEAKING" and one.notes.n_kept == 10 and one.checks.duplicates.n_leaked == 4


def test_sweep_and_probe_report_failures_as_rows(spark, files):
    rows = [(f"tok{i % 7} tok{i % 11} tok{i}", i % 2, "x", f"g{i % 5}") for i in range(60)]
    good = read_table(spark, files("g.csv", rows)).drop("split")
    bad = good.select("record_id", "core")
    table = sweep(spark, [Source("good", good), Source("bad", bad)])
    got = {(r.dataset, r.method): r for r in table.collect()}
    assert len(got) == 4 and got["bad", "random"].verdict.startswith("ERROR")
    assert got["good", "group"].n == 60 and got["good", "random"].label_type == "binary"
    found = {r.dataset: r for r in probe(spark, [Source("good", good), Source("bad", bad), Source("gone", "/no/such.csv")]).collect()}
    assert found["gone"].verdict == "MISSING FILE" and found["bad"].verdict.startswith("ERROR")
    assert found["good"].n_kept == 60 and "no split column" in found["good"].split_source
