import pytest
from pyspark.sql import functions as F

from splitguard.operators.detect import find_key_column, find_label_column, find_split_column
from splitguard.operators.prepare import load_strict, missing_sides, prepare, require_rows, unexpected_splits


def table(spark, schema, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"record_id bigint, {schema}")


def test_key_column_by_name_then_by_content(spark):
    assert find_key_column(table(spark, "name string, mol string", ("x", "CCO"))) == "mol"
    assert find_key_column(table(spark, "` SMILES ` string", ("CCO",))) == " SMILES "
    by_content = table(spark, "a string, b string", *[("no", f"r{i}") for i in range(30)])
    assert find_key_column(by_content, lambda c: c.startswith("r")) == "b"
    assert find_key_column(by_content, lambda c: c.startswith("q")) is None
    some = table(spark, "b string", *[(f"r{i}" if i < 21 else "no",) for i in range(30)], (None,))
    assert find_key_column(some, lambda c: c.startswith("r")) is None  # 21 of 30 is not above 70 %
    late = table(spark, "b string", *[("no" if i < 25 else f"r{i}",) for i in range(100)])
    assert find_key_column(late, lambda c: c.startswith("r")) == "b"  # every row counts, not the first ones


def test_split_column_needs_a_split_word(spark):
    assert find_split_column(table(spark, "model string", ("Train",), ("Test",))) == "model"
    assert find_split_column(table(spark, "model string", ("resnet",))) is None
    assert find_split_column(table(spark, "split string", ("training",), ("testing",))) is None
    assert find_split_column(table(spark, "`group` int, subset string", (1, "VAL"))) == "subset"


def test_label_column(spark):
    assert find_label_column(table(spark, "mol string, x int, Class int", ("a", 1, 1)), "mol", None) == "Class"
    assert find_label_column(table(spark, "mol string, cid int, exp double", ("a", 1, 1.0)), "mol", None) == "exp"
    assert find_label_column(table(spark, "mol string, flag boolean", ("a", True)), "mol", None) == "flag"
    assert find_label_column(table(spark, "mol string, remark string", ("a", "b")), "mol", None) is None


def test_missing_split_is_created_and_disclosed(spark):
    raw = table(spark, "smiles string, p_np int", *[(f"r{i}", i % 2) for i in range(50)])
    frame, notes = prepare(raw)
    n = notes.first()
    assert (n.key_col, n.label_col, n.n_kept, n.n_train, n.n_test) == ("smiles", "p_np", 50, 40, 10)
    assert "no split column" in n.split_source and n.label_type == "binary"
    assert frame.groupBy("split").count().count() == 2


def test_provided_split_is_folded(spark):
    raw = table(spark, "mol string, Class int, Model string", *[("a", 0, "Train"), ("b", 1, "Valid"), ("c", 1, "Test"), ("d", 0, "validation")])
    frame, notes = prepare(raw)
    assert [r.split for r in frame.orderBy("record_id").collect()] == ["train", "train", "test", "train"]
    assert "provided column 'Model'" in notes.first().split_source


def test_rows_are_dropped_in_order_and_counted(spark):
    raw = table(
        spark, "text string, label string, split string",
        ("a", "1", "train"), (" ", "1", "train"), (None, None, "train"), ("b", None, "test"), ("c", "x", "test"),
        ("d", "NaN", "test"), ("e", "0", "holdout"), ("f", "0", "test"),
    )
    n = prepare(raw).notes.first()
    assert (n.n_input, n.dropped_bad_key, n.dropped_missing_label, n.dropped_unusable_split, n.n_kept) == (8, 2, 3, 1, 2)


def test_continuous_labels(spark):
    raw = table(spark, "smiles string, solubility double", *[(f"r{i}", i / 7) for i in range(11)])
    n = prepare(raw).notes.first()
    assert (n.label_col, n.label_type) == ("solubility", "continuous")


def test_named_columns_win_and_missing_ones_raise(spark):
    raw = table(spark, "smiles string, other string, label int, y2 int", ("a", "b", 0, 5))
    n = prepare(raw, key_col="other", label_col="y2").notes.first()
    assert (n.key_col, n.label_col) == ("other", "y2")
    for bad in ({"key_col": "nope"}, {"label_col": "nope"}, {"split_col": "nope"}):
        with pytest.raises(ValueError):
            prepare(raw, **bad)
    with pytest.raises(ValueError):
        prepare(table(spark, "smiles string, remark string", ("a", "b")))


def test_strict_loader_keeps_only_train_and_test(spark):
    raw = table(spark, "smiles string, label int, split string", ("a", 0, " TRAIN"), ("b", 1, "valid"), ("c", 1, None))
    frame, notes = load_strict(raw)
    assert [r.split for r in frame.collect()] == ["train"]
    assert notes.first().dropped_unusable_split == 2
    assert {r.split_value for r in unexpected_splits(raw, "split").collect()} == {"valid", None}
    flags = missing_sides(frame).first()
    assert (flags.train_missing, flags.test_missing) == (False, True)
    with pytest.raises(ValueError, match="split"):
        load_strict(raw.drop("split"))


def test_empty_frame_is_an_error(spark):
    raw = table(spark, "smiles string, label int, split string", (" ", 0, "train"))
    with pytest.raises(ValueError):
        require_rows(prepare(raw).frame)
    assert prepare(raw).notes.first().n_kept == 0


def test_group_and_features_travel_along(spark):
    raw = table(spark, "text string, label int, split string, fam string", ("a b", 0, "train", ""), ("c", 1, "test", None))
    rows = prepare(raw, group_key=F.col("fam")).frame.orderBy("record_id").collect()
    assert [(r.group_key, r.features) for r in rows] == [("", ["a", "b"]), (None, ["c"])]
