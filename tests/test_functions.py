import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitguard.functions import records
from splitguard.functions.labels import label_kind, normalized_split, numeric_label
from splitguard.functions.numbers import fixed, percent, percent_half_up
from splitguard.functions.records import (
    char_shingles,
    fold_features,
    identity_key,
    leading_tokens,
    row_key,
    set_similarity,
    token_set,
    url_host,
    word_shingles,
)


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, value if not isinstance(value, (str, type(None))) else F.lit(value).cast("string"))
    return frame.select(column).first()[0]


def test_same_text_in_other_spelling_has_one_key(spark):
    keys = {one(spark, identity_key("t"), t=t) for t in ("A  b\n c", "a b c ", " a\tB C")}
    assert len(keys) == 1 and None not in keys
    assert one(spark, identity_key("t"), t=" \n ") is None
    assert one(spark, identity_key("t"), t=None) is None


def test_row_key_is_null_when_a_part_is(spark):
    assert one(spark, row_key("a", "b"), a="1", b=None) is None
    assert one(spark, row_key("a", "b"), a="1", b="2") is not None


def test_row_key_tells_joins_apart(spark):
    assert one(spark, row_key("a", "b"), a="a:b", b="c") != one(spark, row_key("a", "b"), a="a", b="b:c")
    assert one(spark, row_key("a", "b"), a="a,1:b", b="c") != one(spark, row_key("a", "b"), a="a", b="b,1:c")


def test_feature_sets(spark):
    assert one(spark, token_set("t"), t="b a B") == ["b", "a"]
    assert one(spark, token_set("t"), t="  ") == []
    assert one(spark, token_set("t"), t=None) is None
    assert one(spark, word_shingles("t", 2), t="a b c a b") == ["a b", "b c", "c a"]
    assert one(spark, word_shingles("t", 3), t="a b") == ["a b"]
    assert one(spark, char_shingles("t", 3), t="abcabc") == ["abc", "bca", "cab"]
    assert one(spark, char_shingles("t", 5), t="ab") == ["ab"]
    bits = one(spark, fold_features(token_set("t"), 8), t="a b c d e f g h i j k l m n o p")
    assert bits == sorted(set(bits)) and max(bits) < 8


def test_set_similarity(spark):
    sets = {"a": F.array(F.lit(1), F.lit(2), F.lit(3)), "b": F.array(F.lit(2), F.lit(3), F.lit(4))}
    assert one(spark, set_similarity("a", "b"), **sets) == 0.5
    empty = F.array().cast("array<int>")
    assert one(spark, set_similarity("a", "b"), a=empty, b=empty) == 0.0


def test_group_keys(spark):
    assert one(spark, url_host("u"), u="HTTPS://m.Example.net:80/en?x#y") == "m.example.net"
    assert one(spark, leading_tokens("t", 2), t="A b  c") == "a b"
    assert one(spark, leading_tokens("t", 2), t="") == ""


def test_numeric_label(spark):
    values = {t: one(spark, numeric_label("t"), t=t) for t in ("1", " 2.5 ", "x", "NaN", None)}
    assert values == {"1": 1.0, " 2.5 ": 2.5, "x": None, "NaN": None, None: None}


def kind(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").agg(label_kind("v")).first()[0]


def test_label_kind_is_binary_only_for_exactly_zero_and_one(spark):
    assert kind(spark, [0.0, 1.0, 1.0, None]) == "binary"
    for other in ([0.0, 0.0], [1.0], [0.0, 1.0, 2.0], [2.0, 5.0], [0.0, 0.5, 1.0], []):
        assert kind(spark, other) == "continuous"


def test_split_names(spark):
    names = ["Train", " VALID ", "Test", "validation", "val", "training", "testing", "holdout", None]
    lenient = [one(spark, normalized_split("s"), s=n) for n in names]
    strict = [one(spark, normalized_split("s", "strict"), s=n) for n in names]
    assert lenient == ["train", "train", "test", "train", "train", "train", "test", None, None]
    assert strict == ["train", None, "test", None, None, None, None, None, None]


def test_number_formats(spark):
    assert one(spark, fixed(percent(F.lit(0.0625)), 1)) == "6.2"
    assert one(spark, percent_half_up(F.lit(0.0625))) == 6.3
    assert one(spark, fixed(F.lit(0.125), 2)) == "0.12"


@pytest.mark.parametrize("chars", [1_000_000, 5])
def test_hashed_character_runs_are_the_runs(spark, monkeypatch, chars):
    """As many distinct ones per text, and the same ones shared by any two texts."""
    monkeypatch.setattr(records, "RUN_CHARS", chars)
    texts = ["abcabcabd", "ABC  abc", "ab", "a", "b", "", "  ", None, "añb€😀añb€😀", "😀a", "abcd" * 50, "\U0010ffff" * 3, "ab\n\nabd"]
    for width in (1, 3, 12):
        plain = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(records.char_shingles("t", width)).collect()]
        normal = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(records.normalized_text("t")).collect()]
        hashed = records._run_hashes(pa.array(normal, pa.string()), width).to_pylist()
        assert plain[7] == hashed[7] == [None]
        sets = [(set(p or ()), set(h or ())) for p, h in zip(plain, hashed)]
        assert all(len(p) == len(h) == len(list(h)) for p, h in sets)
        assert all(len(p & q) == len(h & g) for p, h in sets for q, g in sets)
    assert records._run_hashes(pa.array([], pa.string()), 3).to_pylist() == []
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(records.char_run_hashes("t", 3).alias("h")).collect()
    assert [r.h for r in got] == records._run_hashes(pa.array(normal, pa.string()), 3).to_pylist()
