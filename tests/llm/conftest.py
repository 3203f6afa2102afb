import pytest

# Every name that an operator uses inside, so that clashes show.
CLASH = ["mark", "level", "name", "hash", "h", "n", "v", "rank", "place", "row", "part", "pos", "label", "rest", "found", "score", "held_out", "_keep_doc_id"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    line = "This line is long enough"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en"),
        (2, "the  quick brown fox jumps over the lazy dog", "en"),
        (2, "the  quick brown fox jumps over the lazy dog", "en"),
        (3, None, None),
        (4, "", "en"),
        (None, "the quick brown fox jumps over the lazy dog", None),
        (None, "a text without id", "en"),
        (5, long_text, "en"),
        (6, long_text + " more", "en"),
        (7, "12 34 !? ...", "de"),
        (8, f"{line}\nown line eight\n  {line.upper()}\t\n", "en"),
        (9, f"{line}\nown line nine\r\n{line}", None),
        (10, "x", "fr"),
        (10, "another text under the same id", "fr"),
        (11, " \n\t ", "fr"),
        (12, "ÉCOLE ÀÉ line of text\nécole àÉ line of text", "fr"),
        (13, "école ÀÉ line of text", "fr"),
    ]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return _with_clashes(frame).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return _with_clashes(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))


def _with_clashes(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from splitguard.llm.queries import let_workers_import

    let_workers_import(spark)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    import os

    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(doc_id, text) of all documents as a list."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
