"""Language identification, and the pipeline against its stages in plain Python."""

import math
import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from splitguard.llm import forest, language, leaks
from test_exact import plain_copies
from test_near import as_dict, plain_groups


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.predictions(docs).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(edge_docs, no_docs):
    got = language.languages(edge_docs, sample=50)
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    by_text = {r.row.text: (r.lang_pred, r.score) for r in rows}
    for t in (None, "", "12 34 !? ...", " \n\t "):
        assert by_text[t] == ("und", 0.0)
    assert by_text["x"][0] != "und"
    assert got.select("row.*").columns == edge_docs.columns
    assert language.languages(no_docs).count() == 0
    assert {r.lang_pred for r in language.predictions(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_matches_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in left.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert set(kept["exact_dedup"]) == {d for d, _, _, stays, _ in plain_copies(list(kept["language_id"].items())) if stays}
    assert set(kept["near_dedup"]) == {d for d, (_, _, stays) in plain_groups(list(kept["exact_dedup"].items()), percent=80).items() if stays}
    items = [leaks.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set(kept["near_dedup"]) - set(kept["decontaminate"])
    assert gone == {d for d, t in kept["near_dedup"].items() if any(i in leaks.plain(t) for i in items)}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept["decontaminate"])


def test_stages_on_edge_cases(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            assert name == "pack" or (out.columns == docs.columns and n <= docs.count())


def test_near_copies_from_80_percent(spark):
    rnd, rows = random.Random(4), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(404)]
        # n words changed far apart: (400 - 5 n) / (400 + 5 n), 0.81 for 8 and 0.84 for 7.
        words = list(base)
        for slot in rnd.sample(range(40), 7 + g % 2):
            words[10 * slot + 5] = f"new{rnd.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(words))]
    want = plain_groups(rows, percent=80)
    assert sum(stays for _, _, stays in want.values()) == 40 and all(stays for _, _, stays in plain_groups(rows).values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(forest.near_copies(docs, percent=80)) == want


def test_stages_drop_pairs_at_82_percent_and_short_telling_items(spark, tmp_path):
    base = [f"w{i}" for i in range(404)]
    words = list(base)
    for slot in range(8):
        words[50 * slot + 5] = f"new{slot}"  # (400 - 40) / (400 + 40) = 0.818
    rows = [(1, " ".join(base)), (2, " ".join(words)), (3, "how are you today"), (4, "それは、富士山の高さは何ですか、と聞いた。")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "are you"), (2, "富士山の高さは何ですか")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    left = corpus_pipeline.drop_leaks(spark, left, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_trees_and_equal_values_follow_from_the_bound():
    assert (forest.trees_for(85), forest.least_alike(85, 96)) == (12, 64)
    for percent in (60, 80, 85, 95):
        trees = forest.trees_for(percent)
        n, j = trees * forest.MAX_DEPTH, percent / 100
        assert (1 - j**forest.MIN_DEPTH) ** trees <= 1.1e-5
        assert sum(math.comb(n, k) * j**k * (1 - j) ** (n - k) for k in range(forest.least_alike(percent, n))) <= 2e-6
