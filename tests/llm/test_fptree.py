"""Ranked search: against SQL, plain Python and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [c.total() for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        rows = []
        for (d, c), n in zip(counts, sizes):
            if n:
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
                if score > 0:
                    rows.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def answers(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_of_odd_texts():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aZ09 _-\n\x00\x7f\x80\x85éÉ 一😀@[`{/:") for _ in range(60)) for _ in range(300)]
    for text in [*texts, "", None, "İ", "ß" * 3, "a" * 50]:
        assert fptree.terms_of(None if text is None else text.encode()) == Counter(t.encode() for t in terms(text))


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"wort{i % 97}" for i in range(5000)) + "x" * 300
    whole = fptree.terms_of(text.encode())
    monkeypatch.setattr(fptree, "LONG_TEXT", 50)
    assert fptree.terms_of(text.encode()) == whole == Counter(t.encode() for t in terms(text))


def invented(rnd, n, words=60, longest=80):
    return [" ".join(f"w{min(int(rnd.expovariate(0.08)), words)}" for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("leaf,tree_rows", [(1, 7), (4, 1000), (256, 50)])
def test_search_matches_plain_python(spark, monkeypatch, leaf, tree_rows):
    monkeypatch.setattr(fptree.Tree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(fptree, "TREE_ROWS", tree_rows)
    rnd = random.Random(leaf)
    texts = invented(rnd, 250)
    docs = list(enumerate([*texts, *[texts[3]] * 40, *["W0 w0"] * 30, "", None]))
    items = list(enumerate([*invented(rnd, 12, longest=15), texts[3], texts[5] + " unknown", "", None, "unknown", "w0"]))
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert answers(fptree.ranked_documents(*frames)) == plain(docs, items)
    # The same in several blocks of items.
    assert answers(fptree.ranked_documents(*frames, k=3, block_chars=200)) == plain(docs, items, 3)


def test_subtrees_are_left_out():
    rnd = random.Random(1)
    # Two vocabularies; an item of one has no business in documents of the other.
    docs = [[rnd.randrange(40) + 40 * (i % 2) for _ in range(30)] for i in range(4000)]
    counted = [Counter(d) for d in docs]
    doc = np.array([i for i, c in enumerate(counted) for _ in c])
    rank = np.array([t for c in counted for t in c])
    tf = np.array([n for c in counted for n in c.values()])
    tree = fptree.Tree(list(range(4000)), np.full(4000, 50), doc, rank, tf, leaf_rows=32)
    best = []
    scored = tree.search(np.arange(40, 80), np.full(40, 900), best, 10)
    assert len(best) == 10 and scored <= 2100 and all(d % 2 for _, _, d in best)
    for n, own in enumerate(tree.children):
        if own:
            assert tree.low[own[0]] == tree.low[n] and tree.high[own[1] - 1] == tree.high[n]


def test_edge_cases(spark, edge_docs, no_docs):
    items = [(1, "the QUICK fox"), (1, "the QUICK fox"), (None, "line"), (2, None), (3, ""), (4, "école"), (5, "word3 word4"), (6, "??")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("rank", "doc_id", "score", "item", "terms", "n")})
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert answers(fptree.ranked_documents(edge_docs, frame)) == plain(docs, items)
    assert fptree.ranked_documents(no_docs, frame).collect() == []
    assert fptree.ranked_documents(edge_docs, frame.limit(0)).collect() == []
