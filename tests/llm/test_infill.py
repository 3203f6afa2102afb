"""Fill-in-middle: against plain Python, exact round trips, and what chunks are for."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitguard.llm import infill


def plain(doc_id, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def odd_texts():
    rnd = random.Random(13)
    texts = ["".join(rnd.choice("ab\n\r é一😀<P>SM\x00\x85") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    lines = [" ".join(rnd.choice(["zahl", "naïve", "日本", "x"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    texts += ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 300))) for _ in range(40)]
    return [*texts, "", "\n", "\n\n", "a", "a\n", "é" * 100_000, "x" * 200_000 + "\n" + "y" * 70_000, "<P", "a<P>b", "<S" + "\n>" * 40, "\n" * 70_000]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100), (0, 50)])
def test_matches_plain_python_and_comes_back(spark, rate, spm):
    rows = list(enumerate(odd_texts()))
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), fim_percent=rate, spm_percent=spm)
    got = made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: plain(i, t, rate, spm) for i, t in rows}
    assert all(r.back == rows[r.doc_id][1] for r in got)
    if rate == 60:
        assert {r.form for r in got} == {"plain", "spm" if spm else "psm"}


def test_edge_cases(edge_docs, no_docs):
    got = infill.fill_in_middle(edge_docs)
    rows = [(r.row.doc_id, *tuple(r)[1:]) for r in got.collect()]
    want = [(r.doc_id, *plain(r.doc_id, r.text)) for r in edge_docs.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert set(got.select("row.*").columns) == set(edge_docs.columns) - {"text"}
    assert infill.fill_in_middle(no_docs).collect() == []


def test_another_separator_and_marks(spark):
    rows = [(i, t.replace("\n", "|")) for i, t in enumerate(odd_texts()[:50])]
    marks = ("[pre]", "[suf]", "[mid]")
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), separator="|", marks=marks)
    for r in made.select("row.doc_id", "n", "output", infill.restored(F.col("output"), F.col("form"), marks).alias("back")).collect():
        assert r.back == rows[r.doc_id][1] and r.n == len(re.findall(r"[^|]*\||[^|]+", r.back))
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), separator="é")


@pytest.mark.parametrize("slab", [100, 4096, infill.SLAB])
def test_chunks_do_not_depend_on_slabs_or_neighbours(monkeypatch, slab):
    rnd = np.random.default_rng(5)
    texts = [rnd.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (0, 10, 5_000, 90_000, 300)] + [b"a" * 200_000]
    alone = [infill._chunk_ends(len(t), infill._possible_ends(t).tolist()) for t in texts]
    monkeypatch.setattr(infill, "SLAB", slab)
    memo = infill.Memo(b"\n")
    together = [[s + len(c) for s, c in zip(t.starts, t.chunks)] for t in infill._texts(texts, memo)]
    assert together == alone
    assert all(b - a <= infill.MOST_CHUNK for own in alone for a, b in zip([0, *own], own))


def test_shared_passages_are_looked_up_and_the_memo_stays_bounded():
    rnd = np.random.default_rng(6)
    passage = rnd.integers(97, 123, 50_000, dtype=np.uint8).tobytes()
    texts = [rnd.integers(97, 123, 700 + 13 * i, dtype=np.uint8).tobytes() + passage for i in range(20)]
    memo = infill.Memo(b"e", most=100_000)
    made = list(infill._texts(texts, memo))
    assert [t.n for t in made] == [len(re.findall(rb"[^e]*e|[^e]+", t)) for t in texts]
    chunks = sum(len(t.chunks) for t in made)
    assert memo.hits > 0.85 * chunks and memo.held == sum(map(len, memo.known)) <= 100_000
