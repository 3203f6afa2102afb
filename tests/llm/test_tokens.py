"""Token counts and packing: against the tokenizers' own libraries."""

import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from splitguard.llm import packing, piececount
from splitguard.llm.queries import QUERIES, tokenizer


@pytest.fixture(scope="module")
def pieces_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bytes_library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def odd_texts(n=400):
    rnd = random.Random(4)
    alphabet = "ab \n\t\r▁eéthx 0019.,;){}<s></s>'s't<|endoftext|>一二ﬁ½²ªª😀\x00\x85\x1c　 "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    pick = lambda: chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)]))
    texts += ["".join(pick() for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    texts += [c * k for c in " a-=x\n\t" for k in (1, 2, 14, 15, 16, 17, 31, 33, 64)] + ["x" + " " * k + "y" for k in range(40)]
    return [*texts, "ab" * 3000, "a" * 5000 + " " * 5000, "<|endoftext|>", "a <|endoftext|> b", "</s>"]


def test_counts_of_odd_texts(pieces_library):
    texts = odd_texts()
    assert piececount._counter(tokenizer("piece_bpe_32k.model"))(texts) == [len(pieces_library.encode(t)) for t in texts]


def test_counts_with_small_cache_and_blocks(pieces_library, monkeypatch):
    monkeypatch.setattr(piececount, "CACHE_WORDS", 20)
    monkeypatch.setattr(piececount, "MERGE_SYMBOLS", 50)
    texts = odd_texts(60)
    counter = piececount._Counter(tokenizer("piece_bpe_32k.model"))
    assert [c for i in range(0, len(texts), 7) for c in counter(texts[i : i + 7])] == [len(pieces_library.encode(t)) for t in texts]


def test_count_query(spark, sf, documents, pieces_library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_token_counts"](spark, sf).collect()}
    for d, t in documents:
        n = len(pieces_library.encode(t or ""))
        assert got[d] == (len((t or "").encode()), n, n > 4096)


def test_count_edge_cases(edge_docs, no_docs):
    model = tokenizer("piece_bpe_32k.model")
    got = piececount.token_counts(edge_docs, model)
    assert got.count() == edge_docs.count()
    assert {tuple(r)[1:] for r in got.filter("doc_id IN (3, 4)").collect()} == {(0, 0)}
    assert piececount.token_counts(no_docs, model).count() == 0


def test_encoder_on_odd_texts(bytes_library):
    encode = packing._encoder(tokenizer("byte_bpe_50k.json"))
    for t in odd_texts():
        ids = bytes_library.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_every_plain_code_point_is_cut_alike(bytes_library):
    encode = packing._encoder(tokenizer("byte_bpe_50k.json"))
    plain = [c for c in map(chr, range(0x10000)) if re.fullmatch(packing.PLAIN_TEXT, c)]
    texts = [t for c in plain for t in (f"a{c}b 1{c}2 .{c}, {c}{c} {c}a  {c}", c, f" {c}", f"{c} ", f"'s{c}'ll")]
    for text, code in zip(texts, bytes_library.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == struct.pack(f"<{len(code.ids)}I", *code.ids), repr(text)


def check_packing(rows, ids_of):
    """rows: (doc_id, piece, start, length, ids_crc32, sequence_id, offset); ids_of: text ids per doc_id, once per row."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for d, ids in ids_of:
        short = len(ids) % 1024 or 1024
        cuts = [0, *range(short, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence), -(-sum(r.length for r in rows) // 1024)


def test_pack_query(spark, sf, documents, bytes_library):
    rows = QUERIES["op10_best_fit"](spark, sf).collect()
    n, least = check_packing(rows, [(d, [*bytes_library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in documents])
    assert n <= least * 1.02 + 1


def test_pack_edge_cases(edge_docs, no_docs, bytes_library):
    rows = packing.packed_documents(edge_docs, tokenizer("byte_bpe_50k.json"), end_id=2, with_ids=True).collect()
    check_packing(rows, [(r.doc_id, [*bytes_library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in edge_docs.collect()])
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.packed_documents(no_docs, tokenizer("byte_bpe_50k.json"), end_id=2).count() == 0


def test_make_up_places_every_piece():
    rnd = random.Random(3)
    for capacity in (10, 64, 1024):
        for _ in range(30):
            counts = {rnd.randint(1, capacity): rnd.choice((1, 2, 7, 500)) for _ in range(rnd.randint(1, 40))}
            plan = packing.make_up(counts, capacity)
            assert all(sum(s * c for s, c in what) <= capacity for what, _ in plan)
            placed = Counter()
            for what, n in plan:
                for s, c in what:
                    placed[s] += c * n
                assert sum(c for s, c in what if s > capacity // 3) <= 2
            assert placed == Counter(counts)
    assert sum(n for _, n in packing.make_up({600: 5, 400: 5, 24: 5}, 1024)) == 5
    assert packing.make_up({}, 1024) == []


def test_one_length_for_a_third_of_all(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(400)).otherwise(1 + F.col("id") % 900).cast("long").alias("length")
    )
    rows = packing.pack(frame, ["doc_id"]).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_size_steps_reach_two_gigabytes(spark):
    from splitguard.llm import hilbert

    sizes = spark.range(0, 32).select(F.expr("shiftleft(1L, cast(id as int))").alias("size"))
    assert [r[0] for r in sizes.orderBy("size").select(hilbert.octave_steps(F.col("size"))).collect()] == list(range(32))
