"""Near-duplicate groups, components and decontamination: against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from splitguard.llm import forest, leaks
from splitguard.llm.components import components
from splitguard.llm.queries import QUERIES


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked(vertices, edges):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        i, j = find(a), find(b)
        root[max(i, j)] = min(i, j)
    return {v: find(v) for v in vertices}


def plain_groups(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {p for own in holders.values() for p in combinations(sorted(own), 2)}
    alike = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = linked(sets, alike)
    return {d: (len(sets[d]), component[d], component[d] == d) for d in sets}


def as_dict(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_query_matches_brute_force(spark, sf, documents):
    assert as_dict(QUERIES["op5_lsh_forest"](spark, sf)) == plain_groups(documents)


def edited(words, n, rnd):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_large_group_of_near_copies_with_small_regions(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(200)]
    rows = [(i, edited(base, i % 4, rnd)) for i in range(150)]
    rows += [(1000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(80))) for i in range(20)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    got = forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), region=8)
    assert as_dict(got) == plain_groups(rows)


def test_near_edge_cases(edge_docs):
    got = forest.near_copies(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == {(5, 1, True)} and by_id[2] == {(5, 1, False)}
    assert by_id[3] == {(0, 3, True)} and by_id[4] == {(0, 4, True)} and by_id[11] == {(0, 11, True)}
    assert {c for _, c, _ in by_id[None]} == {None}
    assert by_id[6] == {(978, 5, False)}


def test_near_of_nothing(no_docs):
    assert forest.near_copies(no_docs).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, None), (5, 5)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == linked({v for e in real for v in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        here = [i]
        for j, d in enumerate(text, 1):
            here.append(min(before[j] + 1, here[j - 1] + 1, before[j - 1] + (c != d)))
        before = here
    return min(before)


def noisy(text, edits, rnd):
    chars = list(text)
    for _ in range(edits):
        i, kind = rnd.randrange(len(chars)), rnd.randrange(3)
        if kind == 0:
            chars[i] = rnd.choice("abcde ")
        elif kind == 1:
            del chars[i]
        else:
            chars.insert(i, rnd.choice("abcde "))
    return "".join(chars)


def test_leaks_match_the_edit_matrix(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(6, 30)))) for i in range(12)]
    docs = [
        (d, " ".join(word() for _ in range(10)) + " " + noisy(items[d % 12][1], rnd.randint(0, len(items[d % 12][1]) // 6), rnd) + " " + word())
        for d in range(120)
    ]
    want = set()
    for d, text in docs:
        for i, item in items:
            distance, budget = plain_distance(item, leaks.plain(text)), int(len(item) * leaks.ERROR_RATE)
            if distance <= budget:
                want.add((d, i, distance))
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (leaks.BLOCK_CHARS, 500):
        got = {(r.doc_id, r.item_id, r.distance) for r in leaks.leak_matches(docs_, items_, block_chars=block_chars).collect()}
        assert got == want
    assert len(want) > 40


def test_leak_edge_cases(spark, edge_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "The QUICK  brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "short"), (5, "the quick brown fox jumps over the lazy dog"), (None, "word1 word2 word3 word4 word5 word6")],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(0))
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in leaks.leak_matches(edge_docs, items).collect()), key=str)
    want = [(d, i, 0) for d in (1, 2, 2, None) for i in (1, 5)] + [(5, None, 0), (6, None, 0)]
    assert got == sorted(want, key=str)
    assert leaks.leak_matches(no_docs, items).count() == 0
    assert leaks.leak_matches(edge_docs, items.limit(0)).count() == 0


def test_short_items_match_as_whole_words(spark):
    items = [(1, "Is it  raining"), (2, "富士山の高さは"), (3, "ป่าไม้"), (4, "ok"), (5, "!?")]
    docs = [
        (1, "he asked: is it raining?"), (2, "is it rainings or sun"), (3, "this it raining"), (4, "また富士山の高さは何"), (5, "ในป่าไม้ใหญ่"),
        (6, "token ok"), (7, "ok"), (8, "book"), (9, "what!?"), (10, "is it rainin"), (11, "IS\nIT RAINING this is it raining"),
    ]
    got = leaks.leak_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (11, 1), (4, 2), (5, 3), (6, 4), (7, 4), (9, 5)}
    assert all(r.distance == r.budget == 0 for r in got)
    assert {(r.item_id, r.item_chars, r.item_bytes) for r in got} == {(1, 13, 13), (2, 7, 21), (3, 6, 18), (4, 2, 2), (5, 2, 2)}


def test_query_finds_every_whole_item(spark, sf, documents):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_edit_leaks"](spark, sf).collect()}
    items = [(r.item_id, leaks.plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in documents for i, item in items if item in leaks.plain(t)}
    assert whole <= got


def test_long_sets_go_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(forest, "LONG", 150)
    rnd = random.Random(8)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(5000)}" for _ in range(60 + 40 * g)]
        rows += [(100 * g + i, edited(base, i % 3, rnd)) for i in range(12)]
    got = forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), region=4)
    assert as_dict(got) == plain_groups(rows)


def template_family(rnd, members, planted, slots=100, edits=8, common=2):
    """Texts from one template that are not linked with each other, and planted pairs that are, just above 85 percent."""
    base = [f"t{i}" for i in range(8 * slots)]

    def filled(changes):
        words = list(base)
        for slot, word in changes:
            words[8 * slot + 4] = word
        return " ".join(words)

    fresh = lambda own: [(s, f"x{rnd.randrange(10**9)}") for s in own]
    rows = []
    for i in range(members):
        own = fresh(rnd.sample(range(slots), edits))
        rows.append((2 * i, filled(own)))
        if i < planted:
            left = [s for s in range(slots) if s not in {s for s, _ in own}]
            rows.append((2 * i + 1, filled(own[:common] + fresh(rnd.sample(left, edits - common)))))
    return rows


def test_pairs_within_a_family_of_unlinked_members(spark):
    rows = template_family(random.Random(11), 100, 30)
    want = plain_groups(rows)
    assert sum(not kept for _, _, kept in want.values()) >= 30
    assert len({c for _, c, _ in want.values()}) >= 60
    got = forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), region=8)
    assert as_dict(got) == want
