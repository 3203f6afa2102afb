"""Exact dedup, line dedup: against plain Python and their SQL."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from splitguard.llm import licences, lines, names
from splitguard.llm.oracles import ORACLES
from splitguard.llm.queries import QUERIES


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name]) is None


def plain_copies(rows):
    fold = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    out = []
    for d, t in rows:
        own = groups[fold(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 64, 4096])
@pytest.mark.parametrize("colliding", [False, True])
def test_copies_match_plain_python(edge_docs, block, colliding):
    options = {"block_hash": lambda b: F.length(b) % 3} if colliding else {}
    if block == 3 and colliding:
        edge_docs = edge_docs.filter(F.length("text") < 100)
    if block == 3 and not colliding:
        edge_docs = edge_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    want = plain_copies([(r.doc_id, r.text) for r in edge_docs.collect()])
    got = names.exact_copies(edge_docs, block_chars=block, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(got) == want


def test_copies_of_nothing(no_docs):
    assert names.exact_copies(no_docs).count() == 0


def plain_lines(rows, min_chars=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is not None, d)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= min_chars and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < min_chars or first[key(x)] == d]
        out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 2])
def test_lines_match_plain_python(edge_docs, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    got = lines.apply_keeps(edge_docs, lines.line_keeps(edge_docs)).select("row.doc_id", "kept_text", "n_lines", "n_dropped")
    assert rows_of(got) == plain_lines([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_lines_of_nothing(no_docs):
    assert lines.line_keeps(no_docs).count() == 0


def test_a_line_that_everyone_has(spark):
    rows = [(i, f"a line that all have\nown line number {i}") for i in range(300)]
    keeps = lines.line_keeps(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in keeps.filter("n_dropped = 0").collect()] == [0]
    assert keeps.agg(F.sum("n_dropped")).first()[0] == 299
    assert keeps.filter("doc_id = 7").first().keep_runs == [(1, 1)]


APACHE = """   Copyright 2020 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_as_published(spark):
    texts = [APACHE, BSD_2, BSD_3, BSD_3.replace("1. ", "1) ").replace("2. ", "2) ").replace("3. ", "3) ")]
    texts += ["".join("# " + line for line in t.splitlines(keepends=True)) for t in texts[:3]]
    want = ["Apache", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "Apache", "BSD-2-Clause", "BSD-3-Clause"]
    rows = list(enumerate(texts + [t.replace("\n", "\r\n") for t in texts]))
    rows.append((99, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not"))
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in range(2 * len(want))] == want + want
    assert got[0].sentences == got[7].sentences == "apache-head,apache-copy,apache-as-is" and got[0].versions == "2.0"
    assert got[2].sentences == "bsd-grant,bsd-source,bsd-binary,bsd-endorse"
    assert (got[99].licences, got[99].sentences) == ("MPL", "mpl-ref")


def odd_notices():
    rnd = random.Random(9)
    known = [s.replace("{v}", rnd.choice(["2.0", "3", "4.0.1"])) for s in licences.SENTENCES.values()]
    glue = [" ", "\n", ". ", ".\n", "\n\n", "; ", ";\n", "\r\n", "\n# ", "\n---\n", " 1. ", "\n(a) ", "\n 2) ", "! ", "\n——\n", "\n版\n", ' v. ', '."\n', "\x0c"]
    words = ["foo", "Ärger", "v", "12", "«", "the", "License", "一"]
    for _ in range(400):
        text = "".join(rnd.choice([rnd.choice(known), rnd.choice(known).upper(), rnd.choice(words)]) + rnd.choice(glue) for _ in range(rnd.randint(1, 8)))
        yield re.sub(r" (?=\w)", lambda m: rnd.choice([" ", " ", " ", "\n", "\n * "]), text) if rnd.random() < 0.5 else text


def test_licence_rule_is_the_one_of_the_sql(spark):
    import duckdb

    texts = [APACHE, BSD_2, BSD_3, BSD_3.replace("\n", "\r\n"), *("".join("# " + line for line in t.splitlines(keepends=True)) for t in (APACHE, BSD_2, BSD_3)), *odd_notices(), "", None]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(ORACLES["op1_license_sentences"]).fetchall()}
    got = {r.doc_id: (r.sentences, r.licences, r.versions) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: g for i, g in got.items() if g != want[i]} == {}
    assert [want[i][1] for i in range(7)] == ["Apache", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "Apache", "BSD-2-Clause", "BSD-3-Clause"]
    assert sum(bool(g[1]) for g in got.values()) > 250
    found = licences.licence_sentences(spark.createDataFrame(rows[:3], "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.sentence_id, r.width) for r in found][:2] == [(0, "apache-head", 2), (0, "apache-copy", 1)]
