"""WARC archives, Hilbert shards, licence scans: round trips and plain Python."""

import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from splitguard.llm import hilbert, licences, warc
from splitguard.llm.queries import QUERIES


def odd_pages(spark):
    big = "<p>" + "é" * 5000 + "\n" + "x" * 3000
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None),
        (7, "http://a/7\r\nX: y", ""), (8, "u", "\n\n\r\n" * 400), (8, "u", "\n\n\r\n" * 400), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 200), (10, "u", "z" * 1000), (11, "u", "z" * 1000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "uri": F.lit("clash"), "n_rows": F.lit(1)})


@pytest.mark.parametrize("segment_bytes", [warc.SEGMENT_BYTES, 1000, 7])
def test_archives_round_trip(spark, tmp_path, segment_bytes):
    pages = odd_pages(spark)
    plan = warc.revisit_plan(pages)
    warc.write_archives(plan, str(tmp_path / "w"), segment_bytes=segment_bytes)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"), chunk_bytes=700).collect()
    by_record = defaultdict(list)
    for c in chunks:
        by_record[(c.record_id, c.record_type)].append(c)
    texts = {(r.page_id, r.html or "") for r in pages.collect()}
    responses = {k: v for k, v in by_record.items() if k[1] == "response"}
    assert {int(k[0]) for k in responses if k[0]} == {3, 4, 5, 6, 7, 8, 9, 11}
    for (record, _), own in responses.items():
        own.sort(key=lambda c: c.chunk_no)
        if record in (None, "8"):
            continue
        data, digest = b"", hashlib.sha1()
        for i, c in enumerate(own):
            data += c.data
            digest.update(c.data)
            assert (c.chunk_no, c.is_last, len(c.data) <= 700) == (i, i == len(own) - 1, True)
            assert (c.running_sha1, c.payload_bytes) == (digest.hexdigest(), len(data))
        assert (int(record), data.decode()) in texts
    ends = {(r.record_id, r.record_type): r for r in warc.record_ends(warc.read_chunks(spark, str(tmp_path / "w"), with_data=False)).collect()}
    assert ends[("1", "revisit")].refers_to == "3" and ends[("10", "revisit")].refers_to == "11"
    assert ends[("1", "revisit")].payload_digest == ends[("3", "response")].payload_digest == ends[("3", "response")].header_digest
    assert ends[("1", "revisit")].payload_bytes == 13004


def test_long_payloads_without_line_feeds_are_never_one_line(spark, tmp_path):
    text = "".join(f"{i}é漢😀" for i in range(150_000))
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text + "!"), (3, "u", text)], "page_id long, url string, html string")
    warc.write_archives(warc.revisit_plan(pages), str(tmp_path / "w"), segment_bytes=1 << 16)
    lines = [line for p in (tmp_path / "w").glob("*.gz") for line in gzip.open(p).read().split(b"\n")]
    assert max(map(len, lines)) <= (1 << 16) + 8
    chunks = [c for c in warc.read_chunks(spark, str(tmp_path / "w"), chunk_bytes=50_000).collect() if c.record_id == "2"]
    chunks.sort(key=lambda c: c.chunk_no)
    data = b"".join(c.data for c in chunks)
    assert data.decode() == text + "!" and max(len(c.data) for c in chunks) == 50_000
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert chunks[-1].running_sha1 == hashlib.sha1(data).hexdigest() == chunks[-1].header_digest
    ends = {r.record_id: r for r in warc.record_ends(warc.read_chunks(spark, str(tmp_path / "w"), with_data=False)).collect()}
    assert (ends["1"].record_type, ends["1"].refers_to, ends["3"].payload_bytes) == ("revisit", "3", len(text.encode()))


@pytest.mark.parametrize("drop", [1, 2, 3])
def test_a_broken_chain_of_segments_is_an_error(drop):
    def record(number, body):
        kind = "response" if number == 1 else "continuation"
        more = "" if number == 1 else "WARC-Segment-Origin-ID: <a>\r\n"
        more += "WARC-Segment-Total-Length: 6\r\n" if number == 3 else ""
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{'a' if number == 1 else number}>\r\n{more}WARC-Segment-Number: {number}\r\n"
        return f"{head}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    def parse(numbers):
        out = warc._Batches(True)
        parser = warc._Parser(4, out)
        for line in b"".join(record(k, "xy") for k in numbers).split(b"\n")[:-1]:
            parser.feed(line)
        parser.end_of_file("f")
        return out.take().column("data").to_pylist()

    assert parse([1, 2, 3]) == [b"xyxy", b"xy"]
    with pytest.raises(ValueError):
        parse([k for k in (1, 2, 3) if k != drop])


def test_archives_are_warc(spark, tmp_path):
    warc.write_archives(warc.revisit_plan(odd_pages(spark).coalesce(1)).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    n = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
        assert rest[length : length + 4] == b"\r\n\r\n"
        raw, n = rest[length + 4 :], n + 1
    assert n == 13


def test_no_pages(spark, tmp_path):
    warc.write_archives(warc.revisit_plan(odd_pages(spark).limit(0)), str(tmp_path / "w"))
    assert warc.read_chunks(spark, str(tmp_path / "w")).count() == 0


def test_curve_visits_neighbouring_cells(spark):
    side = 8
    cells = spark.range(side**3).select(*[(F.floor(F.col("id") / side**i) % side).cast("long").alias(c) for i, c in enumerate("xyz")])
    path = [tuple(r)[1:] for r in cells.select(hilbert.hilbert_index([F.col(c) for c in "xyz"], bits=3).alias("h"), "x", "y", "z").orderBy("h").collect()]
    assert len(set(path)) == side**3
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
    assert [r.h for r in cells.select(hilbert.hilbert_index([F.col(c) for c in "xyz"], bits=3).alias("h")).orderBy("h").collect()] == list(range(side**3))


def check_shards(rows, n_rows, n_shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n_rows
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shard_query(spark, sf, documents):
    rows = QUERIES["op7_hilbert_shards"](spark, sf).collect()
    check_shards(rows, len(documents))
    text = dict(documents)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    order = [r.curve_index for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shard_edge_cases(spark, edge_docs, no_docs, tmp_path):
    axes = [hilbert.octave_steps(F.length("text")), hilbert.name_steps(F.col("lang"))]
    sharded = hilbert.curve_runs(edge_docs, axes, ["doc_id", "text"], 4)
    check_shards(sharded.collect(), edge_docs.count(), 4)
    bounds = hilbert.shard_bounds(sharded, ["doc_id"])
    assert sum(r.n_rows for r in bounds.collect()) == edge_docs.count()
    hilbert.write_shards(sharded.select(F.struct("row.doc_id", "row.text").alias("row"), "shard", "slot"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == edge_docs.count()
    assert hilbert.curve_runs(no_docs, axes, ["doc_id"], 4).count() == 0


def test_cuts_keep_the_order_of_values(spark, edge_docs, no_docs):
    names = [f"host{i:03d}" for i in range(100)]
    rows = spark.createDataFrame([(n, i * i) for i, n in enumerate(names)] + [(names[40], -5)] * 60 + [(None, None)], "name string, size long").repartition(5)
    cuts = hilbert.step_cuts(rows, ["name", "size"], bits=3)
    assert cuts["name"] == [names[-(-100 * k // 8)] for k in range(1, 8)] and cuts["size"] == sorted(set(cuts["size"]))
    placed = rows.select("name", "size", hilbert.steps_by(F.col("name"), cuts["name"], 3).alias("a"), hilbert.steps_by(F.col("size"), cuts["size"], 3).alias("b")).collect()
    for value, step in (("name", "a"), ("size", "b")):
        known = sorted((r[value], r[step]) for r in placed if r[value] is not None)
        assert [s for _, s in known] == sorted(s for _, s in known) and len({s for _, s in known}) == len(cuts[value]) + 1
        assert {r[step] for r in placed if r[value] is None} == {0}
    few = hilbert.step_cuts(edge_docs, ["lang", "n_chars", "source"])
    assert few == {"lang": ["en", "fr"], "n_chars": [], "source": []}
    assert hilbert.step_cuts(no_docs, ["lang", "n_chars"]) == {"lang": [], "n_chars": []}
    cut = hilbert.curve_runs(edge_docs, [hilbert.steps_by(F.col(c), few[c]) for c in few], ["doc_id", "text"], 4)
    check_shards(cut.collect(), edge_docs.count(), 4)


def test_shard_bounds_skip_shards(spark, sf, documents):
    """A reader of one source opens at most half of the shards, by the smallest and largest value of each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("size"))
    cuts = hilbert.step_cuts(docs, ["size", "source", "lang"])
    bounds = hilbert.shard_bounds(hilbert.curve_runs(docs, [hilbert.steps_by(F.col(c), own) for c, own in cuts.items()], ["doc_id"], 16), ["source", "lang"]).collect()
    for column in ("source", "lang"):
        values = [r[0] for r in docs.select(column).distinct().collect() if r[0] is not None]
        opened = [sum(b[f"min_{column}"] is not None and b[f"min_{column}"] <= v <= b[f"max_{column}"] for b in bounds) for v in values]
        assert sum(opened) / len(opened) <= 8, (column, opened)


def test_shards_of_one_cell(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"))
    sharded = hilbert.curve_runs(rows, [F.lit(1), F.lit(2)], ["doc_id"], 16)
    check_shards(sharded.collect(), 5000)


MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\n'
    "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
    "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
)


def test_licences(spark, edge_docs, no_docs):
    rows = [
        (1, "Some text.\nLicensed under CC BY-NC 4.0\nmore text"),
        (2, "Intro. Licensed under the Apache License, Version 2.0. The end. All rights reserved."),
        (3, MIT + "Other."),
        (4, None),
        (5, ""),
        (6, "# " + MIT.replace("\n", "\n# ")),
        (7, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n"
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nUnknown sentence here.\n\n"
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
        (8, "the mit license is nice"),
        (None, "Released under the MIT License\n"),
    ]
    got = {r.doc_id: (r.sentences, r.licences, r.versions) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("cc-by-nc-ref", "CC-BY-NC", "4.0")
    assert got[2] == ("apache-ref,reserved", "All-rights-reserved,Apache", "2.0")
    assert got[3] == ("mit-grant,mit-notice", "MIT", "") == got[6]
    assert got[4] == got[5] == got[8] == ("", "", "")
    assert got[7][1:] == ("GPL-or-later", "3")
    assert got[None] == ("mit-ref", "MIT", "")
    assert licences.licences(edge_docs).count() == edge_docs.count()
    assert licences.licences(no_docs).count() == 0


def test_licence_query_against_a_search(spark, sf, documents):
    got = {r.doc_id: r.licences for r in QUERIES["op1_license_sentences"](spark, sf).collect()}
    for d, t in documents:
        flat = " ".join((t or "").split())
        if "Licensed under CC BY-NC 4.0" in flat:
            assert "CC-BY-NC" in got[d]
        if "icen" not in flat and "reserved" not in flat:
            assert got[d] == ""


def test_a_run_never_crosses_a_gap(spark):
    text = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nUnknown.\n\nAll rights reserved."
    row = licences.licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.sentences, row.licences) == ("bsd-source,reserved", "All-rights-reserved")
