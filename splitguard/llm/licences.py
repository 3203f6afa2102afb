"""Licence scans by sentence rules: known sentences become identifiers, and ordered rules match runs of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: licence sentences as they are published, and the rules over their identifiers ---
# {v} stands for a version number. Sentences are compared in lower case, without marks other than letters and digits.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-ref": "Released under the MIT License",
    "mit-ref-2": "Licensed under the MIT License",
    "mit-ref-3": "This project is licensed under the MIT License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-ref": "Licensed under the BSD License",
    "bsd3-ref": "Licensed under the BSD 3-Clause License",
    "bsd2-ref": "Licensed under the BSD 2-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-ref": "Licensed under the Apache License, Version {v}",
    "apache-head": "Licensed under the Apache License, Version {v} (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-ref": "This work is licensed under the GNU General Public License, version {v}",
    "gpl-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {v} as published by the Free Software Foundation.",
    "gpl-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-ref": "This work is licensed under the GNU Lesser General Public License, version {v}",
    "agpl-ref": "This work is licensed under the GNU Affero General Public License, version {v}",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}",
    "cc-by-ref": "Licensed under CC BY {v}",
    "cc-by-sa-ref": "Licensed under CC BY-SA {v}",
    "cc-by-nc-ref": "Licensed under CC BY-NC {v}",
    "cc-by-nd-ref": "Licensed under CC BY-ND {v}",
    "cc-by-nc-sa-ref": "Licensed under CC BY-NC-SA {v}",
    "cc-by-nc-nd-ref": "Licensed under CC BY-NC-ND {v}",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution {v} International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License",
    "cc0-ref": "Released under CC0 {v}",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved",
}
# In this order; what a rule has matched is used up for those after it. A rule is a run of sentence identifiers.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("Apache", ("apache-head", "apache-copy", "apache-as-is")),
    ("Apache", ("apache-head",)),
    ("Apache", ("apache-ref",)),
    ("GPL-or-later", ("gpl-later", "gpl-no-warranty")),
    ("GPL-or-later", ("gpl-later",)),
    ("GPL-only", ("gpl-only", "gpl-no-warranty")),
    ("GPL-only", ("gpl-only",)),
    ("GPL", ("gpl-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("AGPL", ("agpl-ref",)),
    ("MPL", ("mpl-ref",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa-ref",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd-ref",)),
    ("CC-BY-SA", ("cc-by-sa-ref",)),
    ("CC-BY-SA", ("cc-by-sa-long",)),
    ("CC-BY-NC", ("cc-by-nc-ref",)),
    ("CC-BY-ND", ("cc-by-nd-ref",)),
    ("CC-BY", ("cc-by-ref",)),
    ("CC-BY", ("cc-by-long",)),
    ("CC0", ("cc0-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-ref-3",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD", ("bsd-ref",)),
    ("Unlicense", ("unlicense",)),
    ("All-rights-reserved", ("reserved",)),
)

# How a text falls into lines, paragraphs and parts; the SQL states the same rule with these.
WORD = r"[\p{L}\p{N}]"
LIST_MARK = r"(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})"
NOT_WORD = "[^0-9a-z]+"
VERSION = r"\b[0-9]+(?: [0-9]+)*\b"

_BLANK, _OTHER, _LETTER = 0x20, 0x01, 0x80


def _kinds() -> bytes:
    """A-Z to a-z; blanks, letters beyond ASCII and marks without a meaning here as one character each."""
    kept = set(b"abcdefghijklmnopqrstuvwxyz0123456789\n.!?;:)")
    return bytes(_LETTER if c > 127 else _BLANK if c in b" \t\r" else c if c in kept else _OTHER for c in bytes(range(256)).lower())


_KINDS = _kinds()
_WORDS_ONLY = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 else _BLANK for c in range(256))
_NO_WORD = re.compile(r"[^\w\x00-\x7F]+")
_EMPTY_LINE = re.compile(rb"\n[^a-z0-9\x80\n]*(?=\n)")
_VERSION_DOT = re.compile(rb"\bv\.")
_PART_END = re.compile(rb"[.!?]+(?: +| *(?:\n|\Z))|[;:] *\n")
_MARKED = re.compile(rb"[^a-z0-9\x80]*(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})\)[ \n]+")
_NUMBER = re.compile(rb"[0-9]{1,3}|[a-z]|[ivx]{1,4}")

FOUND = "pos int, width int, line int, sentence_id string, version string"


def normal_words(text: str) -> str:
    """The normal form of a known sentence: A-Z in lower case, words of ASCII letters and digits, numbers as v."""
    words = re.sub(NOT_WORD, " ", text.lower().replace("{v}", " 0 ")).strip()
    return re.sub(VERSION, "v", words)


def own_number(text: str) -> str | None:
    """The number that a known sentence without {v} must have, with dots, as 3 in BSD 3-Clause."""
    number = None if "{v}" in text else re.search(VERSION, re.sub(NOT_WORD, " ", text.lower()))
    return number and number.group().replace(" ", ".")


def _normal(words: list[bytes]) -> tuple[bytes, str | None]:
    """The words with every run of numbers as v, and the first such run with dots."""
    out, version, run = [], None, []
    for w in [*words, b""]:
        if w.isdigit():
            run.append(w)
            continue
        if run:
            out.append(b"v")
            version, run = version or b".".join(run).decode(), []
        out.append(w)
    return b" ".join(out[:-1]), version


class _Known:
    """The known sentences by their normal form, and by the parts they fall into where a line ends after ; or :"""

    def __init__(self, sentences: dict[str, str]):
        self.wholes: dict[bytes, list[tuple[str | None, str]]] = {}
        for i, s in sentences.items():
            self.wholes.setdefault(normal_words(s).encode(), []).append((own_number(s), i))
        self.parts: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
        for i, s in sentences.items():
            breaks = [m.end() for m in re.finditer(r"[;:](?=\s)", s)]
            for n in range(1, 1 << len(breaks)):
                cuts = [0, *[b for k, b in enumerate(breaks) if n >> k & 1], len(s)]
                first, *rest = [normal_words(s[a:b]).encode() for a, b in zip(cuts, cuts[1:])]
                self.parts.setdefault(first, []).append((tuple(rest), i))
        for runs in self.parts.values():
            runs.sort(key=lambda r: -len(r[0]))
        # A text without any of these words holds no known sentence: each has its longest one here.
        self.words = sorted({max((w for w in k.split() if w != b"v"), key=lambda w: (len(w), w)) for k in self.wholes})

    def possible(self, data: bytes) -> bool:
        return any(w in data for w in self.words)

    def found(self, text: str) -> list[tuple[int, int, int, str, str | None]]:
        """(pos, width, line, sentence_id, version) in order."""
        data = (text if text.isascii() else _NO_WORD.sub("\x01", text)).encode().translate(_KINDS)
        if not self.possible(data):
            return []
        out, pos = [], 0
        for paragraph in _EMPTY_LINE.split(_VERSION_DOT.sub(b"v ", data)):
            parts = list(_parts(paragraph))
            normal = [_normal(p.translate(_WORDS_ONLY).split()) for p in parts]
            at = 0
            while at < len(parts):
                width, sentence, version = self._longest(normal[at : at + 1 + self._most(normal[at][0])])
                if sentence:
                    out.append((pos + at, width, 0, sentence, version))
                elif b"\n" in parts[at]:
                    for n, line in enumerate(parts[at].split(b"\n"), 1):
                        own, version = _normal(line.translate(_WORDS_ONLY).split())
                        if sentence := self._whole(own, version):
                            out.append((pos + at, 1, n, sentence, version))
                at += width
            pos += len(parts)
        return out

    def _most(self, first: bytes) -> int:
        return len(self.parts[first][0][0]) if first in self.parts else 0

    def _whole(self, normal: bytes, version: str | None) -> str | None:
        return next((i for number, i in self.wholes.get(normal, ()) if number in (None, version)), None)

    def _longest(self, parts: list[tuple[bytes, str | None]]) -> tuple[int, str | None, str | None]:
        """(width, sentence_id, version) of the longest known sentence that the parts begin with."""
        (first, version), *after = parts
        for rest, sentence in self.parts.get(first, ()):
            if tuple(n for n, _ in after[: len(rest)]) == rest:
                return 1 + len(rest), sentence, next((v for _, v in parts[: 1 + len(rest)] if v), None)
        return 1, self._whole(first, version), version


def _parts(paragraph: bytes) -> Iterator[bytes]:
    """The parts that hold words and are no list number, without the mark that numbers them."""
    for part in _PART_END.split(paragraph):
        words = part.translate(_WORDS_ONLY).split()
        if not words and b"\x80" not in part:
            continue
        if len(words) == 1 and b"\x80" not in part and _NUMBER.fullmatch(words[0]):
            continue
        yield _MARKED.sub(b"", part, count=1) if _MARKED.match(part) else part


def _ruled(found: list[tuple]) -> tuple[str, str, str]:
    """(sentences, licences, versions): the rules in order take out their runs; a run never crosses a gap."""
    rest = [f"- {s[3]}" if before and not _follows(before, s) else s[3] for before, s in zip([None, *found], found)]
    rest, names = f" {'  '.join(rest)} ", set()
    for name, run in RULES:
        pattern = f" {'  '.join(run)} "
        if pattern in rest:
            names.add(name)
            rest = rest.replace(pattern, " # ")
    return ",".join(s[3] for s in found), ",".join(sorted(names)), ",".join(sorted({s[4] for s in found if s[4]}))


def _follows(before: tuple, here: tuple) -> bool:
    """Right after: the next part, or the next line of the same one."""
    return (here[0] == before[0] + before[1] and here[2] <= 1) or (here[0] == before[0] and here[2] == before[2] + 1)


def _scanned(docs: DataFrame, id_col: str, text_col: str, result: str, rows_of) -> DataFrame:
    """Rows of ``rows_of(found)`` per document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    types = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in result.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(SENTENCES)
        for batch in batches:
            at, rows = [], []
            for n in range(batch.num_rows):
                own = rows_of(known.found(batch.column(1)[n].as_py() or ""))
                at += [n] * len(own)
                rows += own
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", *[c.split()[0] for c in result.split(", ")]]
            )

    return source.mapInArrow(scan, f"doc_id {id_type}, {result}")


def licence_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The known sentences of each text in order: doc_id, pos, width, line, sentence_id, version.

    A line without words ends a paragraph. In it a part ends at . ! or ? before white space (but not after the
    word v) and at ; or : at the end of a line, so a sentence wrapped over lines is one part. Parts without
    words or with a list number only are none, and the mark of a numbered one, as in 1) or (a), is left
    out. Known sentences that hold a ; or : themselves are broken into the same parts, so a run of parts
    of one paragraph is looked up as such and no joined text is made; the first and longest found counts.
    A part of several lines that is unknown is looked up line by line (``line`` counts from 1; 0 is the
    whole). ``pos`` counts parts, ``width`` says how many make up the sentence, and ``version`` is the first
    number in it, with dots. Compared are words of ASCII letters and digits, A-Z in lower case and numbers as v.
    """
    return _scanned(docs, id_col, text_col, FOUND, lambda found: found)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, sentences (identifiers in order, comma-separated), licences (sorted), versions (sorted).

    The identifiers of a text form a sequence in which every stretch of unknown parts is a gap. Each
    rule in turn takes out all its runs; a run never crosses a gap. Texts without known sentences, NULL and
    empty ones have empty results. NULL ids and repeated rows come out as they went in. Other columns are
    not read. There is no shuffle: a text is one row, and what it holds is worked out where it is read.
    """
    return _scanned(docs, id_col, text_col, "sentences string, licences string, versions string", lambda found: [_ruled(found)])
