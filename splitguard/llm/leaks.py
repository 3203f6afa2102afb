"""Benchmark decontamination: pieces of each item found exactly, then Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.storage import materialize

ERROR_RATE = 0.1  # edits allowed per character of the item
SHORT_CHARS = 20  # an item shorter than this must be there exactly, and not inside longer words
BLOCK_CHARS = 2_000_000  # characters of items matched in one pass over the documents
BATCH_ROWS = 2000

MATCHES = "doc_id {id}, item_id {item}, item_chars int, item_bytes int, distance int, budget int, match_end long"


def plain(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def _spaced(char: str) -> bool:
    """Whether the letter or digit belongs to a script that sets blanks between words."""
    return char.isalnum() and not ("\u0e00" <= char < "\u0f00" or "\u1000" <= char < "\u10a0" or "\u1780" <= char < "\u1800" or char >= "\u2e80")


def _inside_a_word(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] begins or ends within a word."""
    cuts = [c for c in (start, stop) if 0 < c < len(text)]
    return any(_spaced(text[c - 1]) and _spaced(text[c]) for c in cuts)


class _Item:
    """An item and its tree of pieces.

    budget + 1 pieces: that many edits leave at least one of them whole. By the same count, of two
    neighbouring groups of pieces that together have fewer edits than pieces, one has fewer edits than
    pieces too. So a match is found from some piece by way of ever larger groups that all pass.
    """

    def __init__(self, item_id, text: str, rate: float):
        self.item_id, self.text, self.short = item_id, text, len(text) < SHORT_CHARS
        self.budget = 0 if self.short else int(len(text) * rate)
        n, self.parts = len(text), self.budget + 1
        self.cuts = [n * i // self.parts for i in range(self.parts + 1)]
        self._masks: dict[str, int] | None = None

    def pieces(self) -> Iterator[tuple[int, str]]:
        for i in range(self.parts):
            yield i, self.text[self.cuts[i] : self.cuts[i + 1]]

    def passes(self, piece: int, text: str, start: int) -> bool:
        """Whether each group around the piece, but for the whole item, matches near text[start:] within its budget.

        A short item is one piece, which must not lie inside a word.
        """
        if self.short:
            return not _inside_a_word(text, start, start + len(self.text))
        width = 2
        while width < self.parts:
            first = piece - piece % width
            last = min(first + width, self.parts)
            edits, a, b = last - first - 1, self.cuts[first], self.cuts[last]
            if edits and self.distance(text, max(0, start + a - edits), min(len(text), start + b + edits), a, b)[0] > edits:
                return False
            width *= 2
        return True

    def distance(self, text: str, start: int, stop: int, a: int = 0, b: int | None = None) -> tuple[int, int]:
        """Smallest edit distance of item[a:b] to any part of text[start:stop], and where the first such part ends.

        Myers (1999): the column of the edit matrix as two bit vectors of its differences, one step per character.
        """
        if self._masks is None:
            self._masks = {}
            for i, c in enumerate(self.text):
                self._masks[c] = self._masks.get(c, 0) | 1 << i
        m = (len(self.text) if b is None else b) - a
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, start
        masks = self._masks.get
        for at in range(start, stop):
            match = masks(text[at], 0) >> a & full
            vertical = match | minus
            horizontal = (((match & plus) + plus) ^ plus) | match
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, at + 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return best, end


class _Matcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = [_Item(i, t, rate) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for i, piece in item.pieces():
                pieces.setdefault(piece, []).append((n, i))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[_Item, int, int]]:
        """(item, distance, end) for every item within its budget of some part of the text."""
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, piece in places:
                item = self.items[n]
                start = end + 1 - length - item.cuts[piece]
                if start not in starts.get(n, ()) and item.passes(piece, text, start):
                    starts.setdefault(n, set()).add(start)
        for n, found in starts.items():
            item = self.items[n]
            exact = [s for s in found if s >= 0 and text.startswith(item.text, s)]
            if exact:
                yield item, 0, min(exact) + len(item.text)
                continue
            best, best_end = len(item.text), 0
            for low, high in _windows(sorted(found), item.budget, len(item.text)):
                distance, end = item.distance(text, max(0, low), min(len(text), high))
                if distance < best:
                    best, best_end = distance, end
            if best <= item.budget:
                yield item, best, best_end


def _windows(starts: list[int], budget: int, length: int) -> Iterator[tuple[int, int]]:
    """Where a match can lie that begins within ``budget`` of one of the starts; overlapping ones are joined."""
    low, high = starts[0] - budget, starts[0] + length + budget
    for s in starts[1:]:
        if s - budget <= high:
            high = s + length + budget
        else:
            yield low, high
            low, high = s - budget, s + length + budget
    yield low, high


def leak_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs of document and item: doc_id, item_id, item_chars, item_bytes, distance, budget, match_end (in the plain text).

    Texts are compared in lower case with single blanks. A document holds an item if some part of it lies
    within ``int(error_rate * length of the item)`` edits of the whole item. An item of less than
    SHORT_CHARS characters must be there exactly and, in scripts with blanks between words, as whole words;
    how long it is stands in the row, for the caller to judge what such a hit says. NULL and empty texts
    match nothing; repeated rows and NULL ids give a row each. An item is one bit vector of its length,
    so verifying a hit takes time with the square of an item's length and memory in proportion to it.

    The items are the stated query set: they go through in blocks of about ``block_chars`` characters,
    one pass over the documents per block, and only one block at a time is held and broadcast. Items
    that repeat a text are found together.
    """
    ids = {"id": docs.schema[id_col].dataType.simpleString(), "item": items.schema[item_id_col].dataType.simpleString()}
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    found = [
        _matched(source, wanted.filter(block == b), MATCHES.format(**ids), error_rate, f"leaks_{b}" if n_blocks > 1 else None)
        for b in range(n_blocks)
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _matched(source: DataFrame, items: DataFrame, schema: str, rate: float, keep: str | None) -> DataFrame:
    rows = [(i, t) for i, t in ((r["item_id"], plain(r["text"])) for r in items.toLocalIterator()) if t]
    shared = source.sparkSession.sparkContext.broadcast(rows)
    item_type = items.schema["item_id"].dataType

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(shared.value, rate) if shared.value else None
        for batch in batches if matcher else ():
            keys, rows_ = batch.column(0), []
            for at, text in enumerate(batch.column(1).to_pylist()):
                rows_ += [(at, item.item_id, len(item.text), len(item.text.encode()), distance, item.budget, end) for item, distance, end in matcher(plain(text))] if text else []
                if len(rows_) >= BATCH_ROWS:
                    yield _match_batch(keys, rows_, kind)
                    rows_ = []
            if rows_:
                yield _match_batch(keys, rows_, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)
    out = source.mapInArrow(match, schema)
    if keep is None:
        return out
    out = materialize(out, keep)
    shared.unpersist()
    return out


def _match_batch(keys: pa.Array, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    at, item, chars, size, distance, budget, end = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(at, pa.int64())), pa.array(item, kind), *[pa.array(c, pa.int32()) for c in (chars, size, distance, budget)], pa.array(end, pa.int64())],
        names=["doc_id", "item_id", "item_chars", "item_bytes", "distance", "budget", "match_end"],
    )
