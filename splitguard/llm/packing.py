"""Best-fit packing of token sequences into rows of fixed capacity."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitguard.llm.ranks import ranked
from splitguard.storage import materialize

CAPACITY = 1024
BATCH_ROWS = 2000

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids binary"

# Texts made of these code points alone are cut alike by both libraries (a test compares them one by one).
PLAIN_TEXT = "[\t\n\r -~\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u0400-\u0481]*"
# The pre-token pattern of byte-level models (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = r"\S{2000}|\s{2000}"  # one pre-token of this length is better left to the slower library


class _Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    Plain texts go through a second library that is given the same vocabulary and pattern and is several
    times as fast; texts with other code points, special tokens or very long runs go through the first.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = _bytes_by_letter()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain, self.long_run = re.compile(PLAIN_TEXT).fullmatch, re.compile(LONG_RUN).search

    def __call__(self, text: str) -> bytes:
        if not self.plain(text) or self.long_run(text) or any(s in text for s in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return _packed(self.fast(text))


def _bytes_by_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@cache
def _encoder(file: str) -> _Encoder:
    """A Python worker keeps its encoder from task to task."""
    return _Encoder(file)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(
    docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Token sequences of at most ``capacity``: doc_id, piece, start, length, ids_crc32, ids.

    A document is its ids and then ``end_id``; a NULL or empty text is ``end_id`` alone. Only a longer
    one is cut, the first piece being the short one. Rows may repeat an id, and the id may be NULL.
    ``ids`` is NULL unless asked for. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = _packed([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file)
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0)
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                stop = n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    rows.append((at, piece, start, stop - start, zlib.crc32(own), own if with_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
                if len(rows) >= BATCH_ROWS:
                    yield _piece_batch(keys, rows)
                    rows = []
            if rows:
                yield _piece_batch(keys, rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES.format(id=id_type))


def _piece_batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, piece, start, length, crc, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
        ],
        names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
    )


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a materialized table of pieces with a ``length`` of 1 to capacity.

    The plan is made from the number of pieces of each length alone, at most ``capacity`` figures, and
    says how many sequences have which make-up. The k-th piece of a length then reads its place off the
    plan, so no task sees all pieces, and the packing is that of one packer over the whole table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rows = assignments(make_up(counts, capacity))
    plan = pieces.sparkSession.createDataFrame(rows, "_size long, _low long, _high long, _first long, _copies long, _offset long")
    numbered = ranked(pieces, "length", order)
    # One row per make-up and length: bounded by the capacity, whatever the number of pieces.
    placed = numbered.join(
        F.broadcast(plan), (F.col("length") == F.col("_size")) & (F.col("rank") >= F.col("_low")) & (F.col("rank") < F.col("_high"))
    )
    nth = F.col("rank") - F.col("_low")
    return placed.select(
        *[pieces[c] for c in pieces.columns],
        (F.col("_first") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )


MakeUp = tuple[tuple[int, int], ...]  # (length, how many of it) per sequence


def make_up(counts: dict[int, int], capacity: int) -> list[tuple[MakeUp, int]]:
    """How many sequences of which make-up hold ``counts`` pieces of each length.

    Pieces above a third of the capacity: at most two fit, so the longest is matched with the longest
    partner that fits, over and over. Shorter pieces, longest first, each go to the smallest gap that
    takes them. Both work on all pieces of a length and all sequences of a make-up at once.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    third = capacity // 3
    open_: dict[int, list[tuple[MakeUp, int]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, what: MakeUp, n: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((what, n))

    large = sorted(s for s in left if s > third)
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1
        while fits >= 0 and large[fits] == size and left[size] < 2:
            fits -= 1
        if fits < 0:
            put(capacity - size, ((size, 1),), left.pop(size))
            large.pop()
            continue
        other = large[fits]
        n = left[size] // 2 if other == size else min(left[size], left[other])
        put(capacity - size - other, ((size, 2),) if other == size else ((size, 1), (other, 1)), n)
        for s in (size, other):
            left[s] -= n
            if not left[s]:
                large.remove(s)
                del left[s]

    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(gaps, size)
            gap = gaps[at] if at < len(gaps) else capacity
            what, n = open_[gap].pop() if at < len(gaps) else ((), count)
            if gap in open_ and not open_[gap]:
                del open_[gap]
                gaps.remove(gap)
            each = gap // size
            full = min(n, count // each)
            rest = count - full * each if full < n else 0
            if full:
                put(gap - each * size, (*what, (size, each)), full)
            if rest:
                put(gap - rest * size, (*what, (size, rest)), 1)
            over = n - full - bool(rest)
            if over and what:
                put(gap, what, over)
            count -= full * each + rest
    return [(what, n) for gap in gaps for what, n in open_[gap]]


def assignments(plan: list[tuple[MakeUp, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, first sequence, copies per sequence, offset): where the pieces numbered low..high-1 go."""
    rows, taken, first = [], {}, 0
    for what, n in plan:
        offset = 0
        for size, copies in what:
            low = taken.get(size, 0)
            taken[size] = low + n * copies
            rows.append((size, low, low + n * copies, first, copies, offset))
            offset += size * copies
        first += n
    return rows


def packed_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: all documents packed.

    NULL ids, repeated rows and empty texts are packed like any other row.
    """
    pieces = materialize(token_pieces(docs, tokenizer_file, end_id, id_col, text_col, capacity, with_ids), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
