"""Fill-in-middle texts: cuts at unit ends, found from what content-defined chunks are known to hold."""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32  # bytes the rolling hash looks back on
CUT_BITS = 10  # a chunk ends where so many leading bits of the hash are 0, so after 1 KB on average
LEAST_CHUNK, MOST_CHUNK = 256, 65_536
CACHE_BYTES = 32_000_000  # chunks a worker remembers; what falls out is worked out again
SLAB = 4_000_000  # bytes hashed at once
OUT_BYTES = 16_000_000  # texts handed back at once

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_GEAR = np.random.default_rng(WINDOW).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Per byte a hash of the last WINDOW bytes: each adds its random number, shifted by its distance."""
    out = _GEAR[data]
    step = 1
    while step < WINDOW:
        out[step:] += out[:-step] << np.uint32(step)
        step *= 2
    return out


def _possible_ends(data: bytes) -> np.ndarray:
    """Where the hash lets a chunk end, worked out slab by slab."""
    found = []
    for start in range(0, len(data), SLAB):
        first = max(0, start - WINDOW + 1)
        hashes = rolling_hash(np.frombuffer(data, np.uint8, min(len(data), start + SLAB) - first, first))
        found.append(np.flatnonzero(hashes[start - first :] >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _chunk_ends(size: int, possible: list[int]) -> list[int]:
    """The ends that keep to the least and most size of a chunk."""
    ends, last = [], 0
    for end in [p for p in possible if p >= WINDOW] + [size]:
        while end - last > MOST_CHUNK:
            last += MOST_CHUNK
            ends.append(last)
        if end - last >= LEAST_CHUNK or end == size > last:
            ends.append(end)
            last = end
    return ends


def _chars(data: bytes) -> int:
    """Code points that begin in these bytes; they need not begin or end with one."""
    return len(data) if data.isascii() else len(data) - int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 == 0x80))


class _Summary:
    """How many separators and code points a chunk has, and, once asked for, where its units end."""

    __slots__ = ("chars", "ends", "separators")

    def __init__(self, chunk: bytes, separator: bytes):
        self.separators, self.chars, self.ends = chunk.count(separator), _chars(chunk), None

    def end(self, chunk: bytes, separator: bytes, number: int) -> int:
        if self.ends is None:
            self.ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == separator[0]) + 1
        return int(self.ends[number - 1])


class Memo:
    """Summaries of chunks by their content; equal bytes, not only equal hashes, make a hit. The least lately used ones go."""

    def __init__(self, separator: bytes, most: int = CACHE_BYTES):
        self.separator, self.most, self.held, self.hits = separator, most, 0, 0
        self.known: OrderedDict[bytes, _Summary] = OrderedDict()

    def __call__(self, chunk: bytes) -> _Summary:
        summary = self.known.get(chunk)
        if summary is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return summary
        summary = self.known[chunk] = _Summary(chunk, self.separator)
        self.held += len(chunk)
        while self.held > self.most:
            self.held -= len(self.known.popitem(last=False)[0])
        return summary


class _Text:
    """A text as its chunks, with running counts of separators and code points."""

    def __init__(self, data: bytes, ends: list[int], memo: Memo):
        self.data, self.memo = data, memo
        self.starts = [0, *ends[:-1]] if ends else []
        self.chunks = [data[a:b] for a, b in zip(self.starts, ends)]
        self.summaries = [memo(c) for c in self.chunks]
        self.separators = list(accumulate((s.separators for s in self.summaries), initial=0))
        self.chars = list(accumulate((s.chars for s in self.summaries), initial=0))
        self.n = self.separators[-1] + (bool(data) and not data.endswith(memo.separator))

    def unit_end(self, number: int) -> tuple[int, int]:
        """Where the first ``number`` units end: (byte, code point)."""
        if number == 0:
            return 0, 0
        if number == self.n:
            return len(self.data), self.chars[-1]
        at = bisect_right(self.separators, number - 1) - 1
        chunk = self.chunks[at]
        end = self.summaries[at].end(chunk, self.memo.separator, number - self.separators[at])
        return self.starts[at] + end, self.chars[at] + _chars(chunk[:end])


def _texts(values: list[bytes], memo: Memo) -> Iterator[_Text]:
    """Short texts are hashed together; a chunk never runs over the end of a text, nor its hash over the beginning."""
    part: list[bytes] = []
    size = 0
    for at, value in enumerate(values):
        part.append(value)
        size += len(value)
        if size >= SLAB or at == len(values) - 1:
            possible = _possible_ends(b"".join(part))
            bounds = [0, *accumulate(map(len, part))]
            places = np.searchsorted(possible, bounds, side="right")
            for n, own in enumerate(part):
                yield _Text(own, _chunk_ends(len(own), (possible[places[n] : places[n + 1]] - bounds[n]).tolist()), memo)
            part, size = [], 0


def _turned(text: _Text, draws: list[int], marks: list[bytes], fim_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)"""
    data, (first, second, changed, form) = text.data, draws
    if not data or any(m in data for m in marks) or changed % 100 >= fim_percent:
        return text.n, "plain", None, None, data
    low, high = sorted((first % (text.n + 1), second % (text.n + 1)))
    (a, a_chars), (b, b_chars) = text.unit_end(low), text.unit_end(high)
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    if form % 100 < spm_percent:
        return text.n, "spm", a_chars, b_chars - a_chars, suffix + prefix + middle
    return text.n, "psm", a_chars, b_chars - a_chars, prefix + suffix + middle


def draws_of(key: Column, seed: int) -> Column:
    """Four numbers per key: the first four groups of eight digits of the hex SHA-256 of seed:key. NULL is as empty."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, separator: str = "\n", fim_percent: int = 100, spm_percent: int = 50,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Per row of ``docs``: row (a struct of its other columns), n, form, prefix_chars, middle_chars, output.

    A unit ends after each ``separator`` (one ASCII character) and at the end of the text; n counts them. Two
    cuts after whole units, drawn from the id, part the text into prefix, middle and suffix. Form psm is
    prefix, suffix, middle, each behind its mark of ``marks``; spm is suffix, prefix, middle; plain is the
    text itself, for texts that are empty or hold a mark and for a share of 100 - ``fim_percent``. Counts
    are in code points and NULL where plain. ``restored`` gives the text back.

    A NULL text is an empty one and a NULL id draws as an empty one; rows that share an id are cut by the
    same draws, each in its own text. An empty table gives no rows. There is no shuffle.

    The text is cut into chunks where a rolling hash says so, so equal passages mostly become equal chunks
    in whatever text they stand; what a chunk holds is remembered by its content. The counts of its chunks
    say in which one a cut lies, and only there is it looked for.
    """
    if len(separator.encode()) != 1:
        raise ValueError("the separator must be one ASCII character")
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.struct(*others).alias("row"), text.cast("binary").alias("text"), draws_of(F.col(id_col), seed).alias("draws"))
    row_type = source.schema["row"].dataType.simpleString()
    coded = [m.encode() for m in marks]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(separator.encode())
        for batch in batches:
            at = 0
            for stop in _row_ends(batch.column(1)):
                part = batch.slice(at, stop - at)
                at = stop
                draws = part.column(2).to_pylist()
                made = [_turned(t, d, coded, fim_percent, spm_percent) for t, d in zip(_texts(part.column(1).to_pylist(), memo), draws)]
                n, form, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return source.mapInArrow(turn, f"row {row_type}, {RESULT}")


def _row_ends(texts: pa.Array) -> list[int]:
    """Ends of runs of rows with about OUT_BYTES of text."""
    import pyarrow.compute as pc

    before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    slab = before // OUT_BYTES
    return [*(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(texts)] if len(texts) else []


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that became ``output``. Texts that hold a mark stay plain, so the first mark of each kind is the one set."""
    p, s, m = marks
    at = lambda mark: F.instr(output, mark)
    piece = lambda start, mark, stop: F.substring(output, start + len(mark), stop - start - len(mark))
    rest = piece(at(m), m, F.length(output) + 1)
    psm = F.concat(piece(at(p), p, at(s)), rest, piece(at(s), s, at(m)))
    spm = F.concat(piece(at(p), p, at(m)), rest, piece(at(s), s, at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
