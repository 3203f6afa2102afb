"""Token counts of a sentencepiece BPE model by merging ragged arrays of symbols rank by rank."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1_500_000
LONG_WORD = 64
MERGE_SYMBOLS = 2_000_000  # symbols merged together; bounds the arrays of one round
SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max


class PieceModel:
    """What the model says about pairs: symbols are numbered, and a pair of numbers leads to (rank, symbol).

    Pieces are merged by their score, ties to the left. A character that is no piece counts one token per
    UTF-8 byte if the model has bytes to fall back on, else one.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.processor
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        pieces = [sp.id_to_piece(i) for i in usable]
        scores = np.array([sp.get_score(i) for i in usable])
        ranks = np.unique(-scores, return_inverse=True)[1]
        self.has_bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        symbols: dict[str, int] = {p: i for i, p in enumerate(pieces)}
        self.known_chars = {p for p in pieces if len(p) == 1}
        for piece in pieces:
            for char in piece:
                symbols.setdefault(char, len(symbols))
        self.symbols, self.size = symbols, len(symbols)
        keys, rank, made = [], [], []
        for at, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    rank.append(ranks[at])
                    made.append(at)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], NO_RANK)
        self.rank = np.append(np.array(rank, dtype=np.int64)[order], NO_RANK)
        self.made = np.append(np.array(made, dtype=np.int64)[order], -1)
        # Two neighbouring characters that stand side by side in no piece are never merged across.
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("this model has pieces that run over a blank; counting by words would be wrong")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of each pair; NO_RANK and -1 where there is none."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NO_RANK), np.where(hit, self.made[at], -1)

    def runs(self, word: str) -> list[str]:
        """A long word cut where no merge can cross; a short one is left whole, with the same result."""
        if len(word) <= LONG_WORD:
            return [word]
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def lone_tokens(self, char: str) -> int:
        return 1 if char in self.known_chars or not self.has_bytes else len(char.encode())

    def count_runs(self, runs: list[str]) -> list[int]:
        """Tokens of each run. Runs are merged together as ragged arrays, in blocks of bounded size."""
        counts: list[int] = []
        start = 0
        while start < len(runs):
            stop, size = start, 0
            while stop < len(runs) and (stop == start or size + len(runs[stop]) <= MERGE_SYMBOLS):
                size += len(runs[stop])
                stop += 1
            counts += self._merge(runs[start:stop])
            start = stop
        return counts

    def _merge(self, runs: list[str]) -> list[int]:
        text = "".join(runs)
        get = self.symbols.get
        symbol = np.fromiter((get(c, -1) for c in text), dtype=np.int64, count=len(text))
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        # Characters that are no piece and were never merged into one count by themselves.
        lone = {get(c): self.lone_tokens(c) for c in set(text) - self.known_chars if get(c) is not None}
        result = np.zeros(len(runs), dtype=np.int64)
        for i, c in enumerate(text) if -1 in symbol else ():
            if symbol[i] == -1:
                result[owner[i]] += self.lone_tokens(c)
        live = symbol >= 0
        # A character outside all pieces parts its neighbours, so it stays as a wall of symbol -1.
        weight_of = np.ones(self.size, dtype=np.int64)
        for s, w in lone.items():
            weight_of[s] = w
        rank, made = self._neighbours(symbol, owner)
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            busy = best < NO_RANK
            if not busy.all():
                # Finished sequences are counted and leave the arrays.
                per = np.diff(np.append(first, len(symbol)))
                ended = np.repeat(~busy, per)
                got = symbol[ended]
                np.add.at(result, owner[ended][got >= 0], weight_of[got[got >= 0]])
                stay = ~ended
                symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
                if not len(symbol):
                    break
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                best = best[busy]
            per = np.diff(np.append(first, len(symbol)))
            symbol, owner, rank, made = self._apply(symbol, owner, rank == np.repeat(best, per), made, np.repeat(best, per))
        return result.tolist()

    def _neighbours(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbol), NO_RANK), np.full(len(symbol), -1)
        if len(symbol) > 1:
            r, m = self.pairs(symbol[:-1], symbol[1:])
            same = owner[:-1] == owner[1:]
            rank[:-1], made[:-1] = np.where(same, r, NO_RANK), np.where(same, m, -1)
        return rank, made

    def _apply(self, symbol, owner, wanted, made, best) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge each sequence's lowest-rank pair at all its places, from the left, as long as that is what one
        merge after the other would do: up to the first place whose merge makes a pair of no higher rank."""
        at = np.flatnonzero(wanted)
        # Places overlap where one follows the other at once; of such a chain every second one merges.
        chain = np.append(True, np.diff(at) > 1)
        head = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        merged = symbol.copy()
        merged[at] = made[at]
        gone = np.zeros(len(symbol), dtype=bool)
        gone[at + 1] = True
        keep = np.flatnonzero(~gone)
        rank, after = self._neighbours(merged[keep], owner[keep])
        # rank[i] is that of keep[i] and its right neighbour; look at both sides of each merged place.
        where = np.searchsorted(keep, at)
        right = rank[where]
        left = np.where(where > 0, rank[np.maximum(where - 1, 0)], NO_RANK)
        early = np.minimum(left, right) <= best[at]
        if early.any():
            seq = owner[at]
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(seq))))
            order = np.arange(len(at))
            stop = np.minimum.reduceat(np.where(early, order, len(at)), start)
            at = at[order <= stop[which]]
            merged = symbol.copy()
            merged[at] = made[at]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[at + 1] = True
            keep = np.flatnonzero(~gone)
            rank, after = self._neighbours(merged[keep], owner[keep])
        return merged[keep], owner[keep], rank, after



class _Counter:
    def __init__(self, model_file: str):
        self.model = PieceModel(model_file)
        # Words end at blanks, and at line ends and tabs too unless pieces run over those.
        free = "".join(c for c in "\n\r\t" if not any(c in pair for pair in self.model.inside))
        own = f"|[{free}]" if free else ""
        self.words = re.compile(f"{SPACE}+[^{SPACE}{free}]*|[^{SPACE}{free}]+{own}")
        self.cache: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        """Token counts of a batch: its words are looked up, and those not seen before are merged together."""
        normalize = self.model.processor.normalize
        split = [self.words.findall(normalize(t)) if t else [] for t in texts]
        missing = {w for own in split for w in own if w not in self.cache}
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = set().union(*split)
        words = list(missing)
        runs = [self.model.runs(w) for w in words]
        flat = self.model.count_runs([r for own in runs for r in own])
        at = 0
        for word, own in zip(words, runs):
            self.cache[word] = sum(flat[at : at + len(own)])
            at += len(own)
        get = self.cache.__getitem__
        return [sum(map(get, own)) for own in split]


@cache
def _counter(file: str) -> _Counter:
    """A Python worker keeps its model, and the words it has seen, from task to task."""
    return _Counter(file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens of the whole text; no begin, end or other added tokens.

    A NULL or empty text has no tokens. Rows may repeat an id and the id may be NULL. Other columns are
    not read; an empty table gives no rows. There is no shuffle. Normalisation is the model's own.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for part in _by_size(texts):
                counts += counter(part)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")


def _by_size(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters, so that the words of a batch stay few; a longer text is its own run."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
