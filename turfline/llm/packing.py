"""Packing of tokenized documents into fixed windows by non-negative least squares over the length histogram.

A document of n tokens gives n // window full pieces; what is left is cut once at a multiple of ``UNIT`` tokens, which leaves
a tail shorter than a unit.  So only window / UNIT + UNIT lengths occur, and the whole plan is made from their histogram:

1. Enumerate every combination of at most ``DEPTH`` unit lengths that fills the window exactly.
2. Solve for the repeat counts of the combinations against the histogram by non-negative least squares, and round down.
3. Pack what the rounding leaves, and the tails, greedily: the longest lengths that fit make a pattern, which repeats as
   often as the histogram has its lengths.

The plan has a bounded size whatever the corpus.  A piece finds its place by its rank among the pieces of its length, which is
its rank inside its task plus the counts of the tasks before it, so no piece is gathered or sorted.  Text is tokenized once.

Nulls: a null text is empty and gives the closing id alone; null ids are carried.  Repeated rows are packed each.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.llm.buffers import byte_column, chunk_rows, ranges, word_bounds
from turfline.llm.part_ids import PartIds
from turfline.session import stage

by_value(__name__)

WINDOW = 2048
UNIT = 16
DEPTH = 3
CLOSING = 1
_LETTERS, _WHOLE, _TAIL, _NOTHING = range(4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?$#*&%|")] = True


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, kinds, parts before each text): the words of texts as parts that are tokenized apart.

    A word of ASCII and accented Latin-1 letters, then marks, is two pre-tokens: its letters, in lower case, and its
    marks.  So words that differ in case or marks share a part.  Any other word is one part as it stands.
    """
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    low, letter = _LOWER[data], _LETTER[data]
    value = data[second]
    low[second[(value <= 0x9E) & (value != 0x97)]] += 0x20
    letter[second] = (value != 0x97) & (value != 0xB7)
    starts, ends, first = word_bounds(data, offsets)
    place = np.where(_MARKS[data], -1, np.arange(len(data)))
    core = np.maximum(np.maximum.accumulate(place)[ends - 1] + 1, starts) if len(starts) else ends
    strange = np.concatenate([[0], np.cumsum(~letter)])
    simple = strange[core] == strange[starts]
    n = len(data)
    from_ = np.stack([np.where(simple, starts, starts + n), core + n], axis=1).ravel()
    to = np.stack([np.where(simple, core, ends + n), ends + n], axis=1).ravel()
    kind = np.stack([np.where(simple, _LETTERS, _WHOLE), np.where(simple, _TAIL, _NOTHING)], axis=1).ravel()
    real = (to > from_) & (kind != _NOTHING)
    before = np.concatenate([[0], np.cumsum(real)])[2 * first]
    return np.concatenate([low, data]), from_[real], to[real], kind[real], before


#: Texts that show whether a tokenizer takes words apart as ``word_parts`` does.
_PROBES = ["Hello, World!! ÉCOLE straße's don't co-op 12,5% x_y #tag @me 😀 漢字 ÷×Ø Ünï.", " a  b\tc\nd\x0be\x1cf ", "Über?! ab12 A.B.C. ... (x) \"q\" a,b", "", "İ Ωσς ﬁ ñandú; Naïve:: co.uk"]


class WordIds:
    """Token ids of texts by way of their words, if no token of the tokenizer spans white space and letters of both cases are alike.

    Then a part of letters has exactly one token that ends a word, so new ones are encoded as one text.  Whether a tokenizer is of this kind is tried on
    probe texts when it is loaded; with any other, texts are encoded whole.
    """

    def __init__(self, path: str, closing: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.closing = closing
        self.memory = PartIds(self._encode, np.array([closing]))
        self.by_words = self._splits()

    def _splits(self) -> bool:
        raw = [x.encode() for x in _PROBES]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        whole = self._whole(data, offsets)
        try:
            parts = self._by_words(data, offsets)
        except (ValueError, IndexError):  # the parts have not one closing token each
            return False
        return bool(self.ends_word.any()) and all(np.array_equal(a, b) for a, b in zip(whole, parts))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [[*e.ids, self.closing] for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)

    def _encode(self, parts: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode() for x in parts]
        own, other = np.flatnonzero(kinds == _LETTERS), np.flatnonzero(kinds != _LETTERS)
        sizes = np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = []
        for low in range(0, len(own), 10_000):
            some = own[low:low + 10_000]
            ids.append(np.array(self.tokenizer.encode(" ".join([texts[i] for i in some.tolist()]), add_special_tokens=False).ids, np.int64))
            sizes[some] = np.diff(np.flatnonzero(self.ends_word[ids[-1]]), prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in other.tolist()], add_special_tokens=False)] if len(other) else []
        sizes[other] = [len(x) for x in found]
        flat = np.concatenate([*ids, np.fromiter(itertools.chain.from_iterable(found), np.int64)])
        order = np.concatenate([own, other])
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[ranges(begin, sizes)], sizes

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the closing id; ids of each text)."""
        return self._by_words(data, offsets) if self.by_words else self._whole(data, offsets)

    def _by_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buffer, starts, ends, kinds, before = word_parts(data, offsets)
        codes = np.insert(self.memory.codes(buffer, starts, ends, kinds), before[1:], 0)
        ids, sizes = self.memory.ids_of(codes)
        total = np.cumsum(sizes)[before[1:] + np.arange(len(before) - 1)]
        return ids, np.diff(total, prepend=0)


_loaded: dict[tuple[str, int], WordIds] = {}


def _encoder(path: str, closing: int) -> WordIds:
    if (path, closing) not in _loaded:
        _loaded[path, closing] = WordIds(path, closing)
    return _loaded[path, closing]


def cuts(tokens: int, window: int = WINDOW, unit: int = UNIT) -> list[int]:
    """The lengths of a document's pieces."""
    rest = tokens % window
    return [window] * (tokens // window) + [x for x in (rest - rest % unit, rest % unit) if x]


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, closing: int = CLOSING) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank): rank counts the pieces of this length in this part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), _encoder(tokenizer_path, closing)
        for batch in batches:
            data, at = byte_column(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for low, high in chunk_rows(np.diff(at)):
                flat, sizes = encoder.of(data[at[low]:at[high]], at[low:high + 1] - at[low])
                raw = memoryview(flat.astype("<u4").tobytes())
                rows: list[tuple] = []
                begin = 0
                for i, n in enumerate(sizes.tolist()):
                    start = 0
                    for length in cuts(n, window, unit):
                        rows.append((low + i, start, length, zlib.crc32(raw[4 * (begin + start):4 * (begin + start + length)]), n, seen[length]))
                        seen[length] += 1
                        start += length
                    begin += n
                table = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in (1, 2, 3, 4)),
                                                  pa.array(np.full(len(table), part, np.int64)), pa.array(table[:, 5])],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])
    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long")


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Every falling tuple of at most ``depth`` whole numbers from 1 with this sum, but the single one."""
    def of(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest <= most and rest > 0:
            yield (rest,)
        if left > 1:
            for x in range(min(most, rest - 1), 0, -1):
                if rest - x <= x * (left - 1):
                    yield from ((x, *more) for more in of(rest - x, x, left - 1))
    return [c for c in of(total, total - 1, depth)]


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[active] = -np.inf
        best = int(pull.argmax())
        if pull[best] <= slack:
            break
        active[best] = True
        while True:
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (trial <= 0)
            if not low.any():
                x = trial
                break
            if low[best] and x[best] == 0:  # numerically spent
                active[best] = False
                trial[best] = 0
                low = active & (trial <= 0)
                if not low.any():
                    return x
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: pieces of it in one sequence})], which uses up the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c}
    done: list[tuple[int, dict[int, int]]] = []

    def use(times: int, pattern: dict[int, int]) -> None:
        done.append((times, pattern))
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]

    if window in left:
        use(left[window], {window: 1})
    ways = [c for c in combinations(window // unit, depth) if all(x * unit in left for x in c)]
    if ways:
        a = np.zeros((window // unit, len(ways)))
        for column, way in enumerate(ways):
            for x in way:
                a[x, column] += 1
        b = np.array([left.get(x * unit, 0) for x in range(window // unit)], float)
        repeats = np.floor(non_negative(a, b) + 1e-6).astype(int)
        for column in np.argsort(-repeats, kind="stable").tolist():
            pattern: dict[int, int] = {}
            for x in ways[column]:
                pattern[x * unit] = pattern.get(x * unit, 0) + 1
            times = min([int(repeats[column]), *(left.get(n, 0) // k for n, k in pattern.items())])
            if times:
                use(times, pattern)
    while left:
        room, pattern = window, {}
        for n in sorted(left, reverse=True):
            k = min(left[n], room // n)
            if k:
                pattern[n] = k
                room -= k * n
        use(min(left[n] // k for n, k in pattern.items()), pattern)
    return done


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, closing: int = CLOSING) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece at its place in a sequence."""
    if window % unit:
        raise ValueError("the window must be a whole number of units")
    found = stage(pieces(documents, tokenizer_path, window, unit, closing), "pieces")
    counts = stage(found.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window / unit + unit rows at most
    slots: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    sequence = 0
    for times, pattern in plan(histogram, window, unit, depth):
        offset = 0
        for n, k in pattern.items():
            slots[n].append((times * k, k, sequence, offset))
            offset += n * k
        sequence += times
    tables = {n: (np.concatenate([[0], np.cumsum([s[0] for s in own])]), *(np.array([s[i] for s in own]) for i in (1, 2, 3))) for n, own in slots.items()}
    before = counts.selectExpr("part", "length", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                ends, each, first, begin = tables[n]
                slot = np.searchsorted(ends, rank[own], side="right") - 1
                inside = rank[own] - ends[slot]
                where[own] = first[slot] + inside // each[slot]
                offset[own] = begin[slot] + inside % each[slot] * n
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(where), pa.array(offset)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return found.join(before, ["part", "length"]).mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
