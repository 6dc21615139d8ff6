"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``LEAST`` words and ``POWER`` periods
that no neighbouring word extends with the same period.

1. *Grammar.*  The texts of a chunk become one sequence of word ids.  Re-Pair replaces pairs of neighbouring symbols by nonterminals, the more
   frequent pair first where two overlap; all pairs that no more frequent one overlaps are replaced in one round.  When rounds no longer
   shorten the sequence, what is left of each text is paired up to its root.
2. *Boundary runs.*  For every nonterminal, once, the runs that cross the boundary of its two children: one side of the boundary holds at least
   two periods, so candidate periods are those whose first word repeats there; the longest common extensions give the ends.
3. *Translation.*  A run is moved to every position at which its nonterminal was derived.  Every run of a text crosses the boundary of the
   smallest nonterminal around it, and is whole there; pieces of it in other nonterminals are merged into it.

Extensions compare rolling hashes; every run is then compared word by word, and where a hash was wrong the nonterminal is done again without
hashes.  A chunk is ``buffers.CHUNK_BYTES`` of whole texts (a longer text is a chunk of its own), so nothing is shuffled.

Nulls: a null text has no words; rows with a null id are treated like others.  Empty and blank texts have no runs.  Repeated rows are kept.
Runs that start at the same word are ordered by period.  An empty table gives an empty result.  Extra columns are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.llm.buffers import BASES, Windows, byte_column, chunk_rows, mixed, ranges, word_bounds
from turfline.session import dealt

by_value(__name__)

LEAST = 6
POWER = 4
#: A round that shortens the sequence by less than this share is the last one.
GAIN = 1 / 64
#: (nonterminal, period) candidates that are tested at once.
CANDIDATES = 1 << 21
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words only."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = data[ranges(starts, lengths)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of each key among the different keys, how many there are)."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _chosen(symbols: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, pair number) of the pairs to replace: no place overlaps another, and every pair occurs twice at least."""
    none = np.zeros(0, np.int64)
    if not inside.any():
        return none, none
    pair, n = _distinct(symbols[:-1] * (symbols.max() + 1) + symbols[1:])
    count = np.bincount(pair[inside], minlength=n)
    order = np.empty(n, np.int64)
    order[np.lexsort((mixed(np.arange(n)), count))] = np.arange(n)  # equally frequent pairs in mixed order, else few would lead their neighbours
    rank = np.where(inside & (count[pair] > 1), order[pair], -1)
    first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))  # stretches of one pair: a symbol that repeats itself
    size = np.diff(np.append(first, len(rank)))
    value = rank[first]
    top = (value >= 0) & (value > np.append(-1, value[:-1])) & (value > np.append(value[1:], -1))
    places = np.repeat(first[top], (size[top] + 1) // 2) + 2 * ranges(np.zeros(int(top.sum()), np.int64), (size[top] + 1) // 2)
    used = np.bincount(pair[places], minlength=n)
    places = places[used[pair[places]] > 1]
    return places, pair[places]


class Runs:
    """All runs of a sequence of word ids that consists of several texts (``texts``: the number of the text of every word)."""

    def __init__(self, words: np.ndarray, texts: np.ndarray, least: int = LEAST, power: int = POWER):
        if power < 4:
            raise ValueError("a run has at least four periods")
        self.words, self.texts, self.least, self.power = words, texts, least, power
        self.hashes = Windows(mixed((words + 1).astype(np.uint64)), BASES[1])
        self.found: list[np.ndarray] = []  # rows (text, period, start, end)
        self._grammar()

    def _grammar(self) -> None:
        starts = np.arange(len(self.words))
        ends, symbols, fresh, replacing = starts + 1, self.words.copy(), int(self.words.max(initial=0)) + 1, True
        while True:
            text = self.texts[starts]
            inside = text[1:] == text[:-1]
            if not inside.any():
                return
            if replacing:
                places, rule = _chosen(symbols, inside)
                replacing = len(places) > GAIN * len(symbols)
            if not replacing:  # pair up what is left, from the start of every text
                head = np.flatnonzero(np.append(True, ~inside))
                odd = (np.arange(len(symbols)) - np.repeat(head, np.diff(np.append(head, len(symbols))))) % 2 == 1
                places = np.flatnonzero(odd[1:] & inside)
                rule = np.arange(len(places))
            rule, n = _distinct(rule)
            self._derived(rule, n, starts[places], ends[places], ends[places + 1])
            symbols[places] = fresh + rule
            ends[places] = ends[places + 1]
            fresh += n
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            starts, ends, symbols = starts[keep], ends[keep], symbols[keep]

    def _derived(self, rule: np.ndarray, n: int, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        """Boundary runs of the ``n`` nonterminals of a round, each at one place, translated to all of its places."""
        one = np.zeros(n, np.int64)
        one[rule[::-1]] = np.arange(len(rule))[::-1]
        size = (end - start)[one]
        worth = np.flatnonzero(size >= max(self.least, self.power))
        s, m, e = (x[one[worth]] for x in (start, middle, end))
        at = self._crossing(s, m, e)
        if not len(at):
            return
        owner = worth[at[:, 0]]
        of, count = np.unique(owner, return_counts=True)  # rows of ``at`` are in the order of their nonterminals
        slot = np.full(n, -1)
        slot[of] = np.arange(len(of))
        places = np.flatnonzero(slot[rule] >= 0)
        each = slot[rule[places]]
        row = at[ranges((np.cumsum(count) - count)[each], count[each])]
        shift = np.repeat(start[places], count[each])
        self.found.append(np.stack([self.texts[shift], row[:, 1], row[:, 2] + shift, row[:, 3] + shift], axis=1))

    def _crossing(self, s: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Rows (nonterminal, period, start, end), start and end counted from the start of the nonterminal."""
        out, tried = [np.zeros((0, 4), np.int64)], [np.zeros((0, 3), np.int64)]
        for right in (True, False):
            most = np.minimum((e - m if right else m - s) // 2, (e - s) // self.power)
            bounds = np.searchsorted(np.cumsum(most), np.arange(CANDIDATES, int(most.sum()) + CANDIDATES, CANDIDATES))
            for low, high in zip(np.append(0, bounds[:-1] + 1), bounds + 1):
                own = np.arange(low, min(high, len(s)))
                k, q = np.repeat(own, most[own]), ranges(np.ones(len(own), np.int64), most[own])
                a = m[k] if right else m[k] - q  # the run repeats at a and at a + q
                near = self.words[a] == self.words[a + q] if right else self.words[a - 1] == self.words[a + q - 1]
                k, q, a = k[near], q[near], a[near]
                block = a if right else a - q
                near = self.hashes.of(block, q) == self.hashes.of(block + q, q)
                k, q, a = k[near], q[near], a[near]
                start, end = a - self._back(a, a + q, a - s[k]), a + q + self._ahead(a, a + q, e[k] - a - q)
                out.append(np.stack([k, q, start, end], axis=1))
                tried.append(np.stack([k, q, a], axis=1))
        at = self._smallest(np.concatenate(out))
        wrong = ~self._true(at)
        if wrong.any():
            again = np.unique(at[wrong, 0])
            redo = np.concatenate(tried)
            redo = redo[np.isin(redo[:, 0], again)]
            plain = np.array([self._plain(k, q, a, int(s[k]), int(e[k])) for k, q, a in redo.tolist()], np.int64).reshape(-1, 4)
            at = self._smallest(np.concatenate([at[~np.isin(at[:, 0], again)], plain]))
        return at - np.stack([np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), s[at[:, 0]], s[at[:, 0]]], axis=1)

    def _smallest(self, at: np.ndarray) -> np.ndarray:
        """Long enough stretches, each with its smallest period: a multiple of the period has the same ends."""
        at = at[at[:, 3] - at[:, 2] >= np.maximum(self.least, self.power * at[:, 1])]
        at = at[np.lexsort((at[:, 1], at[:, 3], at[:, 2], at[:, 0]))]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:, [0, 2, 3]] != at[:-1, [0, 2, 3]]).any(axis=1)
        return at[new]

    def _ahead(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How far the words from a and from b on are the same, by hash."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = self.hashes.of(a, half) == self.hashes.of(b, half)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        return low

    def _back(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How far the words before a and before b are the same, by hash."""
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = self.hashes.of(a - half, half) == self.hashes.of(b - half, half)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        return low

    def _true(self, at: np.ndarray) -> np.ndarray:
        """Whether the words of each stretch repeat with its period."""
        true = np.ones(len(at), bool)
        size = at[:, 3] - at[:, 2] - at[:, 1]
        for low, high in chunk_rows(size, CANDIDATES):
            place = ranges(at[low:high, 2], size[low:high])
            same = self.words[place] == self.words[place + np.repeat(at[low:high, 1], size[low:high])]
            true[low:high] = np.logical_and.reduceat(same, np.cumsum(size[low:high]) - size[low:high])
        return true

    def _plain(self, k: int, q: int, a: int, s: int, e: int) -> tuple[int, int, int, int]:
        """The stretch around words a and a + q that repeats with period q, compared word by word."""
        w, far, near = self.words, e - a - q, a - s
        ahead = np.flatnonzero(w[a:a + far] != w[a + q:e])
        back = np.flatnonzero(w[s:a][::-1] != w[s + q:a + q][::-1])
        return k, q, a - (int(back[0]) if len(back) else near), a + q + (int(ahead[0]) if len(ahead) else far)

    def maximal(self) -> np.ndarray:
        """Rows (text, start, end, period) of all runs, in this order."""
        at = np.concatenate(self.found) if self.found else np.zeros((0, 4), np.int64)
        at = at[np.lexsort((-at[:, 3], at[:, 2], at[:, 1], at[:, 0]))]
        if len(at):
            group = np.append(0, np.cumsum((at[1:, :2] != at[:-1, :2]).any(axis=1)))
            reach = np.maximum.accumulate(at[:, 3] + group * (len(self.words) + 1)) - group * (len(self.words) + 1)
            piece = np.zeros(len(at), bool)
            piece[1:] = (group[1:] == group[:-1]) & (at[1:, 3] <= reach[:-1])
            at = at[~piece]
        return at[np.lexsort((at[:, 1], at[:, 2], at[:, 0]))][:, [0, 2, 3, 1]]


def _chunk(ids: pa.Array, data: np.ndarray, at: np.ndarray, least: int, power: int) -> pa.RecordBatch:
    starts, ends, first = word_bounds(data, at)
    counts = np.diff(first)
    runs = Runs(word_ids(data, starts, ends), np.repeat(np.arange(len(counts)), counts), least, power).maximal()
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 2], -1)
    kept = np.cumsum(edge[:-1]) == 0
    raw, owned = data.tobytes(), np.searchsorted(runs[:, 0], np.arange(len(counts) + 1))
    texts = []
    for i, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if owned[i] == owned[i + 1]:
            texts.append(b" ".join(raw[low:high].split()))
        else:
            own = np.flatnonzero(kept[first[i]:first[i + 1]]) + first[i]
            texts.append(b" ".join(raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())))
    rows = pa.StructArray.from_arrays([pa.array(runs[:, 1] - first[runs[:, 0]]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])],
                                      ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(owned, pa.int32()), rows)
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), listed, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``documents`` (doc_id, text).

    ``runs`` is in the order of start and period; ``collapsed`` is the text, words joined by one space, without the words that a run contains
    after its first period.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            data, at = byte_column(batch.column(1))
            for low, high in chunk_rows(np.diff(at)):
                yield _chunk(ids.slice(low, high - low), data[at[low]:at[high]], at[low:high + 1] - at[low], least, power)

    return dealt(documents.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a repetition in every document whose crc32 of the id is divisible by ten, the others as they are.

    With h that crc32, g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)): word i >= a becomes the
    original word a + (i - a) % p.  Other rows, also those without an id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n))
    some = some.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return some.select("doc_id", F.when(n > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))
