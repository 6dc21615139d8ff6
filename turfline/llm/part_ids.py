"""A worker's memory of the token ids of parts of texts, as arrays instead of a dictionary of strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from turfline.llm import by_value
from turfline.llm.buffers import mixed, ranges, word_hashes

by_value(__name__)

#: Different parts that a worker remembers; beyond that it starts afresh.
REMEMBERED = 2_000_000


class PartIds:
    """Ids of byte strings, found by a 128-bit hash in sorted arrays; ``encode`` gives the ids of new ones.

    ``encode(parts, kinds)`` returns (all ids in order, ids of each part).  Code 0 always stands for the ``fixed`` ids.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], fixed: np.ndarray):
        self.encode, self.fixed = encode, fixed
        self._clear()

    def _clear(self) -> None:
        self.ids, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.count = self.used = 0
        self._keep(self.fixed, np.array([len(self.fixed)]))
        empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.shelves = [empty, empty]  # (hash in order, second hash, code): most, and what came since

    def _keep(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.bounds[self.count + 1:self.count + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.count += len(sizes)

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def codes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Codes of the parts ``buffer[start:end]``, none of them empty; equal strings of different kinds are different parts."""
        if self.count > REMEMBERED:
            self._clear()
        if not len(starts):
            return np.zeros(0, np.int64)
        salt = mixed(kinds.astype(np.uint64) + np.uint64(1))
        one, two = (h ^ salt for h in word_hashes(buffer, starts, ends, 2))
        named, head, of = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two[head][of], two):  # two parts of the chunk share the first hash: tell them apart by both
            order = np.lexsort((two, one))
            first = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
            head, of = order[first], np.empty(len(one), np.int64)
            of[order] = np.cumsum(first) - 1
            named = one[head]
        check = two[head]
        codes = np.full(len(named), -1, np.int64)
        for keys, second, code in self.shelves:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, named), len(keys) - 1)
                same = (keys[at] == named) & (second[at] == check)
                codes[same] = code[at[same]]
        new = np.flatnonzero(codes < 0)
        if len(new):
            raw, begin, stop = buffer.tobytes(), starts[head[new]].tolist(), ends[head[new]].tolist()
            codes[new] = np.arange(self.count, self.count + len(new))
            self._keep(*self.encode([raw[a:b] for a, b in zip(begin, stop)], kinds[head[new]]))
            self.shelves[1] = self._joined(self.shelves[1], (named[new], check[new], codes[new]))
            if 8 * len(self.shelves[1][0]) > len(self.shelves[0][0]):
                self.shelves = [self._joined(*self.shelves), tuple(x[:0] for x in self.shelves[1])]
        return codes[of]

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all codes in order, how many each has)."""
        first, sizes = self.bounds[codes], self.bounds[codes + 1] - self.bounds[codes]
        return self.ids[ranges(first, sizes)], sizes
