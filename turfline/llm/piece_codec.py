"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The pieces and their scores come from a public model file; the segmentation is the one with the largest sum of scores.  The automaton
reads a text once; at every position its output links name all pieces that end there, and each relaxes the best score of
that position.  A character that no piece covers costs the least score less ``UNKNOWN`` and becomes its UTF-8 byte pieces.

White space: a space is the mark U+2581, and a text starts with one.  Where no piece of the model holds a mark after another character, a text falls
apart before each run of spaces, and around characters that are in no piece; a worker remembers the ids of the parts
that it saw (``part_ids``).  With any other model texts are read whole.  Decoding is exact but for texts that hold the mark itself, which comes back as a space.

Nulls: a null text has no pieces (an empty list) and decodes to the empty text.  Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from turfline.llm import by_value
from turfline.llm.buffers import byte_column, chunk_rows, ranges
from turfline.llm.part_ids import PartIds

by_value(__name__)

MARK = "▁"
UNKNOWN = 10.0


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown_id = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        least = 0.0
        for i, piece in enumerate(self.pieces):
            if i in self.byte_of or i in self.silent or model.is_unknown(i) or model.is_unused(i):
                continue
            score = model.get_score(i)
            least = min(least, score)
            self.automaton.add_word(piece, (len(piece), score, i))
            if len(piece) == 1:
                self.singles.add(piece)
        self.automaton.make_automaton()
        self.least = least - UNKNOWN
        used = {ord(c) for piece in self.pieces for c in piece if len(piece) != 6 or not piece.startswith("<0x")}
        self.lonely = np.array([i < 128 and i not in used and i != 32 for i in range(256)])
        spelled = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.cumsum([len(x) for x in spelled])
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in self.pieces)
        self.memory = PartIds(self._encode_parts, np.zeros(0, np.int64))

    def _viterbi(self, part: str) -> list[int]:
        n = len(part)
        best = [0.0] + [-float("inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        singles, least = self.singles, self.least
        at = 0

        def alone(upto: int, at: int) -> int:
            while at < upto:
                if part[at] not in singles and best[at] + least > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + least, (at, -1)
                at += 1
            return at

        for last, (size, score, piece) in self.automaton.iter(part):
            at = alone(last + 1, at)
            start = last + 1 - size
            if best[start] + score > best[last + 1]:
                best[last + 1], back[last + 1] = best[start] + score, (start, piece)
        alone(n, at)
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[start:n].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown_id)
            n = start
        return out[::-1]

    def _encode_parts(self, parts: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self._viterbi(x.decode().replace(" ", MARK)) for x in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, ids of each text) of UTF-8 texts in one array."""
        mark = MARK.encode()
        if mark in (raw := data.tobytes()):
            texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not self.splits:
            raw = data.tobytes()
            return self._encode_parts([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.zeros(0, np.int64))
        space, lonely = data == 32, self.lonely[data]
        first = space | lonely
        first[1:] &= ~(space[:-1] & space[1:])
        first[1:] |= lonely[:-1]
        first[offsets[:-1][filled]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        ids, sizes = self.memory.ids_of(self.memory.codes(data, starts, ends if len(starts) else starts, np.zeros(len(starts), np.int64)))
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def decode_chunk(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of several id lists, as UTF-8."""
        ends = self.spelled_ends[ids]
        sizes = ends - np.where(ids > 0, self.spelled_ends[ids - 1], 0)
        raw = self.spelled[ranges(ends - sizes, sizes)].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + (raw[a:a + 1] == b" "):b] for a, b in zip(stops, stops[1:])]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_chunk(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_chunk(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker and model file."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``documents`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            data, at = byte_column(batch.column(1))
            for low, high in chunk_rows(np.diff(at)):
                ids, counts = own.encode_chunk(data[at[low]:at[high]], at[low:high + 1] - at[low])
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).cast(pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def _lists(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, all piece ids, ids of each row) of an encoded batch, some rows at a time; a null list is empty."""
    for low in range(0, batch.num_rows, rows):
        column = batch.column(1).slice(low, rows)
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        yield batch.column(0).slice(low, rows).cast(pa.int64()), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for names, ids, counts in _lists(batch):
                texts = [x.decode("utf-8", "replace") for x in own.decode_chunk(ids, counts)]
                yield pa.RecordBatch.from_arrays([names, pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def summary(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256) of every row of ``encoded``: the ids' checksum as 32-bit numbers, the digest of the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for names, ids, counts in _lists(batch):
                raw = memoryview(ids.astype("<u4").tobytes())
                stops = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(counts), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(stops, stops[1:])], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in own.decode_chunk(ids, counts)], pa.string())],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
