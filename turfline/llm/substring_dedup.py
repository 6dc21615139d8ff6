"""Exact repeated passages, found by fixed-block anchors.

A passage is a window of ``width`` consecutive words.  A word goes if a window over it also starts in a document with a
smaller id.  Any such window holds a whole block of ``width // 2`` words at a multiple of that length in the other
document, so:

1. *Pack.*  Texts are packed into chunks (``buffers.CHUNK_BYTES``) in the shared folder, with a digest of every text's words.
   Of documents with the same words only the smallest id goes on; the others are repeats as a whole.
2. *Anchor and probe.*  Every non-overlapping block is an anchor, every rolling window of a block's length a probe.  Each
   chunk sends one entry of four bytes for each different probe hash, whatever its count; a task that holds a slice of
   the hash space answers which hashes meet an anchor elsewhere.
3. *Extend.*  A hit is extended to all ``width``-word windows over it, compared by a 96-bit hash.  The union of the
   windows that a smaller document also has is the maximal exact repeat.  Documents are never paired: a hash of
   thousands of documents is one entry for each chunk, and the answer is its smallest document id.

Nulls: a null text has no words; a row with a null id neither removes nor loses anything.  Repeated rows are kept and
treated alike.  An empty table gives an empty result.  Extra columns are ignored by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.llm.buffers import BASES, Windows, byte_column, chunk_rows, free_name, ranges, word_bounds, word_hashes
from turfline.session import stage

by_value(__name__)

WIDTH = 50
#: Probe entries that one task takes of the hash space.
ENTRIES_PER_TASK = 4_000_000
_LEVEL = 5  # of the compression of packed texts
_TAIL = 30  # bits of a hash inside its slice; two more bits of an entry are flags
_CHUNK = ("ids", "known", "words", "digests", "offsets", "texts")
_CHUNK_SCHEMA = "chunk long, size long, " + ", ".join(f"{name} binary" for name in _CHUNK)


def pack(documents: DataFrame) -> DataFrame:
    """Chunks of texts: ids, word counts, word digests and byte offsets as arrays, the texts compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = byte_column(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()
            for low, high in chunk_rows(np.diff(at)):
                raw = data[at[low]:at[high]].tobytes()
                offsets = at[low:high + 1] - at[low]
                split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield _row(number, len(raw), ids[low:high], known[low:high], np.array([len(x) for x in split], np.int64),
                           b"".join(hashlib.sha256(b" ".join(x)).digest() for x in split), offsets, raw)
                number += 1
    return documents.select("doc_id", "text").mapInArrow(run, _CHUNK_SCHEMA)


def _row(chunk: int, size: int, ids, known, words, digests: bytes, offsets, raw: bytes, **more: bytes) -> pa.RecordBatch:
    blobs = [ids.tobytes(), known.astype(np.uint8).tobytes(), words.tobytes(), digests, offsets.tobytes(),
             pa.Codec("zstd", _LEVEL).compress(raw, asbytes=True), *more.values()]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([size], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)],
                                      ["chunk", "size", *_CHUNK, *more])


class _Texts:
    """The texts of one chunk row: words, bounds and hashes."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.offsets = get("offsets", np.int64)
        self.raw = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends, self.first = word_bounds(data, self.offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.counts = np.diff(self.first)

    def windows(self, width: int) -> np.ndarray:
        """Word numbers where a window of ``width`` words of one document starts."""
        n = np.maximum(self.counts - width + 1, 0)
        return ranges(self.first[:-1], n)

    def probes(self, block: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, slice and tail of the hash as one key, is an anchor) of the rolling windows of a block's length."""
        at = self.windows(block)
        hashes = Windows(self.hashes, BASES[0]).of(at, block)
        key = ((hashes >> np.uint64(34)) % np.uint64(slices)) << np.uint64(_TAIL) | hashes & np.uint64((1 << _TAIL) - 1)
        start = np.repeat(self.first[:-1], np.maximum(self.counts - block + 1, 0))
        return at, key, (at - start) % block == 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _slice_rows(chunk: int, part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each slice from arrays that are in slice order."""
    named, first = np.unique(part, return_index=True)
    bounds = [*first.tolist(), len(part)]
    blobs = {n: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for n, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(named.astype(np.int64)), pa.array(np.full(len(named), chunk, np.int64)), *blobs.values()],
                                      ["slice", "chunk", *blobs])


def _hits(chunks: DataFrame, block: int, slices: int) -> DataFrame:
    """(chunk, slice, tails): the probe hashes of a chunk that an anchor elsewhere, or another place of the chunk, shares."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, key, anchor = _Texts(row).probes(block, slices)
            if not len(key):
                continue
            entry = np.sort(key << np.uint64(1) | anchor.astype(np.uint64))
            key = entry >> np.uint64(1)
            last = np.append(key[1:] != key[:-1], True)
            first = np.append(True, last[:-1])
            # sorted, so an anchor stands last among its equals
            code = (key[last] & np.uint64((1 << _TAIL) - 1)) << np.uint64(2) | (entry[last] & np.uint64(1)) << np.uint64(1) | ~first[last]
            yield _slice_rows(row["chunk"], (key[last] >> np.uint64(_TAIL)).astype(np.int64), {"codes": code.astype(np.uint32)})

    def meet(table: pa.Table) -> pa.Table:
        blobs = table["codes"].to_pylist()
        codes = np.frombuffer(b"".join(blobs), np.uint32)
        owner = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
        tail = codes >> 2
        order = np.argsort(tail, kind="stable")
        ordered = tail[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        places = np.add.reduceat(1 + (codes[order] & 1).astype(np.int64), head)
        anchors = np.maximum.reduceat(codes[order] & 2, head)
        hit = np.zeros(len(codes), bool)
        hit[order] = np.repeat((places > 1) & (anchors > 0), np.diff(np.append(head, len(codes))))
        chosen, of = tail[hit], owner[hit]
        named, first = np.unique(of, return_index=True)
        bounds = [*first.tolist(), len(of)]
        return pa.table({"slice": pa.array([table["slice"][0].as_py()] * len(named), pa.int64()), "chunk": table["chunk"].take(pa.array(named)),
                         "tails": pa.array([chosen[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())})

    sent = chunks.select("chunk", "size", "offsets", "texts").mapInArrow(send, "slice long, chunk long, codes binary")
    return sent.groupBy("slice").applyInArrow(meet, "slice long, chunk long, tails binary")


def _candidates(chunks: DataFrame, hits: DataFrame, copies: DataFrame, block: int, width: int, slices: int) -> DataFrame:
    """The chunks again, cut down to documents with windows over a hit; ``marks`` has a bit for each word that starts one."""
    def keep(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        row = {name: left[name][0].as_py() for name in left.schema.names} if left.num_rows else None
        if row is None or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        texts = _Texts(row)
        live = np.frombuffer(row["known"], np.uint8).astype(bool)
        wanted = []
        for part, blob in zip(right["slice"].to_pylist(), right["tails"].to_pylist()):
            if part < 0:
                live[np.frombuffer(blob, np.uint8).view(">u4").astype(np.int64)] = False
            else:
                wanted.append(np.frombuffer(blob, np.uint32).astype(np.uint64) | np.uint64(part << _TAIL))
        at, key, _ = texts.probes(block, slices)
        found = np.zeros(len(texts.starts) + 1, np.int64)
        if wanted:
            want = np.sort(np.concatenate(wanted))
            found[at] = want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key
        before = np.concatenate([[0], np.cumsum(found)])
        windows = texts.windows(width)
        inside = before[windows + width - block + 1] - before[windows] > 0
        document = np.searchsorted(texts.first, windows, side="right") - 1
        windows = windows[inside & live[document]]
        document = np.searchsorted(texts.first, windows, side="right") - 1
        stays = np.unique(document)
        if not len(stays):
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        marks = np.zeros(len(texts.starts), bool)
        marks[windows] = True
        marks = np.concatenate([marks[texts.first[i]:texts.first[i + 1]] for i in stays])
        pieces = [texts.raw[texts.offsets[i]:texts.offsets[i + 1]] for i in stays]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        digests = row["digests"]
        batch = _row(row["chunk"], int(offsets[-1]), np.frombuffer(row["ids"], np.int64)[stays], live[stays],
                     np.frombuffer(row["words"], np.int64)[stays], b"".join(digests[32 * i:32 * i + 32] for i in stays), offsets,
                     b"".join(pieces), marks=np.packbits(marks).tobytes())
        return pa.Table.from_batches([batch])

    names = ["chunk", "size", *_CHUNK, "marks"]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    answers = hits.unionByName(copies)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, _CHUNK_SCHEMA + ", marks binary")


class _Marked(_Texts):
    """Candidate windows of a chunk with their hashes: one entry for each different window, in slice order."""

    def __init__(self, row: dict, width: int, slices: int):
        super().__init__(row)
        marks = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(self.starts)).astype(bool)
        self.at = np.flatnonzero(marks)
        h1, h2 = (Windows(self.hashes, base).of(self.at, width) for base in BASES)
        h2 = (h2 >> np.uint64(32)).astype(np.uint32)
        part = (h1 >> np.uint64(32)) % np.uint64(slices)
        self.document = np.searchsorted(self.first, self.at, side="right") - 1
        self.ids = np.frombuffer(row["ids"], np.int64)
        ids = self.ids[self.document]
        order = np.lexsort((ids, h2, h1, part))
        h1, h2, part, ids = h1[order], h2[order], part[order], ids[order]
        head = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (part[1:] != part[:-1])) if len(order) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(head) - 1
        self.part, self.h1, self.h2, self.least = part[head].astype(np.int64), h1[head], h2[head], ids[head]

    def narrow_ids(self) -> np.ndarray:
        """The smallest ids, in four bytes each if this chunk's fit."""
        fits = not len(self.least) or (self.least.min() >= 0 and self.least.max() < 1 << 32)
        return self.least.astype(np.uint32) if fits else self.least


def _earlier(candidates: DataFrame, width: int, slices: int) -> DataFrame:
    """(chunk, slice, entries): which of a chunk's windows, numbered inside the slice, start in a smaller document elsewhere."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m = _Marked(row, width, slices)
            yield _slice_rows(row["chunk"], m.part, {"h1": m.h1, "h2": m.h2, "least": m.narrow_ids()})

    def meet(table: pa.Table) -> pa.Table:
        h1, h2 = (np.frombuffer(b"".join(table[n].to_pylist()), k) for n, k in (("h1", np.uint64), ("h2", np.uint32)))
        sizes = [len(b) // 8 for b in table["h1"].to_pylist()]
        least = np.concatenate([np.frombuffer(b, np.uint32 if len(b) == 4 * n else np.int64).astype(np.int64) for b, n in zip(table["least"].to_pylist(), sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inner = ranges(np.zeros(len(sizes), np.int64), np.array(sizes))
        order = np.lexsort((least, h2, h1))
        a, b, ids = h1[order], h2[order], least[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        late = np.zeros(len(order), bool)
        late[order] = ids > np.repeat(ids[head], np.diff(np.append(head, len(order))))
        of, chosen = owner[late], inner[late].astype(np.uint32)
        named, first = np.unique(of, return_index=True)
        bounds = [*first.tolist(), len(of)]
        return pa.table({"slice": pa.array([table["slice"][0].as_py()] * len(named), pa.int64()), "chunk": table["chunk"].take(pa.array(named)),
                         "entries": pa.array([chosen[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())})

    sent = candidates.mapInArrow(send, "slice long, chunk long, h1 binary, h2 binary, least binary")
    return sent.groupBy("slice").applyInArrow(meet, "slice long, chunk long, entries binary")


def _cut(candidates: DataFrame, earlier: DataFrame, width: int, slices: int) -> DataFrame:
    """(doc_id, digest, n_removed, spans as word numbers from, to, ...; kept_sha256) of the candidate documents that lose words."""
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("doc_id", "digest", "n_removed", "spans", "kept_sha256")}
        if left.num_rows:
            row = {name: left[name][0].as_py() for name in left.schema.names}
            m = _Marked(row, width, slices)
            bad = m.least[m.entry] < m.ids[m.document]  # a smaller document of this chunk has the window
            base = {int(p): int(i) for p, i in zip(*np.unique(m.part, return_index=True))}
            late = np.zeros(len(m.part), bool)
            for part, blob in zip(right["slice"].to_pylist(), right["entries"].to_pylist()):
                late[base[part] + np.frombuffer(blob, np.uint32).astype(np.int64)] = True
            bad |= late[m.entry]
            change = np.zeros(len(m.starts) + 1, np.int64)
            np.add.at(change, m.at[bad], 1)
            np.add.at(change, m.at[bad] + width, -1)
            gone = np.cumsum(change)[:-1] > 0
            for i in np.unique(m.document[bad]).tolist():
                own = gone[m.first[i]:m.first[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                words = m.raw[m.offsets[i]:m.offsets[i + 1]].split()
                kept = b" ".join(w for w, x in zip(words, own.tolist()) if not x)
                for name, value in zip(out, (int(m.ids[i]), row["digests"][32 * i:32 * i + 32].hex(), int(own.sum()), edges.tolist(), hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)})

    return candidates.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(
        cut, "doc_id long, digest string, n_removed long, spans array<long>, kept_sha256 string")


def _documents(chunks: DataFrame) -> DataFrame:
    """(chunk, seq, doc_id, n_words, digest hex) of every document of the chunks, without reading the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, known, words = (np.frombuffer(row[n], k) for n, k in (("ids", np.int64), ("known", np.uint8), ("words", np.int64)))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n)), pa.array(ids, mask=known == 0), pa.array(words),
                pa.array([row["digests"][32 * i:32 * i + 32].hex() for i in range(n)], pa.string())], ["chunk", "seq", "doc_id", "n_words", "digest"])
    return chunks.select("chunk", "ids", "known", "words", "digests").mapInArrow(run, "chunk long, seq long, doc_id long, n_words long, digest string")


def repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256, digest) of every document.

    spans: removed word numbers from, to (exclusive), ...; digest: SHA-256 of the words joined by one space, as hex.
    """
    if width < 2:
        raise ValueError("a window needs two words at least")
    block = width // 2
    chunks = stage(pack(documents), "text-chunks")
    listed = stage(_documents(chunks), "texts")
    leaders = listed.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("leader"))
    listed = stage(listed.join(leaders, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("leader"), F.lit(False))), "copies")
    words = listed.agg(F.sum("n_words")).first()[0] or 0
    slices = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // ENTRIES_PER_TASK))
    seats = F.array_join(F.transform(F.collect_list("seq"), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    copies = listed.where("copy").groupBy("chunk").agg(F.unhex(seats).alias("tails")).select(F.lit(-1).cast("long").alias("slice"), "chunk", "tails")
    candidates = stage(_candidates(chunks, _hits(chunks, block, slices), copies, block, width, slices), "candidates")
    cut = _cut(candidates, _earlier(candidates, width, slices), width, slices)
    cut = cut.groupBy("doc_id", "digest").agg(*(F.first(c).alias(c) for c in ("n_removed", "spans", "kept_sha256")))
    whole = F.col("copy") & (F.col("n_words") >= width)
    return listed.join(cut, ["doc_id", "digest"], "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"), "digest")


def strip(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the spans of ``repeats`` cut out of their texts (kept words joined by one space).

    Texts that lose nothing stay as they are.  Where different texts share a doc_id, each has its own spans, found by its digest.
    """
    names = documents.columns
    cut, digest = free_name(names, "spans"), free_name(names, "digest")
    spans = found.where("n_removed > 0").groupBy("doc_id", F.col("digest").alias(digest)).agg(F.first("spans").alias(cut))
    several = found.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shared = documents.join(several, "doc_id", "left_semi").withColumn(digest, F.sha2(F.array_join(words, " "), 256))
    known = documents.join(several, "doc_id", "left_anti").join(spans.drop(digest), "doc_id", "left").unionByName(
        shared.join(spans, ["doc_id", digest], "left").drop(digest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(cut).to_pylist()):
                if spans:
                    words, kept, at = (texts[i] or "").encode().split(), [], 0
                    for a, b in zip(spans[::2], spans[1::2]):
                        kept += words[at:a]
                        at = b
                    texts[i] = b" ".join(kept + words[at:]).decode()
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return known.select(*names, cut).mapInArrow(run, documents.schema)
