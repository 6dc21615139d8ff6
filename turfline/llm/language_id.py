"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three letters, with a mark for a word's edge) of
all training texts of a language, by falling count.  A document's own list is compared with every profile by the
out-of-place distance: for each of its n-grams the difference of the two ranks, at most the profile's length, which
also counts for an n-gram that the profile lacks.  The nearest profile names the language; equal distances go to the
name that sorts first.  Texts are counted whole, on both sides.

Letters are code points that Python calls alphabetic, in lower case; anything else ends a word.  Null or letterless texts are
``und`` with score 0, and so is every text if nothing could be learned.  score: 1 - distance / largest possible distance.
Extra columns are ignored by name; repeated rows are kept; a null id is never held out in ``held_out`` terms (its
checksum is null) and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from turfline.llm import by_value
from turfline.llm.buffers import chunk_rows

by_value(__name__)

#: N-grams of a profile and of a document's list.  A model has so many rows for each language.
PROFILE = 300
#: Code points worked on at once inside a task.
CHUNK_POINTS = 1 << 20
_letters: np.ndarray | None = None


def _alphabetic() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count, alphabet) of all n-grams, by document and gram.

    A gram is three places of base ``len(alphabet) + 2``: 0 is an empty place, 1 the edge of a word, then the letters in
    code point order; so grams compare alike whatever else the chunk holds.
    """
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    document = np.repeat(np.arange(len(lower)), sizes)
    solid = _alphabetic()[points]
    points, document, gap = points[solid], document[solid], np.flatnonzero(solid)
    none = np.zeros(0, np.int64)
    if not len(points):
        return none, none, none, none
    alphabet, letter = np.unique(points, return_inverse=True)
    base = len(alphabet) + 2
    breaks = np.append(True, (np.diff(gap) > 1) | (np.diff(document) > 0))
    place = np.arange(len(points)) + np.cumsum(breaks)
    line = np.ones(len(points) + int(breaks.sum()) + 1, np.int64)
    line[place] = letter + 2
    owner = np.zeros(len(line), np.int64)
    owner[place] = document
    owner[np.flatnonzero(line == 1)[:-1]] = document[breaks]  # a word's edge goes with the word that follows
    one = line[:-1] > 1
    first = np.where(line[:-1] == 1, owner[:-1], -1)
    span = base ** 3
    a, b = line[:-1], line[1:]
    of = np.where(first >= 0, first, owner[:-1])
    x, y, z = line[:-2], line[1:-1], line[2:]
    owners = np.concatenate([owner[:-1][one], of, of[:-1][y > 1]])
    keys = np.concatenate([(a * base * base)[one], (a * base + b) * base, ((x * base + y) * base + z)[y > 1]])
    if len(texts) * span < 1 << 63:
        named, count = np.unique(owners * span + keys, return_counts=True)
        return named // span, named % span, count, alphabet
    order = np.lexsort((keys, owners))  # so many letters that a document and a gram do not fit one number
    owners, keys = owners[order], keys[order]
    start = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1])))
    return owners[start], keys[start], np.diff(np.append(start, len(keys))), alphabet


def _spelled(gram: np.ndarray, alphabet: np.ndarray) -> list[str]:
    base = len(alphabet) + 2
    marks = ["", "_", *map(chr, alphabet.tolist())]
    return [marks[a] + marks[b] + marks[c] for a, b, c in zip((gram // base // base).tolist(), (gram // base % base).tolist(), (gram % base).tolist())]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for low, high in chunk_rows(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK_POINTS):
        yield low, high, texts[low:high]


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) learned from all of ``labelled`` (text, lang); null languages teach nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for low, high, texts in _chunks(batch, "text"):
                named, code = np.unique(np.array(langs[low:high], dtype=object).astype(str), return_inverse=True)
                document, gram, times, alphabet = grams(texts)
                span = (len(alphabet) + 2) ** 3
                keys, of = np.unique(code[document] * span + gram, return_inverse=True)
                total = np.bincount(of, weights=times, minlength=len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(named[i]) for i in (keys // span).tolist()], pa.string()),
                                                  pa.array(_spelled(keys % span, alphabet), pa.string()), pa.array(total)], ["lang", "gram", "n"])

    counts = (labelled.where("lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    ranked = counts.selectExpr("lang", "gram", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place")
    return ranked.where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))  # so the limit also applies before the shuffle


def identify(documents: DataFrame, model: list[tuple[str, str, int]], size: int = PROFILE, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the columns ``pred`` and ``score``, which it must not have yet; ``model``: rows (lang, gram, rank) of ``profiles``."""
    langs = sorted({lang for lang, _, _ in model})
    spelled = sorted({gram for _, gram, _ in model})
    row = {gram: i for i, gram in enumerate(spelled)}
    ranks = np.full((len(spelled) + 1, len(langs)), size, np.int32)
    missing = np.ones((len(spelled) + 1, len(langs)), bool)
    for lang, gram, rank in model:
        ranks[row[gram], langs.index(lang)] = rank
        missing[row[gram], langs.index(lang)] = False
    names = documents.columns

    def coded(alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's grams that this alphabet can spell, as numbers in order, with their rows."""
        place = {"_": 1, **{chr(c): i + 2 for i, c in enumerate(alphabet.tolist())}}
        base = len(alphabet) + 2
        found = []
        for i, gram in enumerate(spelled):
            if all(c in place for c in gram):
                a, b, c = [place[x] for x in gram] + [0] * (3 - len(gram))
                found.append(((a * base + b) * base + c, i))
        found.sort()
        return np.array([x for x, _ in found], np.int64), np.array([i for _, i in found], np.int64)

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        document, gram, count, alphabet = grams(texts)
        if not langs or not len(document):
            return ["und"] * len(texts), np.zeros(len(texts))
        order = np.argsort(document * (int(count.max()) + 1) - count, kind="stable")
        document, gram = document[order], gram[order]
        begin = np.searchsorted(document, np.arange(len(texts) + 1))
        rank = np.arange(len(document)) - begin[document]
        top = rank < size
        document, gram, rank = document[top], gram[top], rank[top]
        known, rows = coded(alphabet)
        at = np.full(len(gram), len(spelled), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            same = known[place] == gram
            at[same] = rows[place[same]]
        apart = np.abs(ranks[at] - rank[:, None])
        apart[missing[at]] = size
        used = np.bincount(document, minlength=len(texts))
        distance = np.stack([np.bincount(document, weights=apart[:, i], minlength=len(texts)) for i in range(len(langs))], axis=1)
        best = distance.argmin(axis=1)
        near = 1 - distance[np.arange(len(texts)), best] / np.maximum(used * size, 1)
        return [langs[b] if u else "und" for b, u in zip(best.tolist(), used.tolist())], np.where(used > 0, near, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = [], []
            for _, _, texts in _chunks(batch, "text"):
                found, near = judge(texts)
                said += found
                scores.append(near)
            extra = [pa.array(said, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *extra], [*names, pred, score])

    schema = StructType([*documents.schema.fields]).add(pred, StringType()).add(score, DoubleType())
    return documents.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for documents that the model must not have learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learn(documents: DataFrame, size: int = PROFILE) -> list[tuple[str, str, int]]:
    """The model, learned from all labelled documents that are not held out: ``size`` rows for each language."""
    rows = profiles(documents.where(~held_out()), size).collect()
    return [(r.lang, r.gram, r.rank) for r in rows]
