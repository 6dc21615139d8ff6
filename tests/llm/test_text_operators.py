"""Text operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpora  # noqa: E402

from turfline.llm import language_id, packing, piece_codec, simhash_dedup, substring_dedup  # noqa: E402
from turfline.llm.queries import word_tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return corpora.documents(spark).cache()


def words_of(text):
    return (text or "").encode().split()


# --- SimHash -------------------------------------------------------------------------
def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    own = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    root = dict(zip(own, own))
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if (own[a] ^ own[b]).bit_count() <= radius and root[b] < root[a]:
                    root[a], changed = root[b], True
    return own, root


def test_simhash_equals_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own, root = slow_groups([(i, t) for i, t in rows if t is None or len(t) < 50_000])
    got = simhash_dedup.near_duplicates(docs.where("text IS NULL OR length(text) < 50000")).collect()
    assert len(got) == sum(t is None or len(t) < 50_000 for _, t in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else root[r.doc_id])
        assert r.doc_id is None or r.fingerprint == f"{own[r.doc_id]:016x}"


def test_spark_hash_is_the_shingle_hash(spark):
    text = "Über die straße und"
    assert spark.range(1).selectExpr(f"xxhash64('{text}')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("bytes_", [1 << 30, 0])
def test_bk_forests_find_every_near_fingerprint(spark, monkeypatch, bytes_):
    """Many near fingerprints, trees split into parts, shipped both ways."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    bits = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(12)]))
    monkeypatch.setattr(simhash_dedup, "TREE_ENTRIES", 40)
    monkeypatch.setattr(simhash_dedup, "VISITS", 300)
    monkeypatch.setattr(simhash_dedup, "BROADCAST_BYTES", bytes_)
    found = simhash_dedup.near_links(spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "bits long")).collect()
    at = {int(x): i for i, x in enumerate(bits.view(np.int64))}
    from turfline.llm.components import local_roots

    a, b = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4)
    want = local_roots(len(bits), a, b)
    got = local_roots(len(bits), np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
    assert np.array_equal(want, got)


def test_probe_follows_only_edges_within_the_radius():
    bits = np.array([0, 1, 0xFF, 0xFFFF, 0xFF00FF], np.uint64)
    names, roots, keys, children = simhash_dedup.build_forest(np.zeros(5, np.int64), bits)
    assert list(names) == [0] and list(roots) == [0]
    assert sorted(zip((keys // 65).tolist(), (keys % 65).tolist(), children.tolist())) == [(0, 1, 1), (0, 8, 2), (0, 16, 3), (3, 16, 4)]
    hits = [n for _, node in simhash_dedup.probe((names, roots, keys, children), np.zeros(1, np.int64), np.array([3], np.uint64), bits, 2) for n in node.tolist()]
    assert sorted(hits) == [0, 1]


# --- substrings ----------------------------------------------------------------------
def slow_repeats(rows, width):
    first: dict = {}
    for i, text in rows:
        w = words_of(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [50, 7, 2])
def test_substrings_equal_brute_force(docs, width):
    few = docs.where("text IS NULL OR length(text) < 50000") if width < 50 else docs
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substring_dedup.repeats(few, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert Counter(got) == Counter(slow_repeats(rows, width))
    assert any(r[2] and r[2] < r[1] for r in got)


def test_strip_cuts_the_spans_and_keeps_other_columns(docs):
    found = substring_dedup.repeats(docs)
    kept = {r.doc_id: r.kept_sha256 for r in found.collect()}
    out = substring_dedup.strip(docs, found)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.doc_id is None or hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == kept[r.doc_id]


# --- languages -----------------------------------------------------------------------
def slow_profile(texts, size):
    counts: Counter = Counter()
    for text in texts:
        word = ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
                continue
            if word:
                padded = f"\0{word}\0"
                counts.update(word)
                counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
                counts.update(padded[i:i + 3] for i in range(len(padded) - 2))
            word = ""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_profiles_and_distances_equal_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    model = language_id.learn(docs, 60)
    texts: dict = {}
    for r in rows:
        if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            texts.setdefault(r.lang, []).append(r.text)
    got: dict = {}
    for lang, gram, rank in sorted(model, key=lambda m: (m[0], m[2])):
        got.setdefault(lang, []).append(gram)
    counts = {lang: slow_profile(t, 10_000) for lang, t in texts.items()}
    for lang, own in got.items():
        assert {g.replace("_", "\0") for g in own[:20]} <= set(counts[lang][:30])  # ties at the end may differ in order
    profile = {lang: {g.replace("_", "\0"): i for i, g in enumerate(own)} for lang, own in got.items()}
    for r in language_id.identify(docs.select("doc_id", "text"), model, 60).collect():
        own = slow_profile([r.text], 60)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(i - p[g]) if g in p else 60 for i, g in enumerate(own)) for lang, p in profile.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (60 * len(own)))) < 1e-9


def test_languages_of_held_out_texts(spark):
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01") + "/documents.parquet"
    docs = spark.read.parquet(path)
    said = language_id.identify(docs, language_id.learn(docs)).where(language_id.held_out())
    assert said.selectExpr("avg(int(lang_pred = lang))").first()[0] > 0.98


def test_language_of_nothing_learned(docs):
    said = language_id.identify(docs.select("doc_id", "text"), []).collect()
    assert {r.lang_pred for r in said} == {"und"} and {r.score for r in said} == {0.0}


# --- packing -------------------------------------------------------------------------
def slow_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def check_packing(rows, got, window):
    """Every id in exactly one piece, sequences gapless; returns the share of padding."""
    want: dict = {}
    for (i, text), ids in zip(rows, slow_ids([t for _, t in rows])):
        want.setdefault(i, []).append(ids)
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        seen = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        expect: Counter = Counter()
        for ids in want[i]:
            start = 0
            for n in packing.cuts(len(ids), window):
                expect[start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids)] += 1
                start += n
            assert start == len(ids)
        assert seen == expect
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, padding + total)


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_keeps_every_id_once(docs, window):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    share = check_packing(rows, packing.pack(docs, word_tokenizer(), window=window).collect(), window)
    assert share < 0.03


def test_plan_uses_up_the_histogram_with_little_padding():
    rng = np.random.default_rng(5)
    lengths = [n for x in rng.lognormal(6.3, 1.1, 40_000).astype(int) for n in packing.cuts(int(x) + 1)]
    histogram = dict(Counter(lengths))
    plan = packing.plan(histogram)
    used: Counter = Counter()
    for times, pattern in plan:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            used[n] += times * k
    assert used == histogram
    sequences = sum(t for t, _ in plan)
    assert sequences * 2048 <= sum(lengths) * 1.002 + 2048


def test_least_squares_are_non_negative_and_least():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, (12, 30)).astype(float)
    b = a @ np.where(rng.random(30) < 0.3, rng.random(30) * 9, 0)
    x = packing.non_negative(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b, atol=1e-6)
    assert packing.combinations(4, 3) == [(3, 1), (2, 2), (2, 1, 1)]


# --- pieces --------------------------------------------------------------------------
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def slow_pieces(codec, scores, text):
    text = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [-1e300] * len(text), [(0, [])] * (len(text) + 1)
    for stop in range(1, len(text) + 1):
        for start in range(max(0, stop - 16), stop):
            if (found := scores.get(text[start:stop])) and best[start] + found[1] > best[stop]:
                best[stop], back[stop] = best[start] + found[1], (start, [found[0]])
        if text[stop - 1] not in codec.singles and best[stop - 1] + codec.least > best[stop]:
            best[stop], back[stop] = best[stop - 1] + codec.least, (stop - 1, [codec.bytes[b] for b in text[stop - 1].encode()])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_pieces_equal_the_best_segmentation_and_come_back(docs):
    import sentencepiece

    codec, model = piece_codec.codec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    scores = {p: (i, model.get_score(i)) for i, p in enumerate(codec.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    encoded = piece_codec.encode(docs, model_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encoded.collect():
        if r.doc_id is not None and len(texts[r.doc_id] or "") < 50_000:
            assert r.ids == slow_pieces(codec, scores, texts[r.doc_id] or "")
    for r in piece_codec.decode(encoded, model_path()).collect():
        assert r.doc_id is None or r.text == (texts[r.doc_id] or "").replace("▁", " ")
    for r in piece_codec.summary(encoded, model_path()).collect():
        assert r.doc_id is None or r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").replace("▁", " ").encode()).hexdigest()


# --- all of them ---------------------------------------------------------------------
def test_empty_tables(spark):
    empty = spark.createDataFrame([], corpora.SCHEMA)
    for run in (simhash_dedup.near_duplicates, substring_dedup.repeats, lambda d: language_id.identify(d.select("doc_id", "text"), language_id.learn(d)),
                lambda d: packing.pack(d, word_tokenizer()), lambda d: piece_codec.summary(piece_codec.encode(d, model_path()), model_path())):
        assert run(empty).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "packing"]
    kept = docs
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    kept = P.by_language(spark, kept, "").cache()
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()} - {None}
    assert {i for i, t in rows.items() if t is not None and any(w in t for w in (" the ", " der ", " la "))} <= left
    assert not any((rows[i] or "").strip(" \t\n0123456789!") == "" for i in left)
    kept = P.without_near_copies(spark, kept, "").cache()
    own, root = slow_groups([(i, rows[i]) for i in left])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in left if root[i] == i)
    before = [(r.doc_id, r.text) for r in kept.collect()]
    cut = P.without_repeats(spark, kept, "").cache()
    want = {i: h for i, _, _, h in slow_repeats(before, 50)}
    for r in cut.collect():
        assert r.doc_id is None or hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == want[r.doc_id]
    assert cut.columns == docs.columns
    assert check_packing([(r.doc_id, r.text) for r in cut.collect()], P.packed(spark, cut, "").collect(), 2048) < 0.05


# --- found in review -----------------------------------------------------------------
def test_profiles_are_cut_before_the_shuffle(spark):
    plan = language_id.profiles(corpora.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_grams_of_very_many_letters():
    letters = [chr(c) for c in range(0x3400, 0x9FFF) if chr(c).isalpha()] + [chr(c) for c in range(0xAC00, 0xD7A3)] + [chr(c) for c in range(0x20000, 0x2A6DF) if chr(c).isalpha()]
    texts = ["".join(letters)] + ["ab cd"] * 12_000
    document, gram, count, alphabet = language_id.grams(texts)
    assert len(alphabet) > 80_000 and document.min() == 0 and document.max() == 12_000
    own = language_id.grams(["ab cd"])
    last = document == 12_000
    assert language_id._spelled(gram[last], alphabet) == language_id._spelled(own[1], own[3]) and count[last].tolist() == own[2].tolist()


def test_strip_of_different_texts_under_one_id(spark):
    words = [f"w{i}" for i in range(200)]
    rows_ = [(1, " ".join(words)), (5, "own " + " ".join(words[20:120]) + " end"), (5, "quite another text under the same number"), (5, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in substring_dedup.strip(docs, substring_dedup.repeats(docs)).collect()), key=str)
    assert left == sorted([rows_[0], (5, "own end"), rows_[2], rows_[3]], key=str)


def test_other_tokenizers_and_models_read_texts_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, World!! ÉCOLE don't 12,5%", "", "  two  spaces ", "ABC abc Abc", "漢字 x"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own, plain = packing.WordIds(path, 1), Tokenizer.from_file(path)
        assert own.by_words == by_words
        ids, sizes = own.of(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    assert codec.splits
    split = [x.tolist() for x in codec.encode_chunk(data, offsets)]
    codec.splits = False
    assert [x.tolist() for x in codec.encode_chunk(data, offsets)] == split


def test_parts_whose_first_hash_is_the_same(monkeypatch):
    from turfline.llm import part_ids

    real = part_ids.word_hashes
    monkeypatch.setattr(part_ids, "word_hashes", lambda *a: (np.full(len(a[1]), 7, np.uint64), real(*a)[1]))
    memory = part_ids.PartIds(lambda parts, kinds: (np.array([len(x) for x in parts]), np.ones(len(parts), np.int64)), np.zeros(0, np.int64))
    for words in (b"a bb ccc a bb", b"dddd a ccc eeeee"):
        data = np.frombuffer(words, np.uint8)
        sizes = [len(w) for w in words.split()]
        starts = np.cumsum([0] + [n + 1 for n in sizes])[:-1]
        ids, _ = memory.ids_of(memory.codes(data, starts, starts + sizes, np.zeros(len(sizes), np.int64)))
        assert ids.tolist() == sizes


def test_pipeline_stages_keep_different_texts_of_one_id(spark):
    import corpus_pipeline

    own = " ".join(f"w{i}" for i in range(90))
    rows_ = [(1, own, "en", "s", 1), (5, own, "en", "s", 1), (5, "quite another text under the same number, without a copy", "en", "s", 1), (5, None, "en", "s", 1), (6, "  ", "en", "s", 1),
             (7, own, None, None, None), (8, own, "en", "s", 1), (8, own, "en", "s", 2), (None, own, "en", "s", 1), (9, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, own), (5, rows_[2][1]), (5, None), (None, own)], key=str)
    blank = spark.createDataFrame([(1, own, None), (2, own, None), (3, "", None), (4, None, None), (5, " \t", None)], "doc_id long, text string, had_words string")
    left = corpus_pipeline.without_repeats(spark, blank, "")
    assert left.columns == blank.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, own), (3, ""), (4, None), (5, " \t")], key=str)
