"""Periodic runs, reply trees and centroid clustering against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from corpora import documents, rows

from turfline.llm import centroid_clustering, periodic_runs, reply_trees
from turfline.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


# --- periodic runs -------------------------------------------------------------------
def brute_runs(w, least=6, power=4):
    """(start, end, period) of all runs: equal words q apart, stretch by stretch; of one stretch the smallest q."""
    seen = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, power * q) and j > i:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in seen.items())


def random_texts(rng):
    made = []
    for _ in range(rng.randrange(1, 12)):
        k, d = rng.choice([1, 2, 3, 8]), []
        while len(d) < rng.randrange(1, 150):
            if rng.random() < 0.4:
                block = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
                d += (block * rng.randrange(1, 9))[:rng.randrange(1, 80)]
            else:
                d.append(rng.randrange(k))
        made += [d, *([list(rng.choice(made))] if made and rng.random() < 0.4 else [])]
    return made


@pytest.mark.parametrize("candidates,gain", [(1 << 21, 1 / 64), (7, 0.0), (1 << 21, 2.0)])  # 2.0: no replacement at all
def test_runs_equal_brute_force(monkeypatch, candidates, gain):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", candidates)
    monkeypatch.setattr(periodic_runs, "GAIN", gain)
    rng = random.Random(3)
    for _ in range(60):
        texts = random_texts(rng)
        words = np.array(sum(texts, []), np.int64)
        got = periodic_runs.Runs(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts])).maximal().tolist()
        first = np.cumsum([0] + [len(t) for t in texts])
        assert got == [[i, s + first[i], e + first[i], q] for i, t in enumerate(texts) for s, e, q in brute_runs(t)]


def test_runs_survive_words_on_which_hashes_collide():
    word = [0]
    for _ in range(12):
        word += [1 - x for x in word]  # polynomials modulo 2**64 cannot tell such words apart
    words = np.array(word * 5 + word[:100])
    assert periodic_runs.Runs(words, np.zeros(len(words), np.int64)).maximal().tolist() == [[0, 0, len(words), len(word)]]


def test_a_repeated_text_is_analysed_once(monkeypatch):
    tried = []
    own = periodic_runs.Runs._crossing
    monkeypatch.setattr(periodic_runs.Runs, "_crossing", lambda self, s, m, e: (tried.append(int((e - s).sum())), own(self, s, m, e))[1])
    text = np.random.default_rng(1).integers(0, 50, 600)
    for copies in (2, 64):
        tried.clear()
        periodic_runs.Runs(np.tile(text, copies), np.repeat(np.arange(copies), 600))
        least = sum(tried) if copies == 2 else least
    assert sum(tried) < 1.2 * least


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    w = plant(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def run_rows():
    made = [r for r in rows() if r[1] is None or len(r[1]) < 20_000]
    return made + [(10_000 + i, f" again\t{i} " + "a b  c\n" * i, None, None, None, None, None, None) for i in range(60)]


def test_query_equals_definition(spark, tmp_path):
    table = run_rows()
    spark.createDataFrame(table, "doc_id long, text string, runs string, collapsed string, score double, words string, longest string, g long").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=repr) == sorted((expected_runs(r[0], r[1]) for r in table), key=repr)
    assert sum(r[1] > 0 for r in got) > 40


def test_runs_of_a_very_long_text_and_of_none(spark):
    text = "x " * 400_000 + "y " * 5 + "a b c " * 50_000
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 400_000, 1), (400_005, 150_000, 3)] and got.collapsed == "x " + "y " * 5 + "a b c"
    assert periodic_runs.periodic_runs(documents(spark).limit(0)).count() == 0


# --- reply trees ---------------------------------------------------------------------
TREE = "tree_id string, message_id long, parent_id long, role string, text string, score double, loss string, turn long, up string"


def random_messages(rng):
    made = []
    for t in range(40):
        n = rng.choice([1, 2, 5, 30, 90])
        ids = rng.sample(range(1000), n)
        for i, m in enumerate(ids):
            parent = None if i == 0 else ids[rng.randrange(i)] if t % 3 else ids[i - 1]
            text = rng.choice(["", None, "ok", "<|im_end|>", r"<\\|im_start|> <\| <|", "é<|im_sep|>\n\U0001F600", "a<|b" * 3])
            made.append((f"t{t}", m, parent, rng.choice(["user", "assistant", "assistant", None, "r<|im_sep|>\n"]), text,
                         rng.choice([0.5, 1.0, 2.0, None, NAN]), "l", 7, "u"))
    made += [("lost", 1, 77, "user", "orphan", 1.0, "l", 7, "u"), ("lost", 2, 1, "assistant", "answer", 1.0, "l", 7, "u")]
    made += [("ring", 1, 2, "user", "a", 1.0, "l", 7, "u"), ("ring", 2, 1, "user", "b", 1.0, "l", 7, "u"), ("ring", 3, 2, "user", "c", 1.0, "l", 7, "u")]
    made += [("ring", 9, None, "assistant", "free", 1.0, "l", 7, "u"), ("self", 1, 1, "user", "a", 1.0, "l", 7, "u")]
    made += [(None, 1, None, "user", "none", 1.0, "l", 7, "u"), ("t0", None, None, "user", "none", 1.0, "l", 7, "u")]
    return made + made[:5]


def brute_paths(messages):
    """All root-to-leaf paths: (tree, leaf, mean score, [(role, text)])."""
    by, out = {}, []
    for t, m, p, role, text, score, *_ in messages:
        if t is not None and m is not None:
            by.setdefault(t, {})[m] = (p, role or "", text or "", 0.0 if score is None or math.isnan(score) else score)
    for t, own in by.items():
        parents = {p for p, *_ in own.values()}
        for leaf in own:
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(own[at])
                at = own[at][0]
            if leaf not in parents and at not in seen:
                out.append((t, leaf, sum(x[3] for x in path) / len(path), [(r, x) for _, r, x, _ in path[::-1]]))
    return out


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_equal_brute_force(spark, branches):
    messages = random_messages(random.Random(8))
    want = {}
    for t, leaf, score, turns in brute_paths(messages):
        want.setdefault(t, []).append((-score, leaf, turns))
    want = {(t, leaf): (i + 1, -s, turns) for t, all_ in want.items() for i, (s, leaf, turns) in enumerate(sorted(all_)[:branches])}
    got = reply_trees.read_back(reply_trees.format_trees(spark.createDataFrame(messages, TREE).repartition(4), branches)).collect()
    assert {(r.tree_id, r.leaf_id) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        branch, score, turns = want[r.tree_id, r.leaf_id]
        assert (r.branch, r.n_turns, [tuple(t) for t in r.turns]) == (branch, len(turns), turns) and math.isclose(r.score, score)
        assert r.trained == "".join(text for role, text in turns if role == "assistant")
        for mask, text in zip(r.loss, [text for role, text in turns if role == "assistant"]):
            piece = r.formatted[mask.start:mask.start + mask.length]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", piece) == text and "<|" not in piece
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == r.formatted.count("<|im_sep|>") == len(turns)


def test_a_long_chain_takes_few_rounds(spark):
    n = 700
    chain = [("t", i, i - 1 if i else None, "user" if i % 2 else "assistant", str(i), 1.0, "l", 7, "u") for i in range(n)]
    done, levels = reply_trees.rooted(spark.createDataFrame(chain, TREE))
    assert len(levels) == 10 and done.count() == n and done.agg({"size": "max"}).first()[0] == n
    one = reply_trees.read_back(reply_trees.format_trees(spark.createDataFrame(chain, TREE))).first()
    assert [t.text for t in one.turns] == [str(i) for i in range(n)]


def test_no_trees_and_conversations_without_id(spark):
    none = spark.createDataFrame([], TREE)
    assert reply_trees.read_back(reply_trees.format_trees(none)).count() == 0
    told = [(5, 1, "user", "b"), (5, 0, None, None), (5, 1, "user", "b"), (5, None, "system", "s"), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    chained = reply_trees.chains(spark.createDataFrame(told, "conv_id long, turn long, role string, text string"))
    got = {r.tree_id: [tuple(t) for t in r.turns] for r in reply_trees.read_back(reply_trees.format_trees(chained)).collect()}
    assert got == {"5": [("system", "s"), ("", ""), ("user", "b"), ("user", "b")], "": [("user", "y"), ("assistant", "x")]}


def test_formatting_runs_no_python(spark):
    plan = reply_trees.read_back(reply_trees.format_trees(spark.createDataFrame(random_messages(random.Random(1)), TREE)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- centroid clustering -------------------------------------------------------------
def plain(vectors, k, rounds, scale, seed="2"):
    ids = [i for i, _ in vectors]
    v = np.array([[math.floor(scale * x) for x in e] for _, e in vectors], object)
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), v[i].tolist()))
    c = [v[i] for i in order[:k]]

    def nearest():
        return [min((sum((x - y) ** 2), j) for j, y in enumerate(c)) for x in v]
    for _ in range(rounds):
        near = nearest()
        for j in range(len(c)):
            own = [v[i] for i, (_, a) in enumerate(near) if a == j]
            c[j] = np.array([s // len(own) for s in sum(own)], object) if own else c[j]
    near = nearest()
    inertia = [sum(d for d, a in near if a == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, j, d, inertia[j], sum(inertia), sha[j]) for i, (d, j) in zip(ids, near)]


def cluster_rows(spread, large=1.0):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((9, 8))
    made = [(i, (large * (centres[i % 9] + spread * rng.standard_normal(8))).tolist()) for i in range(400)]
    return made + [made[3], (77, made[5][1]), (None, made[9][1])]


BAD = [(900, None), (901, []), (902, [NAN] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [INF] * 8), (905, [1.0] * 7), (906, [1.0] * 9)]


@pytest.mark.parametrize("spread,k,large", [(0.05, 12, 1.0), (1.5, 7, 1.0), (0.2, 500, 1.0), (1.0, 6, 1e5)])
def test_clusters_equal_plain_rounds(spark, spread, k, large):
    made = cluster_rows(spread, large)[:: 10 if k == 500 else 1]
    table = spark.createDataFrame([(i, e, 1, 2.0) for i, e in made + BAD], "vec_id long, embedding array<double>, cluster int, v double").repartition(3)
    got = [tuple(r) for r in centroid_clustering.cluster(table, k, 4, 8, 256.0).collect()]
    assert sorted(got, key=repr) == sorted(plain(made, k, 4, 256.0), key=repr)


def test_bounds_spare_scans(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (10, 16))
    rows_ = centres[np.arange(3000) % 10] + rng.integers(-40, 40, (3000, 16))
    history = centres[None] + rng.integers(-30, 30, (1, 10, 16))
    cluster, near, others = centroid_clustering.scan(rows_, history[0])
    for _ in range(3):
        history = np.concatenate([history, history[-1:] + rng.integers(-9, 9, (1, 10, 16))])
        kept = centroid_clustering.settled(rows_, cluster, np.zeros(3000, np.int64), near, others, history)
        assert (centroid_clustering.distances(rows_, history[-1]).argmin(axis=1)[kept] == cluster[kept]).all() and kept.mean() > 0.9
    # the norm of the total displacement, not the sum of the moves: back at the first centroids every bound is tight again
    history = np.concatenate([history, history[:1] + 500, history[:1]])
    assert centroid_clustering.settled(rows_, cluster, np.zeros(3000, np.int64), near, others, history).all()


def test_ties_go_to_the_smaller_number():
    now = np.array([[0, 0], [4, 0], [0, 0]])
    rows_ = np.array([[2, 0], [0, 0], [3, 0]])
    cluster, near, others = centroid_clustering.scan(rows_, now)
    assert cluster.tolist() == [0, 0, 1] and near.tolist() == [4, 0, 1]
    assert not centroid_clustering.settled(rows_[:1], np.array([1]), np.array([0]), near[:1], others[:1], now[None])[0]


def test_no_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroid_clustering.cluster(spark.createDataFrame(BAD, schema), 3, 2, 8).count() == 0
    with pytest.raises(Exception, match="larger than"):
        centroid_clustering.cluster(spark.createDataFrame([(1, [1e9] * 8)], schema), 3, 2, 8).count()
