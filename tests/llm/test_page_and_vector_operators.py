"""Vector, page and archive operators against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from turfline.llm import embedding_dedup, hash_forest, html_extract, url_reputation, warc_archive
from turfline.llm.components import components, local_roots
from turfline.llm.queries import OP6, RULES
from turfline.session import scratch

NAN, INF = float("nan"), float("inf")


# --- vectors -------------------------------------------------------------------------
def vector_rows(seed: int = 4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 24))
    made = [(centres[i % 12] + 0.33 * rng.standard_normal(24)).tolist() for i in range(300)]
    made += [made[5], [2 * x for x in made[5]], [-x for x in made[5]], (1e-200 * np.array(made[7])).tolist(), (1e200 * np.array(made[7])).tolist()]
    made += [None, [], [0.0] * 24, [NAN] + [1.0] * 23, [INF] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3, "x") for i, v in enumerate(made)]
    return rows + [rows[0], (None, made[5], 0, "x")]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>, grp int, dim string").repartition(4).cache()


def cosine(a, b):
    a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
    return float(a @ b / math.sqrt(float(a @ a) * float(b @ b)))


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("group,tile", [(8192, 1024), (40, 16)])
def test_near_vectors_equal_all_pairs(vectors, monkeypatch, group, tile):
    monkeypatch.setattr(embedding_dedup, "GROUP", group)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    own = {i: v for i, v, _, _ in vector_rows() if i is not None and usable(v)}
    ids = sorted(own)
    links = [(a, b) for a in ids for b in ids if a != b and len(own[a]) == len(own[b]) and cosine(own[a], own[b]) >= 0.9]
    assert len(links) > 500
    at = {x: k for k, x in enumerate(ids)}
    roots = local_roots(len(ids), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert len(got) == len(vector_rows())
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            continue
        root = ids[roots[at[r.vec_id]]] if r.vec_id in at else r.vec_id
        assert (r.n_links, r.component_id, r.kept) == (sum(a == r.vec_id for a, _ in links), root, root == r.vec_id)


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 2500):
        rows = embedding_dedup.unit(rng.standard_normal((60, dim)))
        q, scale, error = embedding_dedup.quantised(rows)
        exact = q.astype(np.int64) @ q.astype(np.int64).T
        assert np.array_equal(embedding_dedup.product(q, q), exact)
        bound = error[:, None] + error[None, :] + error[:, None] * error[None, :]
        assert (np.abs(rows @ rows.T - exact * scale[:, None] * scale[None, :]) <= bound).all()


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 240)}}


def test_forest_recall_order_and_scores(vectors, monkeypatch):
    monkeypatch.setattr(hash_forest, "SHARD_ROWS", 120)
    monkeypatch.setattr(hash_forest, "QUERY_BLOCK", 10)
    monkeypatch.setattr(hash_forest, "LEAST_CANDIDATES", 20)
    own = {i: v for i, v, _, _ in vector_rows() if i is not None and usable(v)}
    got: dict = {}
    for r in hash_forest.nearest(vectors, vectors.where("vec_id % 5 = 0"), share=0.3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in own if i % 5 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        best = sorted(((-cosine(own[q], v), i) for i, v in own.items() if i != q and len(v) == len(own[q])))[:5]
        assert [k for k, _, _ in found] == list(range(1, len(best) + 1))
        assert all(i != q and abs(s - cosine(own[q], own[i])) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
        total += len(best)
    assert hits / total >= 0.9


def test_forest_recall_on_the_given_vectors(spark):
    from turfline.llm.queries import op8

    d = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = {(r.query_id, r.vec_id) for r in op8(spark, d).collect()}
    want = {(q, i) for q in rows if q % 50 == 0 for _, i in sorted((-cosine(rows[q], v), i) for i, v in rows.items() if i != q)[:5]}
    assert len(got & want) / len(want) >= 0.9


def forest(rows, queries, trees=hash_forest.TREES):
    hashed = hash_forest.strings(rows, trees)
    order = np.argsort(hashed, axis=0, kind="stable").T
    return hash_forest.Shard(rows, np.arange(len(rows)), order, np.take_along_axis(hashed.T, order, axis=1), queries)


@pytest.mark.parametrize("spread,most", [(0.05, 0.05), (0.15, 0.2), (5.0, 0.9)])
def test_clustered_vectors_are_compared_with_few(spread, most):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((400, 64))
    rows = centres[np.arange(8192) % 400] + spread * rng.standard_normal((8192, 64))
    shard = forest(rows, rows[:60])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    hits = compared = 0
    for q in range(60):
        near = shard.candidates(q, q, 5, hash_forest.SHARE)
        compared += len(near)
        best = np.argsort(-(unit @ unit[q]), kind="stable")[1:6]
        hits += np.isin(best, near).sum()
    assert hits / 300 >= 0.9 and compared / 60 <= most * len(rows)


def test_hot_copies_come_back_in_order_of_id(spark):
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 2 else rng.standard_normal(16).tolist()) for i in range(1200)]
    got = hash_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(901, hot)], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id) for r in got.orderBy("rank").collect()] == [(k + 1, 2 * k + 1) for k in range(5)]


def test_empty_vector_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert hash_forest.nearest(empty, empty).count() == 0


# --- pages ---------------------------------------------------------------------------
ARTICLE = "<h1>Head &amp; line</h1><p>First paragraph, with <b>bold</b> words;\n and <a href='/x'>a link</a>.<p>Second one<br>goes on. It is long enough, surely, to count.<ul><li>Item one.<li>Item two.</ul>"
WANT = "Head & line\n\nFirst paragraph, with bold words; and a link.\n\nSecond one goes on. It is long enough, surely, to count.\n\nItem one.\n\nItem two."
AROUND = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><div>Site name</div><nav><ul><li><a href=/>Home</a></ul></nav></header><div class="cookie-notice">We use cookies, as you know. Accept?</div>
<!-- <p>no</p> --><aside><p>Side words, many of them, in a row.</p></aside>{}<form><p>Your name, please.</p></form><div id="comments"><p>I disagree, and so on, at length, with reasons.</p></div>
<div class="ad">Buy, buy, buy!</div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=x1>{}</div>", "<article>{}<section class='related-posts'><p>Other, too.</p></section></article>"])
def test_main_text(frame):
    assert html_extract.main_text(AROUND.format(frame.format(ARTICLE))) == WANT


NAMED = ["<div class='content-sidebar-wrap'><main>{}</main></div>", "<div class='site has-fixed-header'><article>{}</article></div>", "<form id=aspnetForm><div>{}</div></form>",
         "<div class='share-layout'><div class='x1'>{}</div></div>", "<main><div class='tags notice'>{}</div></main>", "<div role=form class=search-page>{}</div>",
         "<div class='page ads-on'><div class='has-comments'>{}</div></div>", "<span id=ctl00_FormView1_lblText>{}</span><p class=x2></p>",
         "<div class='site has-fixed-header'><main>{}</main><div class='sidebar'><p>" + "Side words, many of them. " * 50 + "</p></div></div>",
         "<div class='content-sidebar-wrap'><article>{}</article></div><div id='replies'><article><p>" + "I disagree, at length. " * 50 + "</p></article></div>"]


@pytest.mark.parametrize("frame", NAMED)
def test_wrappers_with_a_listed_name(frame):
    assert html_extract.main_text(AROUND.format(frame.format(ARTICLE))) == WANT
    assert html_extract.main_text("<body>" + frame.format(ARTICLE)) == WANT


def test_unnamed_menus_of_links_around_the_content():
    text = html_extract.main_text
    long_ = "A paragraph, with a <a href=/x>link</a> and words, that goes on."
    plain = "A paragraph, with a link and words, that goes on."
    menu = "<div><a href=/>Home</a></div><ul><li><a href=/a>About</a> <li><a href=/b><b>All</b></a></ul>"
    assert text(f"<body>{menu}<p>{long_}</p><p><a href=/c>Within</a></p><p>{long_}</p>{menu}") == f"{plain}\n\nWithin\n\n{plain}"
    assert text(f"<body>{menu}<h2>Head</h2><p>{long_}</p><p>Short</p>{menu}") == f"Head\n\n{plain}\n\nShort"
    assert text(f"<article><p>{long_}</p><ul><li><a href=/s>Source</a></ul></article>") == f"{plain}\n\nSource"
    assert text("<p><a name=top>Anchored words.</p><p>More.</p>") == "Anchored words.\n\nMore."
    assert text("<p><a href=/>Only this</a></p>") == "Only this"


def test_awkward_pages():
    text = html_extract.main_text
    assert text(None) == text("") == text("<p> </p>") == text("<script>x") == ""
    assert text("plain  words\n only") == "plain words only"
    assert text("<p>1 < 2 & 3 > 2 &lt;b&gt; &#65;&eacute;&nbsp;x") == "1 < 2 & 3 > 2 <b> Aé x"
    assert text("<div><p>cut <b>bold") == "cut bold"
    assert text("<p title='a>b'>kept</p>") == "kept"
    assert text("<article><p>" + "long, words. " * 50_000 + "</article>") == ("long, words. " * 50_000).strip()
    assert text("<" * 5000) == "<" * 5000
    assert text("<p>One.</p><svg class=i /><p>Two, more.</p><!--><p>Three.</p>") == "One.\n\nTwo, more.\n\nThree."
    assert text("<p>A <svg><path d='1'><g>t</g></svg> b <button>Go</button> c.</p>") == "A b c."
    assert text("<p>A <span class='ad'><span>x</span> y</span> z.</p><p>One <span class='ad'><b>bad</span> two.") == "A z.\n\nOne two."
    assert text("<p>Three <span class='ad'>x</p><p>Four.</p>") == "Three\n\nFour."
    text("<div>" * 3000 + "deep" + "</p></td>" * 3000)
    text('<a href="' * 2000)


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", "<p>a", 3), (1, "u", "<p>a", 3), (None, None, None, 1)]
    got = sorted(map(tuple, html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SENTENCE = "A first paragraph, long enough, with words."


def test_paths_below_the_threshold_are_left_out():
    text, three = html_extract.main_text, f"<p>{SENTENCE}</p>" * 3
    want = "\n\n".join([SENTENCE] * 3)
    assert text(f"<article>{three}<div>Share this story</div><ul><li><a href=a>One more</a></li><li><a href=b>And another</a></li></ul></article>") == want
    assert text(f"<div><span>Home</span> <span>News</span></div><div>{three}</div><div>All rights reserved 2020</div>") == want
    assert text(f"<div>{three}</div><div>Buy our thing now</div>") == want
    assert text(f"<article>{three}<p class=form>In a form.</p><p class='comment-text'>Said.</p><p>{SENTENCE}</p></article>") == f"{want}\n\nIn a form.\n\nSaid.\n\n{SENTENCE}"
    assert text("<p>AT&<b>amp;</b> and &am<i>p;</i>") == "AT&amp; and &amp;"


def test_the_threshold_decides_on_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    low, own = ([html_extract.main_text(x, t) for x in pages] for t in (0.0, html_extract.THRESHOLD))
    assert sum(a != b for a, b in zip(low, own)) > len(pages) // 2 and all(len(a) >= len(b) for a, b in zip(low, own))


def test_scores_equal_their_definition():
    page = html_extract._Page("<body><div>Menu<a href=/>x</a></div><div><p>One, two.</p><p>Three and four, five; six.</p></div><p>No points</p><div class=ad>Buy, buy.</div>")
    marked = page.standing(set())
    got = html_extract.scores(page, list(range(len(page.texts))), marked)
    paths = [["body", "div"], ["body", "div", "p"], ["body", "div", "p"], ["body", "p"], ["body", "div", "ad"]]
    length, points = [4, 9, 26, 9, 9], [0, 2, 3, 0, 2]
    most = max(17.5, 9), 2.5
    ratio = [math.sqrt(4 / 17.5 * 0), 1.0, 1.0, 0.0, math.sqrt(9 / 17.5 * 2 / 2.5) * html_extract.MARKED]
    row = [ratio[0], *ratio, ratio[-1]]
    smooth = [row[i] / 4 + row[i + 1] / 2 + row[i + 2] / 4 for i in range(5)]
    want = {}
    for path in map(tuple, paths):
        at = [i for i in range(5) if tuple(paths[i]) == path]
        want[path] = math.sqrt(ratio[at[0]] * sum(smooth[i] for i in at) / len(at))
    assert most == (17.5, 2.5) and sum(length) == 57 and sum(points) == 7
    assert sorted(got.values()) == pytest.approx(sorted(want.values())) and len(got) == 4


def test_deep_pages_take_linear_time():
    for unit in ("<div>x, y.", "<div class=form>x", "<ul><li>x.", "<span class=ad><p>x", "<form><article>x."):
        html_extract.main_text(unit * 20_000)


# --- archive -------------------------------------------------------------------------
def test_archive_restores_every_record(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "RECORDS_PER_PART", 3)
    big, small = "é" * 50 + " body", "tiny"
    rows = [(5, "http://a/\r\nX: y", big, 1), (3, "http://b/", big, 1), (9, None, big, 1), (9, None, big, 1), (1, "u", small, 1), (2, "u", small, 1),
            (4, "u", None, 1), (None, "u", big, 1), (6, "u", "x" * 99, 1), (7, "u", "x" * 99, 1), (10, "u", "WARC-Type: response\r\n\r\n" * 9, 1)] + [(100 + i, "h", "hot " * 40, 1) for i in range(20)]
    folder = scratch(spark, "warc-test")
    warc_archive.write(spark.createDataFrame(rows, "id long, target string, payload string, digest int"), folder)
    W = warc_archive
    got = W.read(spark, folder).select(W.page_id("WARC-Record-ID").alias("id"), W.field("WARC-Type").alias("kind"), W.page_id("WARC-Refers-To").alias("to"), "payload", W.field("WARC-Payload-Digest").alias("digest")).collect()
    want = []
    for i, _, payload, _ in rows:
        raw = (payload or "").encode()
        first = min((j for j, _, p, _ in rows if p == payload and j is not None), default=None)
        to = first if len(raw) >= 100 and i is not None and i > first else None
        want.append((i, "response" if to is None else "revisit", to, raw, "sha256:" + hashlib.sha256(raw).hexdigest()))
    assert sorted(map(str, [(r.id, r.kind, r.to, bytes(r.payload), r.digest) for r in got])) == sorted(map(str, want))
    assert spark.read.parquet(f"{folder}/payloads").count() == len({p or "" for _, _, p, _ in rows})
    records = [bytes(r.record) for r in W.records(spark, folder).collect()]
    assert len(records) == len(rows)
    for record in records:
        head, _, body = record.partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert body[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029", "\r\n", "\n", "\r", "\x0b", "\x0c"])
def test_no_url_makes_a_header_field(spark, mark):
    W, folder = warc_archive, scratch(spark, "warc-urls")
    url = f"http://a/{mark}WARC-Refers-To: <urn:page:77>{mark}WARC-Type: revisit{mark}"
    W.write(spark.createDataFrame([(1, url, "x" * 200)], "id long, target string, payload string"), folder)
    one = W.read(spark, folder).select(W.field("WARC-Type").alias("kind"), W.page_id("WARC-Refers-To").alias("to"), W.field("WARC-Target-URI").alias("url")).first()
    assert (one.kind, one.to, one.url) == ("response", None, url.replace("\r", "%0D").replace("\n", "%0A"))


def test_archive_finds_a_changed_payload(spark):
    folder = scratch(spark, "warc-bad")
    warc_archive.write(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "id long, target string, payload string"), folder)
    store = spark.read.parquet(f"{folder}/payloads").collect()
    bad = [(r.digest, r.first_id, r.records, b"changed") for r in store]
    spark.createDataFrame(bad, spark.read.parquet(f"{folder}/payloads").schema).write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_archive.read(spark, folder).collect()


def test_empty_archive(spark):
    folder = scratch(spark, "warc-empty")
    warc_archive.write(spark.createDataFrame([], "id long, target string, payload string"), folder)
    assert warc_archive.read(spark, folder).count() == 0
    assert "sha256" in OP6


# --- urls ----------------------------------------------------------------------------
URLS = ["https://EXAMPLE.Org/es/1", "http://a.example.org/en/12?x", "http://example.org", "http://notexample.org/es/", "ftp://x.com/fr/1#t", "http://x.com/de/", "http://com/fr/", "http://xcom/fr/",
        "http://u.org/?q=http://y.com/de/", "nothing", None, "", "://h/p", "http://h:80\n/x", "http://É.net/É"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_reputation.judge(pages, none, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = rest
        for stop in "/?#":
            host = host.partition(stop)[0]
        path = rest[len(host):]
        for stop in "?#":
            path = path.partition(stop)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), rule, v) for v, rule in RULES for h, s, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        want = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2])


def test_reputation_shrinks_towards_the_parents(spark):
    rows, outcomes = [], []
    for host, n, bad in (("bad.spam.example", 60, 58), ("worse.spam.example", 3, 3), ("new.spam.example", 0, 0), ("good.fine.example", 80, 2), ("odd.fine.example", 1, 1)):
        for k in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{k}"))
            if k < n:
                outcomes.append((len(rows) - 1, k < bad))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.host: r.verdict for r in url_reputation.judge(pages, spark.createDataFrame(outcomes + [(None, True), (0, None)], "page_id long, bad boolean"), []).collect()}
    assert got["bad.spam.example"] == "block" and got["good.fine.example"] == got["odd.fine.example"] == "allow"
    counts = spark.createDataFrame([("a.x", 10, 9), ("b.x", 10, 1), ("c.x", 1, 1)], "host string, n long, bad long")
    means = {r.host: (r.mean, r.low) for r in url_reputation.reputation(counts).collect()}
    assert means["b.x"][0] < means["c.x"][0] < means["a.x"][0] < 0.9 and all(low < mean for mean, low in means.values())


def posterior(hosts, parts):
    """Lower bound of the bad rate of every host, level by level."""
    total = sum(n for n, _ in hosts.values())
    prior = {(): sum(b for _, b in hosts.values()) / total}
    keys = [lambda h: (), lambda h: (parts[h][0],), lambda h: parts[h], lambda h: (*parts[h], h)]
    for up, key in zip(keys, keys[1:]):
        groups, above = {}, {}
        for h, (n, b) in hosts.items():
            g = groups.setdefault(key(h), [0, 0])
            g[0] += n
            g[1] += b
            above[key(h)] = prior[up(h)]
        use = [(n, b, above[g]) for g, (n, b) in groups.items() if n and 0 < above[g] < 1]
        scatter, m, n_all = sum((b - n * p) ** 2 / n / (p * (1 - p)) for n, b, p in use), len(use), sum(n for n, _, _ in use)
        k = 1.0 if not m or n_all <= m else 10_000.0 if scatter <= m else min(10_000.0, max(1.0, (n_all - m) / (scatter - m) - 1))
        prior = {g: (b + above[g] * k) / (n + k) for g, (n, b) in groups.items()}
        weight = {g: n + k for g, (n, _) in groups.items()}
    return {h: (prior[keys[-1](h)], prior[keys[-1](h)] - 1.645 * math.sqrt(prior[keys[-1](h)] * (1 - prior[keys[-1](h)]) / (weight[keys[-1](h)] + 1))) for h in hosts}


def test_planted_hosts_are_blocked_by_their_posterior(spark):
    rng = np.random.default_rng(6)
    hosts, parts = {}, {}
    for d in range(12):
        for h in range(5):
            name, rate = f"h{h}.d{d}.{'xyz'[d % 3]}", 0.9 if d in (1, 5) else 0.1
            n = int(rng.integers(0, 60))
            hosts[name], parts[name] = (n, int(rng.binomial(n, rate))), ("xyz"[d % 3], f"d{d}.{'xyz'[d % 3]}")
    want = posterior(hosts, parts)
    counts = spark.createDataFrame([(h, n, b) for h, (n, b) in hosts.items()], "host string, n long, bad long")
    got = {r.host: (r.mean, r.low) for r in url_reputation.reputation(counts).collect()}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)
    pages, outcomes = [], []
    for h, (n, b) in hosts.items():
        for k in range(n + 1):
            pages.append((len(pages), f"http://{h}/{k}"))
            if k < n:
                outcomes.append((len(pages) - 1, k < b))
    said = {r.host: r.verdict for r in url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"), []).collect()}
    assert said == {h: "block" if want[h][1] > 0.5 else "allow" for h in hosts}
    assert {h for h, v in said.items() if v == "block"} > {h for h, (n, _) in hosts.items() if n > 20 and parts[h][1] in ("d1.y", "d5.z")}


def test_domains_and_suffixes(spark):
    want = {"a.b.com.sg": ("com.sg", "b.com.sg"), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", "co.uk"), "www.host.org:8080": ("org", "host.org"), "10.0.0.1": ("address", "10.0.0.1"),
            "10.0.0.1:80": ("address", "10.0.0.1"), "[::1]:8": ("address", "[::1]"), "": ("", ""), "com": ("com", "com"), "a.b.c.net": ("net", "c.net"), "my.blog.site": ("site", "blog.site")}
    hosts = spark.createDataFrame([(h, 1) for h in want], "host string, n int")
    assert {r.host: (r.suffix, r.domain) for r in url_reputation.named(hosts).collect()} == want
    listed = spark.createDataFrame([("blog.site",), ("site",), (None,), ("",), ("c.net",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in url_reputation.named(hosts, listed).collect()}
    assert got == want | {"my.blog.site": ("blog.site", "my.blog.site"), "a.b.c.net": ("c.net", "b.c.net")}


def test_no_pages(spark):
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, True)], "page_id long, bad boolean"), RULES).count() == 0
