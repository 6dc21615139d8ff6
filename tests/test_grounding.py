from __future__ import annotations

import random

import pytest
from slow_reference import window_score

from turfline.operators import grounding
from turfline.operators.grounding import check_citations, ground_report, rule_gate
from turfline.functions.text import page_text
from pyspark.sql import functions as F


def test_window_search_equals_definition(spark, monkeypatch):
    monkeypatch.setattr(grounding, "TOKENS_PER_COPY", 6)
    rng = random.Random(4)
    pages = {f"u{i}": " ".join(rng.choice(["a", "b", "cc", "d", "ee"][: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 60))) for i in range(40)}
    pages |= {f"v{i}": " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(20)) for _ in range(400)) for i in range(10)}
    cites = []
    for n in range(400):
        url = rng.choice(list(pages))
        words = pages[url].split()
        at = rng.randrange(len(words))
        quote = words[at:at + rng.randrange(1, 30)]
        for _ in range(rng.randrange(4)):
            quote.insert(rng.randrange(len(quote) + 1), rng.choice(["a", "b", "zz"]))
        if len(quote) > 3 and n % 2:
            del quote[rng.randrange(len(quote))]
        cites.append((n, url, " ".join(quote)))
    table = spark.createDataFrame(cites, "n long, url string, quote string")
    checked = check_citations(table, spark.createDataFrame(list(pages.items()), "url string, content string"))
    got = {r.n: r.score for r in checked.collect()}
    assert len(got) == len(cites)
    for n, url, quote in cites:
        want = 1.0 if quote in pages[url] else window_score(pages[url], quote)
        assert got[n] == pytest.approx(want, abs=1e-12), (n, url, quote)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_urls_statuses_and_a_hot_page(spark, monkeypatch):
    monkeypatch.setattr(grounding, "CITATIONS_PER_COPY", 7)
    pages = spark.createDataFrame([("u", "one two three", 200), ("u", "one two three", 200), ("u", "zzz", 200), ("v", "broken words here", 500), ("w", None, 200), ("x", "", 200), (None, "y", 200)],
                                  "url string, content string, status int")
    cites = spark.createDataFrame([(i, "u", "two three" if i % 2 else "four") for i in range(50)] + [(100, "v", "broken words"), (101, "w", "a"), (102, "x", "a"), (103, "gone", "a"),
                                                                                                      (104, None, "y"), (105, "u", None), (105, "u", None)], "n long, url string, quote string")
    got = {}
    for r in check_citations(cites, pages).collect():
        got.setdefault(r.n, []).append((r.verdict, r.score))
    assert sum(map(len, got.values())) == 57 and len(got[105]) == 2
    assert all(got[i] == [("GROUNDED", 1.0) if i % 2 else ("NOT_FOUND", 0.0)] for i in range(50))
    assert all(got[i] == [("UNREACHABLE", 0.0)] for i in range(100, 105)) and got[105][0] == ("NOT_FOUND", 0.0)


PAGES = [
    ("mock://a", "<p>(b)&nbsp;A sheet is void unless the person who carried it writes their full name, the county where they live "
                 "and the day on which the last line was signed at the foot of that same sheet.</p>"),
    ("mock://b", "Where the clerk draws a sample and finds that between one quarter and one third of the drawn lines are void, "
                 "the clerk must read every line of every sheet before the fourteenth day after the drawing ends."),
]
CASES = [
    ("mock://a", "writes their full name, the county where they live and the day on which the last line was signed", "GROUNDED"),
    ("mock://b", "between one quarter and one third of the drawn lines are VOID,  the clerk must read every line", "GROUNDED"),
    ("mock://b", "the clerk must read each line of every sheet before the", "PARTIAL"),
    ("mock://a", "online portals accept uploads from tablets on holidays without further proof", "NOT_FOUND"),
    ("mock://gone", "anything", "UNREACHABLE"),
]


def test_five_verdicts_and_report(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string").select("url", page_text("html").alias("content"))
    cites = spark.createDataFrame([(i, u, q) for i, (u, q, _) in enumerate(CASES)], "field_id long, url string, quote string")
    checked = check_citations(cites, pages).persist()
    got = {r["field_id"]: (r["verdict"], r["score"]) for r in checked.collect()}
    assert [got[i][0] for i in range(5)] == [v for _, _, v in CASES]
    page = pages.where("url = 'mock://b'").first()["content"].lower()
    assert got[2][1] == pytest.approx(window_score(page, CASES[2][1]))
    report = ground_report(checked.withColumn("b", F.lit(1)), ["b"]).first()
    assert (report["gate"], report["grounded_rate"]) == ("FAIL", 0.5)
    fields = spark.createDataFrame([(i, f"v{i}", None) for i in range(5)], "field_id long, value string, fallback string")
    judged = spark.createDataFrame([(0, True, False), (1, True, True)], "field_id long, agree boolean, interpretation_required boolean")
    gates = {r["field_id"]: (r["gate"], r["reason"]) for r in rule_gate(fields, checked, judged).collect()}
    assert gates[0] == ("AUTO-LIVE", "ok") and gates[1] == ("CONSERVATIVE-HOLD", "interpretation")
    assert gates[3] == ("BLOCKED", "citation_integrity") and gates[4] == ("BLOCKED", "all_unreachable")
