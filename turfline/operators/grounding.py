"""Does a quote appear in the page it cites, and may the field it backs go live?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import quote_fold
from turfline.session import stage

#: Citations that one copy of a page's text is compared with.
CITATIONS_PER_COPY = 1000
#: Different words of altered quotes that one copy of a page's text is searched for.
TOKENS_PER_COPY = 2000


def one_page_per_url(pages: DataFrame) -> DataFrame:
    """(url, content) with one row for each url: its readable text, of several the one that sorts first, else null.

    ``pages``: url, content, and maybe ``status``; a page whose fetch status is not 200 to 299 has no readable text.
    """
    text = F.nullif(quote_fold("content"), F.lit(""))
    if "status" in pages.columns:
        text = F.when(F.col("status").between(200, 299), text)
    return pages.groupBy("url").agg(F.min(text).alias("content"))


def exact_quotes(citations: DataFrame, texts: DataFrame) -> DataFrame:
    """``citations`` with ``found`` (its page has text) and ``is_exact`` (the folded quote is part of it).

    The citations of a url travel to its text in groups, so the text is copied once for ``CITATIONS_PER_COPY`` citations and no citation
    row ever holds it; a url with a third of all citations has many groups.
    """
    columns = citations.columns
    counts = citations.groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.select(F.col("url").alias("_url"), F.ceil(F.col("_n") / CITATIONS_PER_COPY).alias("_groups"))
    group = F.pmod(F.xxhash64(*columns), F.coalesce("_groups", F.lit(1))).alias("_group")
    dealt = citations.join(groups, F.col("url") == F.col("_url"), "left").select(*columns, group)
    together = dealt.groupBy("url", "_group").agg(F.collect_list(F.struct(*(c for c in columns if c != "url"), quote_fold("quote").alias("_quote"))).alias("_own"))
    met = together.join(texts, "url", "left")
    found = F.col("content").isNotNull()
    tested = F.transform("_own", lambda c: F.struct(c.alias("c"), (found & (c["_quote"] != "") & F.contains(F.col("content"), c["_quote"])).alias("e")))
    rows = met.select("url", found.alias("found"), F.explode(tested).alias("_r"))
    return rows.select(*(F.col("url") if c == "url" else F.col(f"_r.c.{c}") for c in columns), "found", F.coalesce("_r.e", F.lit(False)).alias("is_exact"))


def window_scores(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, score) of the best window for every quote (cid, url, quote; folded) that shares a word with its page.

    A window lies around an occurrence of the quote's rarest word and is as long as the quote or ``WIDER_WINDOW`` longer; its score is the
    better of the Dice overlap of both bigram multisets and the share of the quote's bigrams.  An inverted index holds (url, token, next
    token, position) of the quotes' words only; a page picks them out before anything of it is shuffled by word.  From it come the rarest word, its places, and the places where a bigram of the
    quote stands.  Moving a window's start to the next such place, or to the rarest word, never lowers its score, so only those starts are
    tried.  A place counts in a window unless the window holds as many earlier ones of its bigram as the quote.  Places meet windows by
    stretch of the page, so the work is linear in the places.
    """
    wide = fixed.WIDER_WINDOW
    q = quotes.withColumn("w", F.split("quote", " ")).withColumn("m", F.size("w")).where("m > 1")
    words = q.select("cid", "url", "m", F.posexplode("w").alias("i", "token"), "w").select(
        "cid", "url", "m", "i", "token", F.get("w", F.col("i") + 1).alias("next"))
    words = stage(words, "quote-words")
    tokens = words.select("url", "token").distinct()
    parts = tokens.groupBy("url").agg(F.ceil(F.count(F.lit(1)) / TOKENS_PER_COPY).alias("_parts"))
    wanted = tokens.join(parts, "url").groupBy("url", F.pmod(F.xxhash64("token"), "_parts").alias("_part")).agg(F.collect_list("token").alias("_wanted"))
    page = texts.where("content IS NOT NULL").join(wanted, "url").withColumn("w", F.split("content", " "))
    place = F.transform("w", lambda t, i: F.when(F.array_contains("_wanted", t), F.struct(i.alias("pos"), t.alias("token"), F.get("w", i + 1).alias("next"))))
    found = F.explode(F.filter(place, lambda x: x.isNotNull())).alias("x")
    index = stage(page.select("url", F.size("w").alias("n"), found).select("url", "n", "x.*"), "positions")

    counts = index.groupBy("url", "token").agg(F.count(F.lit(1)).alias("times"))
    rarest = words.join(counts, ["url", "token"]).groupBy("cid", "url", "m").agg(
        F.min(F.struct("times", (-F.length("token")).alias("l"), "i", "token")).alias("r")).select("cid", "url", "m", "r.token")
    spots = rarest.join(index.select("url", "token", "n", F.col("pos").alias("p")), ["url", "token"]).select("cid", "m", "n", "p")

    need = words.where("next IS NOT NULL").groupBy("cid", "url", "m", "token", "next").agg(F.count(F.lit(1)).alias("need"))
    places = need.join(index.where("next IS NOT NULL").select("url", "token", "next", "pos"), ["url", "token", "next"]).groupBy(
        "cid", "m", "token", "next", "need").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    since = lambda p, k: F.struct(p.alias("pos"), F.coalesce(F.get("at", k - F.col("need").cast("int")), F.lit(-1)).alias("since"))
    stretch = lambda at: F.floor(at / (F.col("m") + wide))
    places = stage(places.select("cid", "m", F.explode(F.transform("at", since)).alias("h")).select("cid", "m", "h.*").withColumn("part", stretch(F.col("pos"))), "places")

    length = F.explode(F.array(F.col("m"), F.col("m") + wide)).alias("l")
    spots = stage(spots.select("cid", "m", "n", "p", length), "spots")
    near = spots.withColumn("part", F.explode(F.array(stretch(F.col("p")) - 1, stretch(F.col("p"))))).join(places.select("cid", "part", "pos"), ["cid", "part"])
    starts = near.where("pos <= p AND pos > p - l").select("cid", "m", "n", "l", F.col("pos").alias("s")).unionByName(
        spots.select("cid", "m", "n", "l", F.col("p").alias("s"))).distinct()
    starts = starts.withColumn("size", F.greatest(F.least(F.col("s") + F.col("l"), "n") - 1 - F.col("s"), F.lit(0)))
    met = starts.withColumn("part", F.explode(F.array(stretch(F.col("s")), stretch(F.col("s")) + 1))).join(
        places.select("cid", "part", "pos", "since"), ["cid", "part"]).where("pos >= s AND pos < s + size AND since < s")
    shared = met.groupBy("cid", "m", "l", "s", "size").agg(F.count(F.lit(1)).alias("common"))
    score = F.greatest(2 * F.col("common") / (F.col("m") - 1 + F.col("size")), F.col("common") / (F.col("m") - 1))
    return shared.groupBy("cid").agg(F.max(score).alias("score"))


def verdict(score: Column) -> Column:
    return (
        F.when(score >= fixed.GROUNDED_AT, "GROUNDED").when(score >= fixed.PARTIAL_AT, "PARTIAL").otherwise("NOT_FOUND"))


def check_citations(citations: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Score and verdict per citation (url, quote) against pages (url, content, maybe status); every citation keeps one row.

    A citation without a readable page is UNREACHABLE.  The exact stage is a substring test, the others go through ``window_scores``.
    """
    cited = citations.select("url").distinct()
    texts = stage(one_page_per_url(pages.join(cited, "url", "left_semi")), "page-texts")
    numbered = exact_quotes(citations, texts).withColumn("_cid", F.monotonically_increasing_id())
    tested = stage(numbered, "exact") if fuzzy else numbered  # written, so that the numbers stay
    score = F.col("is_exact").cast("double")
    if fuzzy:
        rest = tested.where("found AND NOT is_exact").select(F.col("_cid").alias("cid"), "url", quote_fold("quote").alias("quote"))
        tested = tested.join(window_scores(rest, texts).withColumnsRenamed({"cid": "_cid", "score": "_best"}), "_cid", "left")
        score = F.when(F.col("is_exact"), 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    out = tested.withColumn("score", score).withColumn("verdict", F.when(F.col("found"), verdict(F.col("score"))).otherwise("UNREACHABLE"))
    return out.select(*citations.columns, "is_exact", "score", "verdict")


def ground_report(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by verdict, rate over reachable citations, and the gate of the batch."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("GROUNDED", "PARTIAL", "NOT_FOUND", "UNREACHABLE")}
    total = F.count(F.lit(1))
    return checked.groupBy(*keys).agg(
        total.alias("citations"), *[c.alias(v.lower()) for v, c in n.items()],
        F.coalesce(F.try_divide(n["GROUNDED"], total - n["UNREACHABLE"]), F.lit(0.0)).alias("grounded_rate"),
        F.when(n["NOT_FOUND"] > 0, "FAIL").when(n["UNREACHABLE"] > 0, "RE-FETCH").when(n["PARTIAL"] > 0, "REVIEW")
        .otherwise("PASS").alias("gate"))


def default_judgements(fields: DataFrame) -> DataFrame:
    """Rule-based judgement: a stale-looking value disagrees, some subjects need interpretation."""
    stale, legal = F.lower("value").rlike(fixed.STALE_VALUE), F.lower("field").rlike(fixed.LEGAL_FIELD)
    return fields.select(
        "field_id", (~stale).alias("agree"), (legal & ~stale).alias("interpretation_required"),
        F.when(stale, 0.4).when(legal, 0.7).otherwise(0.95).alias("confidence"))


def rule_gate(fields: DataFrame, checked: DataFrame, judgements: DataFrame) -> DataFrame:
    """Gate per field.

    ``fields``: field_id, value, fallback.  ``checked``: field_id, verdict.  ``judgements``: field_id, agree,
    interpretation_required; a field without a judgement is held.
    """
    counts = checked.groupBy("field_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("GROUNDED", "PARTIAL", "NOT_FOUND", "UNREACHABLE")],
        F.count(F.lit(1)).alias("_n"))
    joined = fields.join(counts, "field_id", "left").na.fill(0, ["grounded", "partial", "not_found", "unreachable", "_n"]).join(
        judgements.select("field_id", "agree", "interpretation_required"), "field_id", "left")
    agree = F.coalesce("agree", F.lit(False))
    interpret = F.coalesce("interpretation_required", F.lit(True))
    blocked = (F.col("not_found") > 0) | (F.col("grounded") == 0)
    reason = (
        F.when(F.col("not_found") > 0, "citation_integrity")
        .when((F.col("grounded") == 0) & (F.col("unreachable") == F.col("_n")), "all_unreachable")
        .when(F.col("grounded") == 0, "none_grounded")
        .when(~agree, "disagree").when(interpret, "interpretation").when(F.col("partial") > 0, "partial").otherwise("ok"))
    gate = (
        F.when(blocked, "BLOCKED").when(F.col("_reason") == "ok", "AUTO-LIVE").otherwise("CONSERVATIVE-HOLD"))
    strict = F.coalesce(F.col("fallback"), F.concat(F.lit("STRICTEST reading of: "), F.col("value")))
    relied = (
        F.when(blocked, F.lit(None).cast("string")).when(F.col("_reason").isin("disagree", "interpretation"), strict)
        .otherwise(F.col("value")))
    return joined.withColumn("_reason", reason).select(
        "field_id", "grounded", "partial", "not_found", "unreachable", gate.alias("gate"), F.col("_reason").alias("reason"),
        (~blocked).alias("judged"), relied.alias("relied_value"))


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("gate") == "AUTO-LIVE").alias("auto_live"),
        F.count_if(F.col("gate") == "CONSERVATIVE-HOLD").alias("held"), F.count_if(F.col("gate") == "BLOCKED").alias("blocked"),
        F.count_if(~F.col("judged")).alias("short_circuited"))
