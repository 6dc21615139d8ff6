"""Queries: standardization, linkage, validity, batch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.functions import people as P
from turfline.functions import text as X
from turfline.operators import linkage, validity
from turfline.operators.suggest import suggest_voters
from turfline.plans import oracle_parts as O
from turfline.plans.registry import query
from turfline.sources import field_tables as ft

CONTEXT = validity.StateContext("Ohio")
DISTRICT = validity.StateContext("Ohio", required_district="CD-1")
FAN_OUT = validity.StateContext("New Jersey", loaded_counties=("NATION_1", "NATION_2", "NATION_3"))
RESIDENCY = validity.StateContext("North Dakota")
STD_S = f"WITH {O.signers()}, {O.std('signers', 's')} "
STD_R = f"WITH {O.roll()}, {O.std('roll', 'r')} "
PAIR = f"WITH {O.roll()}, {O.signers()}, {O.std('roll', 'r')}, {O.std('signers', 's')}, "
BATCH = f"WITH {O.flagship()} "


@query("std_text", f"SELECT doc_id, {O.basic('text')} AS folded FROM documents")
def std_text(spark, d):
    return ft.read(spark, d, "documents").select("doc_id", X.basic("text").alias("folded"))


@query("std_name", STD_S + "SELECT id, first, middle, last, concat_ws(' ', nullif(first, ''), nullif(middle, ''), nullif(last, '')) AS full_name FROM s")
def std_name(spark, d):
    return P.with_name_parts(ft.signers(spark, d)).select("id", "first", "middle", "last", F.col("full").alias("full_name"))


@query("std_address", STD_S + "SELECT id, number, street, unit, zip5 FROM s")
def std_address(spark, d):
    return P.with_address_parts(ft.signers(spark, d)).select("id", "number", "street", "unit", "zip5")


@query("std_address_line", STD_R + "SELECT id, upper(concat_ws(' ', nullif(number, ''), nullif(street, ''), CASE WHEN unit <> '' THEN '# ' || unit END, nullif(zip5, ''))) AS line FROM r")
def std_address_line(spark, d):
    return P.with_address_parts(ft.roll(spark, d)).select("id", P.address_line().alias("line"))


@query("zip_variants", f"""WITH {O.signers()} SELECT id,
 regexp_extract(address, '\\b([0-9]{{5}})(?:-[0-9]{{4}})?\\b', 1) AS zip_anywhere, regexp_extract(address, '\\b([0-9]{{5}})\\b', 1) AS zip_bare,
 regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1) AS zip_trailing, regexp_extract(address, '([0-9]{{5}})(?:-[0-9]{{4}})?\\s*$', 1) AS zip_plus4,
 regexp_extract(address, '([0-9]{{5}})\\s*$', 1) AS zip_loose, substr(regexp_replace(address, '[^0-9]', '', 'g'), 1, 5) AS zip_digits FROM signers""")
def zip_variants(spark, d):
    return ft.signers(spark, d).select(
        "id", X.zip_anywhere("address").alias("zip_anywhere"), X.zip_bare("address").alias("zip_bare"),
        X.zip_trailing("address").alias("zip_trailing"), X.zip_trailing_plus4("address").alias("zip_plus4"),
        X.zip_trailing_loose("address").alias("zip_loose"), X.zip_digits("address").alias("zip_digits"))


@query("search_tokens", STD_R + "SELECT id, array_to_string(list_filter(list_concat([first, middle, last], string_split(street, ' '), [zip5]), lambda w: w <> ''), ' ') AS tokens, number AS house FROM r")
def search_tokens(spark, d):
    return P.standardize(ft.roll(spark, d)).select(
        "id", F.array_join(P.search_tokens(), " ").alias("tokens"), F.col("number").alias("house"))


@query("member_key", STD_R + "SELECT id, first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5 AS member_key FROM r")
def member_key(spark, d):
    return P.standardize(ft.roll(spark, d)).select("id", P.member_key().alias("member_key"))


@query("link_candidates", PAIR + """sizes AS (SELECT block, count(DISTINCT id) AS n FROM r GROUP BY block)
SELECT s.id AS signer_id, s.block, coalesce(n, 0) AS candidates_considered FROM s LEFT JOIN sizes USING (block)""")
def link_candidates(spark, d):
    return linkage.candidate_counts(P.standardize(ft.signers(spark, d)), P.standardize(ft.roll(spark, d)))


MET = PAIR + O.pair_scores() + f""", classes AS (
 SELECT 'same_number' AS met, * FROM scored WHERE pl <> '' AND vl <> '' AND pn <> '' AND pn = vn
 UNION ALL SELECT 'same_zip', * FROM scored WHERE pl <> '' AND vl <> '' AND pz <> '' AND pz = vz AND name_score >= {linkage._name_floor(0.0, 1.0)!r}
 UNION ALL SELECT 'any_zip', * FROM scored WHERE pl <> '' AND vl <> '' AND name_score >= {linkage._name_floor(0.0, 0.0)!r}
 UNION ALL SELECT 'missing', * FROM scored WHERE pl <> '' AND vl <> '' AND (pn = '' OR pz = '' OR vn = '' OR vz = '') AND name_score >= {linkage._name_floor(0.5, 1.0)!r}) """


def _sides(spark, d):
    return P.standardize(ft.signers(spark, d)), linkage.roll_people(P.standardize(ft.roll(spark, d)))


@query("pair_scores_names", MET + "SELECT DISTINCT met, block, pl, pf, vl, vf, round(name_score, 6) AS name_score FROM classes")
def pair_scores_names(spark, d):
    """Every name pair of the four classes of pairs that link() compares."""
    return linkage.met_names(*_sides(spark, d)).select(
        "met", F.col("a_block").alias("block"), F.col("a_last").alias("pl"), F.col("a_first").alias("pf"),
        F.col("b_last").alias("vl"), F.col("b_first").alias("vf"), F.round("name_score", 6).alias("name_score"))


@query("pair_scores_streets", MET + """SELECT DISTINCT met, ps, vs, round(CASE WHEN ps = '' OR vs = '' THEN CAST(0.5 AS DOUBLE) ELSE jw END, 6) AS street_score
 FROM (SELECT DISTINCT met, ps, vs FROM classes) LEFT JOIN jw ON a = ps AND b = vs""")
def pair_scores_streets(spark, d):
    """Every street pair of the four classes of pairs that link() compares."""
    return linkage.met_streets(*_sides(spark, d)).select(
        "met", F.col("a_street").alias("ps"), F.col("b_street").alias("vs"), F.round("street_score", 6).alias("street_score"))


@query("link_best", PAIR + O.matched() + """ SELECT id AS signer_id, band, round(score, 6) AS score, round(name_score, 6) AS name_score,
 round(addr_score, 6) AS addr_score, v_id AS best_voter_id, CAST(candidates_considered AS BIGINT) AS candidates_considered FROM matched""")
def link_best(spark, d):
    out = linkage.link(ft.signers(spark, d), ft.roll(spark, d), weak_scores=True)
    return out.select(
        F.col("id").alias("signer_id"), "band", F.round("score", 6).alias("score"), F.round("name_score", 6).alias("name_score"),
        F.round("addr_score", 6).alias("addr_score"), "best_voter_id", "candidates_considered")


_RULED = " SELECT id AS signer_id, verdict, reason, matched_voter_id FROM judged"


def _ruled(df):
    return df.select(F.col("id").alias("signer_id"), "verdict", "reason", "matched_voter_id")


@query("validate_rows", PAIR + O.matched() + ", " + O.judged() + _RULED)
def validate_rows(spark, d):
    return _ruled(validity.validate_rows(ft.signers(spark, d), ft.roll(spark, d), CONTEXT))


@query("validity_district", PAIR + O.matched() + ", " + O.judged(district="CD-1") + _RULED)
def validity_district(spark, d):
    return _ruled(validity.validate_rows(ft.signers(spark, d), ft.roll(spark, d), DISTRICT))


@query("validity_county_fan_out", PAIR + O.matched() + ", " + O.judged("county-fan-out", counties=FAN_OUT.loaded_counties) + _RULED)
def validity_county_fan_out(spark, d):
    return _ruled(validity.validate_rows(ft.signers(spark, d), ft.roll(spark, d), FAN_OUT))


@query("validity_residency", PAIR + O.matched() + ", " + O.judged("residency-only") + _RULED)
def validity_residency(spark, d):
    return _ruled(validity.validate_rows(ft.signers(spark, d), ft.roll(spark, d), RESIDENCY))


def _batch(spark, d):
    return validity.validate_batch(ft.signers(spark, d), ft.roll(spark, d), CONTEXT)


LEDGER = """SELECT id AS signer_id, verdict, band, CASE WHEN band = 'NO_MATCH' THEN NULL ELSE round(score, 6) END AS score,
 matched_voter_id, reason, is_duplicate, duplicate_of, CAST(candidates_considered AS BIGINT) AS candidates_considered FROM ledger"""


@query("validate_batch", BATCH + LEDGER)
def validate_batch(spark, d):
    return _batch(spark, d).select(
        F.col("id").alias("signer_id"), "verdict", "band",
        F.when(F.col("band") != "NO_MATCH", F.round("score", 6)).alias("score"),
        "matched_voter_id", "reason", "is_duplicate", "duplicate_of", "candidates_considered")


@query("batch_dedup", f"""WITH {O.captures()}, judged AS (SELECT seq AS row_pos, CAST(seq AS VARCHAR) AS id, matched_voter_id, verdict FROM captures), {O.ledger()}
SELECT row_pos, verdict, is_duplicate, duplicate_of FROM ledger""")
def batch_dedup(spark, d):
    claims = ft.captures(spark, d).select(
        F.col("seq").alias("row_pos"), F.col("seq").cast("string").alias("id"), "matched_voter_id", "verdict", F.lit("").alias("reason"))
    return validity.drop_batch_duplicates(claims).select("row_pos", "verdict", "is_duplicate", "duplicate_of")


COUNTS = """SELECT count(*) AS total, count(*) FILTER (verdict = 'VALID') AS valid, count(*) FILTER (verdict = 'INVALID') AS invalid,
 count(*) FILTER (verdict = 'NEEDS_REVIEW') AS review, count(*) FILTER (is_duplicate) AS duplicates,
 round(count(*) FILTER (verdict = 'VALID') / CAST(count(*) AS DOUBLE), 6) AS validity_rate FROM ledger"""


@query("verdict_counts", BATCH + COUNTS)
def verdict_counts(spark, d):
    return validity.verdict_counts(_batch(spark, d)).withColumn("validity_rate", F.round("validity_rate", 6))


SLICES = BATCH + """, long AS (
 SELECT 'gatherer' AS dim, gatherer AS key, verdict, row_pos FROM ledger UNION ALL SELECT 'capture', capture, verdict, row_pos FROM ledger
 UNION ALL SELECT 'location', regexp_extract(address, '\\b([0-9]{5})\\b', 1), verdict, row_pos FROM ledger),
slices AS (SELECT dim, key, count(*) AS total, count(*) FILTER (verdict = 'VALID') AS valid, min(row_pos) AS first_seen,
 round(count(*) FILTER (verdict = 'VALID') / CAST(count(*) AS DOUBLE), 6) AS rate FROM long WHERE coalesce(key, '') <> '' GROUP BY dim, key) """


@query("yield_slices", SLICES + "SELECT * FROM slices")
def yield_slices(spark, d):
    return validity.yield_slices(_batch(spark, d)).withColumn("rate", F.round("rate", 6))


@query("slice_order", SLICES + "SELECT dim, key, row_number() OVER (PARTITION BY dim ORDER BY total DESC, first_seen) AS position FROM slices")
def slice_order(spark, d):
    return validity.ordered_slices(validity.yield_slices(_batch(spark, d))).select("dim", "key", "position")


@query("projection", BATCH + f""", counts AS ({COUNTS})
SELECT CAST(2000 AS BIGINT) AS required_valid, CAST(1.25 AS DOUBLE) AS buffer, CAST(2500 AS BIGINT) AS target_raw, valid AS safe_to_submit,
 CAST(ceil(greatest(0, 2000 - valid) / CASE WHEN valid > 0 THEN valid / CAST(total AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END) AS BIGINT) AS more_raw_needed, valid >= 2000 AS on_track FROM counts""")
def projection(spark, d):
    return validity.projection(validity.verdict_counts(_batch(spark, d)), 2000)


@query("distribution_check", PAIR + O.matched() + ", " + O.judged() + ", " + O.ledger() + """,
per AS (SELECT v_district AS district, count(*) AS valid FROM ledger WHERE verdict = 'VALID' GROUP BY 1)
SELECT CAST(coalesce(sum(valid), 0) AS BIGINT) AS valid, count(*) AS districts, count(*) FILTER (valid >= 100) AS districts_passing,
 coalesce(bool_and(valid >= 100), false) AS every_district_passes, count(*) FILTER (valid >= 100) >= 3 AS distribution_met FROM per""")
def distribution_check(spark, d):
    return validity.distribution_check(_batch(spark, d).withColumn("district", F.col("voter.district")), 100, 3)


@query("session_stats", f"""WITH {O.captures()} SELECT count(*) AS total, count(*) FILTER (verdict = 'VALID') AS valid,
 count(*) FILTER (verdict = 'NEEDS_REVIEW') AS review, count(*) FILTER (verdict NOT IN ('VALID', 'NEEDS_REVIEW')) AS invalid,
 count(*) FILTER (seq % 4 = 0) AS pending, round(count(*) FILTER (verdict = 'VALID') / CAST(count(*) AS DOUBLE), 6) AS validity_rate FROM captures""")
def session_stats(spark, d):
    out = validity.session_stats(ft.captures(spark, d), F.col("seq") % 4 == 0)
    return out.withColumn("validity_rate", F.round("validity_rate", 6))


_CAPTURED = "signers AS (SELECT seq AS row_pos, CAST(seq AS VARCHAR) AS id, name, address, CAST(NULL AS VARCHAR) AS signed_on, CAST(NULL AS VARCHAR) AS county, CAST(NULL AS BOOLEAN) AS attested_resident, campaign_id, gatherer_id, seq, verdict AS client_verdict FROM captures)"


@query("reconcile", f"WITH {O.roll()}, {O.captures()}, {_CAPTURED}, {O.std('roll', 'r')}, {O.std('signers', 's')}, {O.matched()}, {O.judged()}, {O.ledger('campaign_id')} " +
       "SELECT campaign_id, gatherer_id, seq, client_verdict, verdict, matched_voter_id, is_duplicate, client_verdict <> verdict AS flipped FROM ledger")
def reconcile(spark, d):
    return validity.reconcile(ft.captures(spark, d, spread=True).withColumn("row_pos", F.col("seq")), ft.roll(spark, d), CONTEXT)


_ASK = f"lower(substr({O.first_name('s_suppkey')}, 1, 3)) || ' ' || ({O.last_name('s_suppkey')}) || ' ' || {O.house('s_suppkey')} || ' ' || lower(substr({O.street_line('s_suppkey')}, 1, 3))"


@query("suggest_topk", STD_R + f""", asked AS (SELECT s_suppkey AS query_id, {_ASK} AS query FROM supplier),
toks AS (SELECT query_id, unnest(list_filter(string_split({O.basic('query')}, ' '), lambda w: length(w) >= 2)) AS q, generate_subscripts(list_filter(string_split({O.basic('query')}, ' '), lambda w: length(w) >= 2), 1) AS at FROM asked),
corpus AS (SELECT row_pos, id, status, number, list_filter([first, middle, last], lambda w: w <> '') AS nm,
 list_filter(string_split(street, ' '), lambda w: w <> '' AND NOT list_contains({O.sql_list(sorted(set(P.fixed.STREET_WORDS)))}, w)) AS st FROM r),
pts AS (SELECT query_id, row_pos, id, status, regexp_full_match(q, '[0-9]+') AND number = q AS hit,
 CASE WHEN regexp_full_match(q, '[0-9]+') THEN 0 WHEN list_contains(nm, q) THEN 3 WHEN len(list_filter(nm, lambda w: starts_with(w, q))) > 0 THEN 2 ELSE 0 END AS np,
 CASE WHEN regexp_full_match(q, '[0-9]+') THEN 0 WHEN list_contains(st, q) THEN 3 WHEN len(list_filter(st, lambda w: starts_with(w, q))) > 0 THEN 2 ELSE 0 END AS sp FROM toks CROSS JOIN corpus),
tot AS (SELECT query_id, row_pos, id, status, sum(np) AS np, sum(sp) AS sp, bool_or(hit) AS hit FROM pts GROUP BY ALL),
ranked AS (SELECT query_id, id, CAST(np + sp + CASE WHEN hit THEN 4 ELSE 0 END + CASE WHEN status = 'active' THEN 0.5 ELSE 0 END AS DOUBLE) AS score, row_pos FROM tot WHERE np > 0 OR (hit AND sp > 0))
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_pos) AS rank FROM ranked) WHERE rank <= 6""")
def suggest_topk(spark, d):
    k = F.col("s_suppkey")
    asked = F.concat(
        F.lower(F.substring(ft.first_name(k), 1, 3)), F.lit(" "), ft.last_name(k), F.lit(" "), ft.house(k), F.lit(" "),
        F.lower(F.substring(ft.street_line(k), 1, 3)))
    queries = ft.read(spark, d, "supplier").select(k.alias("query_id"), asked.alias("query"))
    return suggest_voters(queries, ft.roll(spark, d))
