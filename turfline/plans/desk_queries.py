"""Queries: routing and cost, campaign desk, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions import dates
from turfline.operators import artifacts, campaign_desk, opportunities, routing, yields
from turfline.operators.ordering import in_group_order
from turfline.plans import oracle_parts as O
from turfline.plans.field_queries import MANIFEST, ZIPC, _tiles
from turfline.plans.registry import query
from turfline.session import stage
from turfline.sources import field_tables as ft

D = "::DOUBLE"


# --- drives ---------------------------------------------------------------------------
def _drives(spark, d):
    """One drive per customer: need from the account, progress from the segment."""
    k = F.col("c_custkey")
    required = F.floor(F.abs("c_acctbal")) + 500
    target = F.floor(required * 3 / 2)
    share = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(100)).otherwise(k % 97)
    return ft.read(spark, d, "customer").select(
        F.concat(F.lit("st"), k).alias("state"), required.cast("long").alias("required"), target.cast("long").alias("target"),
        F.floor(target * share / 100).cast("long").alias("collected"), (k % 60).alias("days_left"),
        F.concat(F.lit("pool"), F.col("c_nationkey")).alias("pool"),
        F.when(k % 9 == 0, "no").otherwise("yes").alias("per_signature"), (k % 4 == 0).alias("residency"))


DRIVES = """drives0 AS (SELECT c_custkey AS k, 'st' || c_custkey AS state, CAST(floor(abs(c_acctbal)) AS BIGINT) + 500 AS required, c_mktsegment, c_nationkey FROM customer),
drives1 AS (SELECT *, required * 3 // 2 AS target FROM drives0),
drives AS (SELECT state, required, target, target * (CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE k % 97 END) // 100 AS collected, k % 60 AS days_left, 'pool' || c_nationkey AS pool, CASE WHEN k % 9 = 0 THEN 'no' ELSE 'yes' END AS per_signature, k % 4 = 0 AS residency FROM drives1),
priced AS (SELECT *, greatest(0, target - collected) AS deficit, greatest(0, target - collected) / CAST(greatest(days_left, 1) AS DOUBLE) AS need_per_day FROM drives)"""
TIER = "CASE WHEN need_per_day = 0 THEN 'done' WHEN need_per_day > 600 THEN 'critical' WHEN need_per_day > 150 THEN 'behind' ELSE 'on track' END AS tier"


@query("shadow_prices", f"WITH {DRIVES} SELECT state, deficit, round(need_per_day, 6) AS need_per_day, {TIER} FROM priced")
def shadow_prices(spark, d):
    return routing.shadow_prices(_drives(spark, d)).select("state", "deficit", F.round("need_per_day", 6).alias("need_per_day"), "tier")


@query("value_board", f"WITH {DRIVES} SELECT state, required, collected, days_left, round(need_per_day, 6) AS need_per_day, {TIER} FROM priced WHERE deficit > 0 ORDER BY priced.need_per_day DESC, state LIMIT 12")
def value_board(spark, d):
    return routing.value_board(_drives(spark, d)).select(
        "state", "required", "collected", "days_left", F.round("need_per_day", 6).alias("need_per_day"), "tier")


@query("drive_board", f"WITH {DRIVES}, b AS (SELECT *, collected >= required AS qualified FROM priced) SELECT state, qualified, row_number() OVER (ORDER BY qualified, need_per_day DESC, state) AS position, least(100, CAST(floor(100{D} * collected / required + 0.5{D}) AS BIGINT)) AS fill_pct FROM b")
def drive_board(spark, d):
    return routing.drive_board(_drives(spark, d)).select("state", "qualified", "position", "fill_pct")


_OPPS = " UNION ALL ".join(f"SELECT '{n}' AS spot, {raw}{D} AS raw, {v}{D} AS validity" for n, raw, v in fixed.OPPORTUNITIES)


@query("next_best", f"""WITH {DRIVES}, opps AS ({_OPPS}), hot AS (SELECT state AS hottest, need_per_day AS top FROM priced WHERE deficit > 0 ORDER BY need_per_day DESC, state DESC LIMIT 1),
scored AS (SELECT state, spot, raw, need_per_day, least(deficit{D}, raw * least(0.98{D}, validity + 0.12{D}) * 3{D}) AS expected_valid FROM priced CROSS JOIN opps),
best AS (SELECT *, expected_valid * need_per_day AS value, row_number() OVER (PARTITION BY state ORDER BY expected_valid * need_per_day DESC, raw DESC) AS rn FROM scored)
SELECT state, spot, round(expected_valid, 6) AS expected_valid, round(value, 4) AS value, CASE WHEN need_per_day < top * 0.5 THEN hottest END AS nudge_to FROM best CROSS JOIN hot WHERE rn = 1""")
def next_best(spark, d):
    out = routing.next_best(_drives(spark, d), 3.0)
    return out.withColumn("expected_valid", F.round("expected_valid", 6)).withColumn("value", F.round("value", 4))


@query("allocate_hours", f"""WITH {DRIVES}, caps AS (SELECT *, need_per_day / 9{D} AS cap FROM priced),
run AS (SELECT *, row_number() OVER w AS position, coalesce(sum(cap) OVER (PARTITION BY pool ORDER BY need_per_day DESC, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM caps WINDOW w AS (PARTITION BY pool ORDER BY need_per_day DESC, state))
SELECT pool, state, position, round(least(cap, greatest(0, 100{D} - before)) + CASE WHEN position = 1 THEN greatest(0, 100{D} - sum(cap) OVER (PARTITION BY pool)) ELSE 0 END, 6) AS hours FROM run""")
def allocate_hours(spark, d):
    claims = routing.on_pace_hours(routing.shadow_prices(_drives(spark, d)))
    given = routing.allocate_hours(claims, F.lit(100.0), ["pool"], [F.desc("need_per_day"), F.col("state")])
    return given.select("pool", "state", "position", F.round("hours", 6).alias("hours"))


@query("paid_gap", f"WITH {DRIVES} SELECT count(*) FILTER (deficit > 0) AS short_states, round(sum(deficit / 1.5{D}), 4) AS paid_signatures, round(sum(deficit / 1.5{D} * 7), 4) AS paid FROM priced")
def paid_gap(spark, d):
    out = routing.paid_gap(_drives(spark, d))
    return out.withColumn("paid_signatures", F.round("paid_signatures", 4)).withColumn("paid", F.round("paid", 4))


@query("paid_gap_rounded", f"WITH {DRIVES} SELECT state, deficit AS paid_valid, CAST(ceil(deficit * 1.5{D}) AS BIGINT) AS paid_signatures, ceil(deficit * 1.5{D}) * 7 AS paid FROM priced")
def paid_gap_rounded(spark, d):
    return routing.paid_gap_rounded(_drives(spark, d)).select("state", "paid_valid", "paid_signatures", "paid")


PLACES = f"""volunteers AS (SELECT c_custkey AS volunteer_id, 30 + (c_custkey * 7919 % 1500) / 100.0{D} AS lat, -120 + (c_custkey * 104729 % 5000) / 100.0{D} AS lng, 1 + c_custkey % 8 AS hours, c_custkey % 3 > 0 AS trained,
 ['J' || c_custkey % 5, 'J' || (c_custkey + 2) % 5] AS jurisdictions FROM customer),
opportunities AS (SELECT p_partkey AS opportunity_id, 'J' || p_partkey % 5 AS jurisdiction, 30 + (p_partkey * 3571 % 1500) / 100.0{D} AS lat, -120 + (p_partkey * 50021 % 5000) / 100.0{D} AS lng, 2 + p_partkey % 9 AS valid_per_hour,
 p_partkey % 30 AS need_per_day, p_partkey % 4 AS setup_cost, p_partkey % 7 AS risk, p_partkey % 11 AS capacity, p_partkey % 6 = 0 AS needs_training FROM part)"""
_KM = "2 * {0}::DOUBLE * asin(sqrt(pow(sin(radians(o.lat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lng - v.lng) / 2), 2)))".format(campaign_desk.EARTH_KM)


@query("opportunity_topk", f"""WITH {PLACES}, met AS (SELECT volunteer_id, opportunity_id, {_KM} AS km, valid_per_hour * hours AS expected_valid, need_per_day, setup_cost, risk FROM volunteers v JOIN opportunities o
 ON list_contains(jurisdictions, jurisdiction) AND capacity > 0 AND need_per_day > 0 AND (trained OR NOT needs_training)),
scored AS (SELECT *, expected_valid * need_per_day - 0.1{D} * km - setup_cost - risk AS score FROM met WHERE km <= 150)
SELECT volunteer_id, rank::INT AS rank, opportunity_id, round(km, 4) AS km, expected_valid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY volunteer_id ORDER BY score DESC, opportunity_id) AS rank FROM scored) WHERE rank <= 5""")
def opportunity_topk(spark, d):
    """Customers as volunteers, parts as opportunities, each at a place of its own."""
    c, p = F.col("c_custkey"), F.col("p_partkey")
    in_ = lambda k: F.concat(F.lit("J"), k % 5)
    volunteers = ft.read(spark, d, "customer").select(
        c.alias("volunteer_id"), (30 + c * 7919 % 1500 / F.lit(100.0)).alias("lat"), (-120 + c * 104729 % 5000 / F.lit(100.0)).alias("lng"),
        (1 + c % 8).alias("hours"), (c % 3 > 0).alias("trained"), F.array(in_(c), in_(c + 2)).alias("jurisdictions"))
    places = ft.read(spark, d, "part").select(
        p.alias("opportunity_id"), in_(p).alias("jurisdiction"), (30 + p * 3571 % 1500 / F.lit(100.0)).alias("lat"), (-120 + p * 50021 % 5000 / F.lit(100.0)).alias("lng"),
        (2 + p % 9).alias("valid_per_hour"), (p % 30).alias("need_per_day"), (p % 4).alias("setup_cost"), (p % 7).alias("risk"), (p % 11).alias("capacity"), (p % 6 == 0).alias("needs_training"))
    best = opportunities.best_opportunities(volunteers, places, 5, 150.0, 0.1)
    return best.select("volunteer_id", "rank", "opportunity_id", F.round("km", 4).alias("km"), "expected_valid", F.round("score", 4).alias("score"))


@query("drive_totals", f"WITH {DRIVES} SELECT count(*) AS states, CAST(sum(required) AS BIGINT) AS required, CAST(sum(collected) AS BIGINT) AS collected, CAST(sum(target) AS BIGINT) AS target, count(*) FILTER (collected >= required) AS qualified, count(*) FILTER (per_signature <> 'no') AS per_signature_go, count(*) FILTER (per_signature = 'no') AS hourly_only, count(*) FILTER (residency) AS residency FROM drives")
def drive_totals(spark, d):
    return routing.drive_totals(_drives(spark, d))


@query("required_signatures", f"SELECT n_nationkey, coalesce((MAP {{{', '.join(f'{O.quoted(k)}: {v}' for k, v in fixed.REQUIRED_SIGNATURES.items())}}})[CASE WHEN n_nationkey % 5 = 0 THEN 'Guam' ELSE {O.pick(tuple(fixed.STATE_ABBREVIATIONS), 'n_nationkey * 2')} END], 5000) AS required FROM nation")
def required_signatures(spark, d):
    n = F.col("n_nationkey")
    name = F.when(n % 5 == 0, "Guam").otherwise(ft.pick(tuple(fixed.STATE_ABBREVIATIONS), n * 2))
    return ft.read(spark, d, "nation").select("n_nationkey", routing.required_signatures(name).alias("required"))


COSTS = "costs AS (SELECT c_nationkey AS n, CAST(sum(floor(abs(c_acctbal))) AS BIGINT) AS required FROM customer GROUP BY 1)"


def _needs(spark, d):
    return ft.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(
        F.sum(F.floor(F.abs("c_acctbal"))).alias("required"))


@query("cost_concentration", f"WITH {COSTS} SELECT 'st' || n AS state, required, required * 7{D} AS cost, row_number() OVER (ORDER BY required DESC, 'st' || n) AS rank, round(sum(required * 7{D}) OVER (ORDER BY required DESC, 'st' || n ROWS UNBOUNDED PRECEDING) / sum(required * 7{D}) OVER (), 6) AS cumulative_share FROM costs")
def cost_concentration(spark, d):
    out = routing.cost_concentration(_needs(spark, d).select(F.concat(F.lit("st"), "n").alias("state"), "required"))
    return out.withColumn("cumulative_share", F.round("cumulative_share", 6))


_STACKS = " UNION ALL ".join(f"SELECT '{n}' AS stack, {v}{D} AS v, {g}{D} AS g, {a}{D} AS a, {b}{D} AS b" for n, v, g, a, b in fixed.LEVER_STACKS)


@query("cost_scenarios", f"WITH {COSTS}, stacks AS ({_STACKS}), prices AS (SELECT unnest([3{D}, 7{D}, 12{D}]) AS price) SELECT 'st' || n AS scope, stack, price, round(required * price * (1 - v - g) * a * b, 2) AS cost FROM costs CROSS JOIN stacks CROSS JOIN prices")
def cost_scenarios(spark, d):
    out = routing.cost_scenarios(_needs(spark, d).select(F.concat(F.lit("st"), "n").alias("scope"), "required"))
    return out.withColumn("cost", F.round("cost", 2))


@query("breakeven_volunteers", f"WITH {COSTS}, prices AS (SELECT unnest([3{D}, 7{D}, 12{D}]) AS price) SELECT 'st' || n AS scope, price, round(greatest(0{D}, 1{D} - 0.1{D} - 100000{D} / (required * price * 0.75{D} * 0.85{D})), 6) AS volunteer_share FROM costs CROSS JOIN prices")
def breakeven_volunteers(spark, d):
    out = routing.breakeven_volunteers(_needs(spark, d).select(F.concat(F.lit("st"), "n").alias("scope"), "required"), 100000.0)
    return out.withColumn("volunteer_share", F.round("volunteer_share", 6))


@query("expected_valid", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * (0.5{D} + l_discount) * (1 - l_tax) * 0.6{D} * l_linenumber * 0.72{D}, 6) AS expected_valid FROM lineitem")
def expected_valid(spark, d):
    visits = ft.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("footfall"), (F.lit(0.5) + F.col("l_discount")).alias("approach_rate"),
        (F.lit(1) - F.col("l_tax")).alias("consent_rate"), F.lit(0.6).alias("eligible_share"), F.col("l_linenumber").alias("hours"), F.lit(0.72).alias("validity"))
    return routing.expected_valid(visits).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("expected_valid", 6).alias("expected_valid"))


@query("turf_rank", MANIFEST + ", " + ZIPC.split("WITH ", 1)[1].split(", zc AS", 1)[0] + ", zc2 AS" + ZIPC.split(", zc AS", 1)[1] + """, m AS (SELECT 'cmp-click' AS campaign_id, tile, voter_count, zip FROM manifest UNION ALL SELECT 'cmp-none', tile, voter_count, zip FROM manifest),
s AS (SELECT m.campaign_id, tile, m.zip, voter_count, coalesce((valid + 7) / CAST(total + 10 AS DOUBLE), 0.7::DOUBLE) AS ev FROM m LEFT JOIN zc2 ON zc2.campaign_id = m.campaign_id AND zc2.zip = m.zip),
k AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY voter_count * ev DESC, tile) AS rank FROM s)
SELECT 'opt-' || tile AS id, campaign_id, rank, tile, zip, voter_count, round(ev, 6) AS expected_valid, 'Precinct ' || p AS label, 'Prec ' || p AS area_short,
 '~' || format('{:,}', voter_count) || ' active registrations · ' || CAST(floor(ev * 100 + 0.5::DOUBLE) AS BIGINT) || '% expected valid' || CASE WHEN rank = 1 THEN ' — your best turf right now.' ELSE '.' END AS directive
FROM (SELECT *, array_to_string(string_split(tile, '__')[2:], '-') || ' · ' || zip AS p FROM k) WHERE rank <= 12""")
def turf_rank(spark, d):
    manifest = artifacts.tile_manifest(_tiles(spark, d)).drop("version").withColumn(
        "campaign_id", F.explode(F.array(F.lit("cmp-click"), F.lit("cmp-none"))))
    rates = yields.zip_counts(ft.captures(spark, d)).select(
        "campaign_id", "zip", yields.smoothed(F.col("valid"), F.col("total")).alias("rate"))
    return routing.turf_rank(manifest, rates).withColumn("expected_valid", F.round("expected_valid", 6))


ASSIGNED = """WITH RECURSIVE pool AS (SELECT strftime(l_shipdate, '%Y-%m') AS drive_day, s_name AS gatherer, n_name AS state,
 avg(l_quantity) AS raw, avg(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END::DOUBLE) AS rate FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
ranked AS (SELECT drive_day, state, pace, row_number() OVER (PARTITION BY drive_day ORDER BY pace DESC, state) AS k FROM (SELECT drive_day, state, sum(raw) * 2 AS pace FROM pool GROUP BY 1, 2)),
people AS (SELECT DISTINCT drive_day, gatherer FROM pool),
offers AS (SELECT r.drive_day, r.k, r.pace, p.gatherer, coalesce(o.raw * o.rate, 0) AS worth
 FROM ranked r JOIN people p ON p.drive_day = r.drive_day LEFT JOIN pool o ON o.drive_day = r.drive_day AND o.gatherer = p.gatherer AND o.state = r.state),
run AS (SELECT drive_day, 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS picked FROM ranked WHERE k = 1
 UNION ALL SELECT drive_day, k, list_concat(any_value(used), list(gatherer) FILTER (met < pace)), list(gatherer) FILTER (met < pace)
 FROM (SELECT o.drive_day, o.k, r.used, o.gatherer, o.pace, 8 * coalesce(sum(o.worth) OVER (PARTITION BY o.drive_day ORDER BY o.worth DESC, o.gatherer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met
  FROM run r JOIN offers o ON o.drive_day = r.drive_day AND o.k = r.k + 1 WHERE NOT list_contains(r.used, o.gatherer)) GROUP BY drive_day, k),
placed AS (SELECT drive_day, k, unnest(picked) AS gatherer FROM run)
SELECT p.drive_day, p.gatherer, r.state FROM people p LEFT JOIN placed q ON q.drive_day = p.drive_day AND q.gatherer = p.gatherer JOIN ranked r ON r.drive_day = p.drive_day AND r.k = coalesce(q.k, 1)"""


@query("day_assignment", ASSIGNED)
def day_assignment(spark, d):
    """Suppliers as gatherers, the customers' nations as states, one drive-day per month of orders."""
    t = lambda name: ft.read(spark, d, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag").join(
        t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(
        t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    pairs = lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("drive_day"), "l_suppkey", "n_nationkey").agg(
        F.avg("l_quantity").alias("raw"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("rate"))
    named = pairs.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("gatherer")), "l_suppkey").join(
        t("nation").select("n_nationkey", F.col("n_name").alias("state")), "n_nationkey")
    pool = stage(named.select("drive_day", "gatherer", "state", "raw", "rate"), "pool")
    states = pool.groupBy("drive_day", "state").agg((F.sum("raw") * 2).alias("pace"))
    return routing.assign_day(pool, states)


# --- desk ------------------------------------------------------------------------------
POLICIES = """sources AS (SELECT s_suppkey AS source_id, (['approved', 'draft', 'approved', 'pending_review', 'deprecated'])[s_nationkey % 5 + 1] AS status, s_suppkey % 4 <> 0 AS allowed_for_ai FROM supplier),
policies AS (SELECT p_partkey AS policy_id, 'cmp-' || (p_size % 10) AS campaign_id, (['draft', 'published', 'archived'])[p_partkey % 3 + 1] AS status, p_name || ' ' || p_type || ' housing reform' AS evidence, [(p_partkey * 7) % (SELECT count(*) FROM supplier), (p_partkey * 11 + 3) % (SELECT count(*) FROM supplier)] AS citations FROM part)"""


def _sources(spark, d):
    s = ft.read(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("source_id"), ft.pick(("approved", "draft", "approved", "pending_review", "deprecated"), F.col("s_nationkey") % 5).alias("status"),
        (F.col("s_suppkey") % 4 != 0).alias("allowed_for_ai"))


def _policies(spark, d):
    n = ft.read(spark, d, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    p = F.col("p_partkey")
    return ft.read(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_type").crossJoin(n).select(
        p.alias("policy_id"), F.concat(F.lit("cmp-"), F.col("p_size") % 10).alias("campaign_id"), ft.pick(("draft", "published", "archived"), p % 3).alias("status"),
        F.concat_ws(" ", "p_name", "p_type", F.lit("housing reform")).alias("evidence"),
        F.array(p * 7 % F.col("_n"), (p * 11 + 3) % F.col("_n")).alias("citations"))


@query("approved_sources", f"WITH {POLICIES} SELECT source_id FROM sources WHERE status = 'approved' AND allowed_for_ai")
def approved_sources(spark, d):
    return campaign_desk.approved_sources(_sources(spark, d)).select("source_id")


SUPPORT = ", cited AS (SELECT policy_id, unnest(citations) AS source_id FROM policies), support AS (SELECT policy_id, count(*) AS citations, count(*) FILTER (status = 'approved' AND allowed_for_ai) AS approved FROM cited LEFT JOIN sources USING (source_id) GROUP BY 1)"


@query("policy_support", f"WITH {POLICIES}{SUPPORT} SELECT policy_id, citations, approved, citations = approved AS fully_supported FROM support")
def policy_support(spark, d):
    return campaign_desk.policy_support(_policies(spark, d), _sources(spark, d))


_WORDS = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(O.quoted(w) for w in fixed.STOPWORDS)}))"
ASKED = ", asked AS (SELECT o_orderkey AS question_id, (o_orderkey * 3) % (SELECT count(*) + 20 FROM part) AS policy_id, (['What about housing?', 'Is the red widget allowed', 'When does this policy start', 'small steel gear question', 'economy of scale'])[o_orderkey % 5 + 1] AS question FROM orders), gate AS (SELECT question_id, a.policy_id, p.policy_id IS NOT NULL AS has_policy, coalesce(list_has_any(" + _WORDS("question") + ", " + _WORDS("evidence") + "), false) AS overlap FROM asked a LEFT JOIN policies p ON p.policy_id = a.policy_id)"


def _questions(spark, d):
    n = ft.read(spark, d, "part").agg((F.count(F.lit(1)) + 20).alias("_n"))
    o = F.col("o_orderkey")
    text = ("What about housing?", "Is the red widget allowed", "When does this policy start", "small steel gear question", "economy of scale")
    return ft.read(spark, d, "orders").select("o_orderkey").crossJoin(n).select(
        o.alias("question_id"), (o * 3 % F.col("_n")).alias("policy_id"), ft.pick(text, o % 5).alias("question"))


@query("keyword_gate", f"WITH {POLICIES}{ASKED} SELECT * FROM gate")
def keyword_gate(spark, d):
    return campaign_desk.keyword_gate(_questions(spark, d), _policies(spark, d))


@query("answerable", f"WITH {POLICIES}{SUPPORT}{ASKED} SELECT question_id, policy_id, CASE WHEN NOT has_policy THEN 'no_policy' WHEN coalesce(approved, 0) = 0 THEN 'no_approved_source' WHEN NOT overlap THEN 'no_overlap' ELSE 'answer' END AS decision FROM gate LEFT JOIN support USING (policy_id)")
def answerable(spark, d):
    policies = _policies(spark, d)
    return campaign_desk.answerable(_questions(spark, d), policies, campaign_desk.policy_support(policies, _sources(spark, d)))


@query("campaign_scope", f"WITH {POLICIES} SELECT policy_id, campaign_id FROM policies WHERE campaign_id = 'cmp-3' AND status = 'published'")
def campaign_scope(spark, d):
    return campaign_desk.for_campaign(_policies(spark, d), "cmp-3").where("status = 'published'").select("policy_id", "campaign_id")


@query("person_360", """WITH i AS (SELECT conv_id, count(*) AS interactions, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS inbound FROM conversations GROUP BY 1),
c AS (SELECT doc_id, count(*) FILTER (quality = 1) AS granted, count(*) FILTER (quality = 0) AS withdrawn FROM labels GROUP BY 1)
SELECT c_custkey AS person_id, coalesce(interactions, 0) AS interactions, last_turn, coalesce(inbound, 0) AS inbound, coalesce(granted, 0) AS granted, coalesce(withdrawn, 0) AS withdrawn FROM customer LEFT JOIN i ON conv_id = c_custkey LEFT JOIN c ON doc_id = c_custkey""")
def person_360(spark, d):
    return campaign_desk.person_360(*_person_tables(spark, d))


def _person_tables(spark, d):
    people = ft.read(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    talk = ft.read(spark, d, "conversations").select(F.col("conv_id").alias("person_id"), "turn", F.col("role").alias("kind"))
    consent = ft.read(spark, d, "labels").select(
        F.col("doc_id").alias("person_id"), F.when(F.col("quality") == 1, "granted").otherwise("withdrawn").alias("status"))
    return people, talk, consent


@query("person_details", """SELECT c_custkey AS person_id, 'person' AS section, NULL::BIGINT AS turn, NULL AS kind, NULL AS status FROM customer
 UNION ALL SELECT conv_id, 'interaction', turn, role, NULL FROM conversations WHERE conv_id IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT doc_id, 'consent', NULL, NULL, CASE WHEN quality = 1 THEN 'granted' ELSE 'withdrawn' END FROM labels WHERE doc_id IN (SELECT c_custkey FROM customer)""")
def person_details(spark, d):
    return campaign_desk.person_details(*_person_tables(spark, d))


@query("campaign_overview", "SELECT campaign_id, count(*) FILTER (kind = 'events') AS events, count(*) FILTER (kind = 'missions') AS missions, count(*) FILTER (kind = 'training') AS training FROM (SELECT o_custkey % 50 AS campaign_id, 'events' AS kind FROM orders UNION ALL SELECT p_size % 50, 'missions' FROM part UNION ALL SELECT s_suppkey % 50, 'training' FROM supplier) GROUP BY 1")
def campaign_overview(spark, d):
    ids = lambda t, c: ft.read(spark, d, t).select((F.col(c) % 50).cast("long").alias("campaign_id"))
    return campaign_desk.campaign_overview(ids("orders", "o_custkey"), ids("part", "p_size"), ids("supplier", "s_suppkey"))


@query("event_fill", f"SELECT o_orderkey, CAST(floor((o_custkey % 90) / CAST(o_orderkey % 50 + 10 AS DOUBLE) * 100 + 0.5{D}) AS BIGINT) AS fill_pct, least(100, CAST(floor((o_custkey % 90) / CAST(o_orderkey % 50 + 10 AS DOUBLE) * 100 + 0.5{D}) AS BIGINT)) AS bar_pct FROM orders")
def event_fill(spark, d):
    events = ft.read(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 90).alias("rsvps"), (F.col("o_orderkey") % 50 + 10).alias("capacity"))
    return campaign_desk.event_fill(events).select("o_orderkey", "fill_pct", "bar_pct")


ROLES = tuple(fixed.ROLE_PERMISSIONS)
GRANTS = tuple(sorted({p for grants in fixed.ROLE_PERMISSIONS.values() for p in grants}))


@query("permission_check", f"SELECT event_id, role, permission, list_contains((MAP {{{', '.join(f'{O.quoted(r)}: {O.sql_list(g)}' for r, g in fixed.ROLE_PERMISSIONS.items() if g)}, 'volunteer': ['-']}})[role], permission) AS allowed FROM (SELECT event_id, {O.pick(ROLES, f'event_id % {len(ROLES)}')} AS role, {O.pick(GRANTS, f'user_id % {len(GRANTS)}')} AS permission FROM events)")
def permission_check(spark, d):
    asked = ft.read(spark, d, "events").select(
        "event_id", ft.pick(ROLES, F.col("event_id") % len(ROLES)).alias("role"), ft.pick(GRANTS, F.col("user_id") % len(GRANTS)).alias("permission"))
    return campaign_desk.permission_check(asked)


# --- places -----------------------------------------------------------------------------
PLACES = f"""places AS (SELECT o_custkey AS query_id, o_orderkey AS rank, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 3 + 1 AS VARCHAR) END AS housenumber, {O.street_line('o_custkey')} AS street,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Springfield' END AS city, CASE WHEN o_orderkey % 4 = 1 THEN 'Shelby' END AS town, NULL AS village, 'Sangamon' AS county,
 CASE WHEN o_orderkey % 5 = 0 THEN 'IL' ELSE {O.pick(tuple(fixed.STATE_ABBREVIATIONS), 'o_custkey % 51')} END AS state, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {O.zip5('o_custkey')} END AS postcode,
 CASE WHEN o_orderkey % 11 = 0 THEN 'CA' WHEN o_orderkey % 2 = 0 THEN 'US' END AS countrycode FROM orders),
lines AS (SELECT query_id, rank, trim(replace(trim(regexp_replace(housenumber || ' ' || street || ', ' || coalesce(city, town, village, county, '') || ' ' || coalesce(({O.sql_map(fixed.STATE_ABBREVIATIONS)})[state], state, '') || ' ' || postcode, '\\s+', ' ', 'g')), ' ,', ',')) AS line, coalesce(countrycode, 'US') = 'US' AND housenumber IS NOT NULL AS usable FROM places)"""


def _places(spark, d):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    return ft.read(spark, d, "orders").select(
        k.alias("query_id"), o.alias("rank"), F.when(o % 7 != 0, (k % 3 + 1).cast("string")).alias("housenumber"), ft.street_line(k).alias("street"),
        F.when(o % 2 == 0, "Springfield").alias("city"), F.when(o % 4 == 1, "Shelby").alias("town"), none.alias("village"), F.lit("Sangamon").alias("county"),
        F.when(o % 5 == 0, "IL").otherwise(ft.pick(tuple(fixed.STATE_ABBREVIATIONS), k % 51)).alias("state"),
        F.when(o % 3 == 0, "").otherwise(ft.zip5(k)).alias("postcode"), F.when(o % 11 == 0, "CA").when(o % 2 == 0, "US").alias("countrycode"))


@query("place_line", f"WITH {PLACES} SELECT rank, coalesce(line, '') AS line FROM lines")
def place_line(spark, d):
    return _places(spark, d).select("rank", campaign_desk.place_line().alias("line"))


@query("place_usable", f"WITH {PLACES}, firsts AS (SELECT query_id, line, min(rank) AS r FROM lines WHERE usable GROUP BY ALL) SELECT query_id, line, rank FROM (SELECT query_id, line, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM firsts) WHERE rank <= 5")
def place_usable(spark, d):
    return campaign_desk.place_usable(_places(spark, d))


_CENTERS = " UNION ALL ".join(f"SELECT '{n}' AS center, {la}{D} AS cla, {lo}{D} AS clo" for n, la, lo in fixed.ACTIVITY_CENTERS)


@query("nearest_center", f"""WITH centers AS ({_CENTERS}), spots AS (SELECT event_id, 25 + (event_id % 240) / 10.0{D} AS lat, -125 + (user_id * 7 % 500) / 10.0{D} AS lng FROM events),
dist AS (SELECT event_id, center, 12742{D} * asin(sqrt(pow(sin(radians(cla - lat) / 2), 2) + cos(radians(lat)) * cos(radians(cla)) * pow(sin(radians(clo - lng) / 2), 2))) AS km FROM spots CROSS JOIN centers),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, center) AS rn FROM dist) WHERE rn = 1)
SELECT event_id, center, round(km, 4) AS km, CASE WHEN km <= 8 THEN 9 WHEN km <= 35 THEN 5 WHEN km <= 120 THEN 3 ELSE 2 END AS density FROM best""")
def nearest_center(spark, d):
    spots = ft.read(spark, d, "events").select(
        "event_id", (F.lit(25) + F.col("event_id") % 240 / 10.0).alias("lat"), (F.lit(-125) + F.col("user_id") * 7 % 500 / 10.0).alias("lng"))
    return campaign_desk.nearest_center(spots).select("event_id", "center", F.round("km", 4).alias("km"), "density")


@query("days_to_filing", "SELECT o_orderkey, greatest(0, date_diff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE))) AS days FROM orders")
def days_to_filing(spark, d):
    return ft.read(spark, d, "orders").select("o_orderkey", dates.days_to_filing(F.col("o_orderdate").cast("date"), F.lit("1996-06-01").cast("date")).alias("days"))


@query("ordered_positions", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS position FROM lineitem")
def ordered_positions(spark, d):
    """Numbering inside three huge groups without a huge window."""
    rows = ft.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    out = in_group_order(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "position")
