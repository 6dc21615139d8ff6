"""Queries: rule records, quality, freshness, grounding, the verification gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions import text as X
from turfline.functions.dates import days_to_deadline
from turfline.operators import expectations, grounding, rulebook
from turfline.plans import oracle_parts as O
from turfline.plans.registry import query
from turfline.session import dealt, scratch, stage
from turfline.sources import field_tables as ft
from turfline.sources import rule_records as RR
from turfline.sources.adapters import LAYOUTS

STATES = tuple(fixed.STATE_ABBREVIATIONS)
ABBRS = tuple(fixed.STATE_ABBREVIATIONS.values())
FIELDS = ("signaturesRequired", "deadline", "distributionRule", "witnessOrNotary")
RESIDENCY = ("not required", "none", "required", "in-state only", "n/a", "unknown")
HEADLINES = ("Due August 5, 2028 by noon", "by Sept. 12", "no date stated", "march 3", "primary election day: June 30")
D = "::DOUBLE"
TODAY = "2028-04-01"


# --- rule records over ``part`` -----------------------------------------------------------
def rules(spark, d):
    """One nested record per part; some break the schema on purpose."""
    p, size = F.col("p_partkey"), F.col("p_size")
    gate = lambda i: ft.pick(fixed.GATES, F.least((p + i * 7 + size) % 6, F.lit(5)) % 3 * F.when((p + i) % 4 == 0, 1).otherwise(0))
    rule = lambda i: F.struct(
        F.lit(FIELDS[i]).alias("field"), gate(i).alias("gate"), F.lit("as written").alias("value"),
        F.when(p % 50 == i, 1.5).otherwise((p % 11) / 10.0).alias("confidence"), (p % 2 == 0).alias("interpretationRequired"),
        F.lit(None).cast("string").alias("note"))
    listed = F.array(*[rule(i) for i in range(4)])
    citation = F.transform(F.sequence(F.lit(0), (p % 3).cast("int")), lambda i: F.struct(
        F.lit("deadline").alias("field"), F.concat(F.lit("http://law.example/"), p, F.lit("/"), i).alias("url"), F.lit("quote").alias("quote")))
    rows = dealt(ft.read(spark, d, "part").select("p_partkey", "p_size"))
    abbr = ft.pick(ABBRS, p % 51)
    text = lambda value: value.cast("string")
    return rows.select(
        F.lit(fixed.RULE_SCHEMA_VERSION).alias("schemaVersion"), F.concat(abbr, F.lit("-"), p).alias("id"),
        ft.pick(STATES, p % 51).alias("jurisdiction"), F.when(p % 40 == 0, F.lower(abbr)).otherwise(abbr).alias("abbr"),
        F.when(p % 43 == 0, "other").otherwise(ft.pick(fixed.PETITION_TYPES, F.floor(p / 51) % 6)).alias("petitionType"),
        F.struct((p * 37 % 200000 + 1000).alias("required"), F.lit("headline").alias("headline")).alias("signatures"),
        F.when(p % 41 != 0, F.struct(ft.pick(HEADLINES, p % 5).alias("headline"))).alias("deadline"),
        listed.alias("rules"),
        F.struct(ft.pick(fixed.PAY_RULES, p % 3).alias("perSignatureAllowed"), ft.pick(RESIDENCY, size % 6).alias("circulatorResidency"),
                 F.lit("AUTO-LIVE").alias("gate")).alias("compensation"),
        F.struct(F.when(p % 13 != 0, ft.pick(fixed.FILE_TIERS, size % 5)).alias("tier"),
                 F.date_format(F.date_add(F.lit("2027-06-01").cast("date"), (p * 3 % 400).cast("int")), "yyyy-MM-dd").alias("verifiedAsOf")).alias("voterFile"),
        F.struct(F.lit("AUTO-LIVE").alias("gate")).alias("circulator"),
        F.struct(RR.strictest_gate(F.transform(listed, lambda r: r["gate"])).alias("gate"), (p % 4).alias("sosInquiries")).alias("verification"),
        citation.alias("citations"),
        F.struct(F.lit("2026-06-07").alias("verifiedAsOf"), text(F.lit("method")).alias("method")).alias("provenance"),
    )


def _gate_sql(i: int) -> str:
    return O.pick(fixed.GATES, f"((p_partkey + {i * 7} + p_size) % 6) % 3 * CASE WHEN (p_partkey + {i}) % 4 = 0 THEN 1 ELSE 0 END")


_RULE_SQL = ", ".join(
    f"{{'field': '{f}', 'gate': {_gate_sql(i)}, 'confidence': CASE WHEN p_partkey % 50 = {i} THEN 1.5::DOUBLE ELSE (p_partkey % 11) / 10.0::DOUBLE END}}"
    for i, f in enumerate(FIELDS))
RULES = f"""rules0 AS (SELECT p_partkey AS p, {O.pick(ABBRS, 'p_partkey % 51')} || '-' || p_partkey AS id, {O.pick(STATES, 'p_partkey % 51')} AS jurisdiction,
 CASE WHEN p_partkey % 40 = 0 THEN lower({O.pick(ABBRS, 'p_partkey % 51')}) ELSE {O.pick(ABBRS, 'p_partkey % 51')} END AS abbr,
 CASE WHEN p_partkey % 43 = 0 THEN 'other' ELSE {O.pick(fixed.PETITION_TYPES, '(p_partkey // 51) % 6')} END AS petition_type,
 1000 + p_partkey * 37 % 200000 AS required, CASE WHEN p_partkey % 41 <> 0 THEN {O.pick(HEADLINES, 'p_partkey % 5')} END AS headline,
 [{_RULE_SQL}] AS rules, {O.pick(fixed.PAY_RULES, 'p_partkey % 3')} AS pay, {O.pick(RESIDENCY, 'p_size % 6')} AS residency,
 CASE WHEN p_partkey % 13 <> 0 THEN {O.pick(fixed.FILE_TIERS, 'p_size % 5')} END AS tier, p_partkey % 4 AS inquiries, p_partkey % 3 + 1 AS citations,
 strftime(DATE '2027-06-01' + CAST(p_partkey * 3 % 400 AS INTEGER), '%Y-%m-%d') AS verified FROM part),
rules AS (SELECT *, ({O.sql_list(fixed.GATES)})[list_max(list_transform(rules, lambda r: list_position({O.sql_list(fixed.GATES)}, r.gate)))] AS gate FROM rules0)"""
W = f"WITH {RULES} "
_FREE = "residency IN ('required', 'in-state only', 'unknown')"


@query("rules_scan", W + "SELECT id, jurisdiction, abbr, petition_type, required, headline, pay, tier, gate, len(rules) AS rules, citations FROM rules")
def rules_scan(spark, d):
    """Records written as JSON lines and read back with the fixed schema."""
    path = scratch(spark, "rules")
    r = rules(spark, d)
    r.write.json(path)
    return RR.scan_rules(spark, path, one_per_file=False).select(
        "id", "jurisdiction", "abbr", F.col("petitionType").alias("petition_type"), F.col("signatures.required").alias("required"),
        F.col("deadline.headline").alias("headline"), F.col("compensation.perSignatureAllowed").alias("pay"),
        F.col("voterFile.tier").alias("tier"), F.col("verification.gate").alias("gate"), F.size("rules").alias("rules"),
        F.size("citations").alias("citations"))


@query("rules_publish", W + "SELECT abbr AS id, count(*) AS records, CAST(sum(required) AS BIGINT) AS required FROM rules GROUP BY 1")
def rules_publish(spark, d):
    path = scratch(spark, "published")
    RR.publish_rules(rules(spark, d).withColumn("id", F.col("abbr")), path)
    return RR.scan_rules(spark, path, one_per_file=False).groupBy("id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("signatures.required").alias("required"))


@query("rules_manifest", W + """SELECT 2::BIGINT AS edition, count(*) AS records, count(DISTINCT abbr) AS jurisdictions, CAST(sum(citations) AS BIGINT) AS citations, CAST(sum(inquiries) AS BIGINT) AS inquiries, count(*) AS read_back FROM rules""")
def rules_manifest(spark, d):
    """Two editions published, a third broken off before its manifest: the manifest's tallies, and the records that a reader gets."""
    path, records = scratch(spark, "editions"), stage(rules(spark, d), "records")
    RR.publish(records.where("petitionType = 'initiated-statute'"), path, 1)
    RR.publish(records, path, 2)
    records.limit(3).select(F.to_json(F.struct(*records.columns)).alias("value")).write.text(f"{path}/edition=3")
    counted = RR.read_published(spark, path).agg(F.count(F.lit(1)).alias("read_back"))
    return RR.manifest(spark, path).crossJoin(counted).select("edition", "records", "jurisdictions", "citations", "inquiries", "read_back")


#: A right record, and texts that break it: (old, new, path, problem).
RIGHT = ('{"schemaVersion":"%s","id":"@","jurisdiction":"Ohio","abbr":"OH","petitionType":"initiated-statute","signatures":{"required":100,"headline":"h"},"deadline":{"headline":"h"},'
         '"rules":[{"field":"deadline","gate":"AUTO-LIVE","confidence":0.5,"interpretationRequired":false}],"circulator":{"minAge":18,"usCitizenRequired":"yes"},'
         '"verification":{"gate":"AUTO-LIVE","sosInquiries":1},"citations":[{"url":"http://a","quote":"q"}],"provenance":{"verifiedAsOf":"2026-01-01","method":"m"}}' % fixed.RULE_SCHEMA_VERSION)
PLANTED = (
    ('"abbr":"OH"', '"abbr":"Oh"', "$.abbr", "pattern"), ('"required":100', '"required":-1', "$.signatures.required", "minimum"),
    ('"required":100', '"required":"100"', "$.signatures.required", "type"), ('"required":100,', "", "$.signatures.required", "required"),
    ('"confidence":0.5', '"confidence":1.5', "$.rules[0].confidence", "maximum"), ('"minAge":18', '"minAge":17.5', "$.circulator.minAge", "type"),
    ('"usCitizenRequired":"yes"', '"usCitizenRequired":"maybe"', "$.circulator.usCitizenRequired", "enum"), ('"url":"http://a",', "", "$.citations[0].url", "required"),
    ('"method":"m"', '"method":null', "$.provenance.method", "type"), ('"verifiedAsOf":"2026-01-01",', "", "$.provenance.verifiedAsOf", "required"),
    ('"quote":"q"', '"quote":"q","page":3', "$.citations[0].page", "additional"), ('"provenance":{', '"extra":1,"provenance":{', "$.extra", "additional"),
    (fixed.RULE_SCHEMA_VERSION, "0.9", "$.schemaVersion", "enum"), ('"provenance":{', '"provenance":{{', "$", "json"), ('"rules":[', '"rules":[7,', "$.rules[0]", "type"))


@query("record_quality", "SELECT p_partkey AS id, path, problem FROM part JOIN (VALUES " + ", ".join(f"({i + 1}, '{p}', '{x}')" for i, (_, _, p, x) in enumerate(PLANTED)) + f") v(i, path, problem) ON p_partkey % {len(PLANTED) + 1} = i")
def record_quality(spark, d):
    """A raw record for every part, each with one planted violation or none."""
    k = F.col("p_partkey")
    right, value = F.replace(F.lit(RIGHT), F.lit("@"), k.cast("string")), None
    for i, (old, new, _, _) in enumerate(PLANTED):
        broken, own = F.replace(right, F.lit(old), F.lit(new)), k % (len(PLANTED) + 1) == i + 1
        value = F.when(own, broken) if value is None else value.when(own, broken)
    raw = dealt(ft.read(spark, d, "part").select("p_partkey")).select(k.alias("id"), value.otherwise(right).alias("value"))
    return expectations.violations(raw, [*expectations.of_schema(RR.RULE_RECORD), *expectations.RULE_EXPECTATIONS])


@query("rule_query", W + f"SELECT 'go+free+small' AS q, id FROM rules WHERE pay <> 'no' AND tier = 'FREE_DOWNLOAD' AND required <= 50000 UNION ALL SELECT 'statute+residency', id FROM rules WHERE petition_type = 'initiated-statute' AND {_FREE} UNION ALL SELECT 'hold+min+name', id FROM rules WHERE gate = 'CONSERVATIVE-HOLD' AND required >= 20000 AND contains(lower(jurisdiction || ' ' || abbr), 'new') UNION ALL SELECT 'no residency', id FROM rules WHERE NOT {_FREE} AND pay = 'unaddressed' AND tier = 'PAID'")
def rule_query(spark, d):
    r = rules(spark, d)
    asked = {
        "go+free+small": rulebook.rule_query(r, per_signature="go", free_file=True, max_signatures=50000),
        "statute+residency": rulebook.rule_query(r, petition_type="initiated-statute", residency_required=True),
        "hold+min+name": rulebook.rule_query(r, gate="CONSERVATIVE-HOLD", min_signatures=20000, contains="new"),
        "no residency": rulebook.rule_query(r, residency_required=False, per_signature="unaddressed", file_tier="PAID"),
    }
    parts = [df.select(F.lit(q).alias("q"), "id") for q, df in asked.items()]
    return RR.union_rules(*parts)


@query("rule_lookup", W + "(SELECT 'abbr' AS by_, id FROM rules WHERE lower(abbr) = 'oh' ORDER BY jurisdiction, id LIMIT 1) UNION ALL (SELECT 'name', id FROM rules WHERE lower(jurisdiction) = 'new york' ORDER BY jurisdiction, id LIMIT 1) UNION ALL (SELECT 'id', id FROM rules WHERE lower(id) = 'al-51')")
def rule_lookup(spark, d):
    r = rules(spark, d)
    parts = [rulebook.rule_lookup(r, key).select(F.lit(by).alias("by_"), "id") for by, key in (("abbr", "OH"), ("name", "New York"), ("id", "al-51"))]
    return RR.union_rules(*parts)


@query("rules_canonical", W + "SELECT id, required, gate, citations + 3 AS citations, 'deadline' AS first_field, 18 AS min_age, jurisdiction AS note, residency, tier, 'research file' AS source FROM rules")
def rules_canonical(spark, d):
    """Research rows (four citation places) to canonical records."""
    r = rules(spark, d)
    one = lambda label: F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("u").alias("url"), F.lit(label).alias("quote")))
    fields = F.transform("rules", lambda f: F.struct(
        f["field"].alias("field"), f["gate"].alias("gate"), f["value"].alias("reliedValue"), f["confidence"].alias("confidence"),
        f["interpretationRequired"].alias("interpretationRequired"), f["note"].alias("note"),
        F.when(f["field"] == "deadline", F.col("citations")).otherwise(F.slice("citations", 1, 0)).alias("citations")))
    research = r.select(
        "id", "jurisdiction", "abbr", F.col("petitionType").alias("petition_type"), F.col("signatures.required").alias("required"),
        F.lit("h").alias("headline"), F.col("deadline.headline").alias("deadline"), fields.alias("fields"),
        F.col("compensation").withField("citations", one("c")).alias("compensation"),
        F.col("voterFile").withField("citations", one("v")).alias("voter_file"),
        F.col("circulator").withField("citations", one("k")).withField("minAge", F.lit(18)).withField("note", F.col("jurisdiction")).alias("circulator"),
        F.col("verification.sosInquiries").alias("sos_inquiries"), F.lit("").alias("risk_note"))
    return RR.canonical_rules(research).select(
        "id", F.col("signatures.required").alias("required"), F.col("verification.gate").alias("gate"),
        F.size("citations").alias("citations"), F.col("citations")[0]["field"].alias("first_field"), F.col("circulator.minAge").alias("min_age"),
        F.col("circulator.note").alias("note"), F.col("compensation.circulatorResidency").alias("residency"), F.col("voterFile.tier").alias("tier"),
        F.col("provenance.source").alias("source"))


@query("draft_citations", W + """, f AS (SELECT id, unnest([{'field': 'deadline', 'n': citations}, {'field': 'form', 'n': 0}]) AS f FROM rules)
SELECT id, f.field AS field, CASE WHEN k >= 0 THEN 'http://law.example/' || id || '/' || k END AS url FROM (SELECT id, f, unnest(CASE WHEN f.n = 0 THEN [-1] ELSE range(0, f.n) END) AS k FROM f)""")
def draft_citations(spark, d):
    """Drafts written as JSON and read back; a field without citations keeps its row."""
    none = F.array().cast("array<struct<url:string,quote:string>>")
    cited = F.transform(F.sequence(F.lit(0), F.size("citations") - 1), lambda i: F.struct(
        F.concat(F.lit("http://law.example/"), F.col("id"), F.lit("/"), i).alias("url"), F.lit("quote").alias("quote")))
    field = lambda name, citations: F.struct(F.lit(name).alias("field"), F.lit("v").alias("value"), citations.alias("citations"))
    path = scratch(spark, "drafts")
    rules(spark, d).select("id", "jurisdiction", F.array(field("deadline", cited), field("form", none)).alias("fields")).write.json(path)
    return RR.draft_citations(RR.read_drafts(spark, path)).select("id", "field", "url")


@query("strictest_gate", W + "SELECT id, gate FROM rules")
def strictest_gate(spark, d):
    return rules(spark, d).select("id", RR.strictest_gate(F.transform("rules", lambda r: r["gate"])).alias("gate"))


@query("rules_union", W + "SELECT jurisdiction, count(*) AS records, count(petition_type) AS typed FROM (SELECT jurisdiction, petition_type FROM rules UNION ALL SELECT jurisdiction, NULL FROM rules WHERE required > 100000) GROUP BY 1")
def rules_union(spark, d):
    r = rules(spark, d)
    measures = r.where("signatures.required > 100000").select("jurisdiction")
    return RR.union_rules(r.select("jurisdiction", "petitionType"), measures).groupBy("jurisdiction").agg(
        F.count(F.lit(1)).alias("records"), F.count("petitionType").alias("typed"))


BOARD = W + """, flat AS (SELECT id, jurisdiction, inquiries, unnest(rules) AS r FROM rules),
tally AS (SELECT id, jurisdiction, inquiries, count(*) FILTER (c AND r.gate = 'CONSERVATIVE-HOLD') AS critical_hold, count(*) FILTER (c AND r.gate = 'BLOCKED') AS critical_blocked,
 count(*) FILTER (NOT c AND r.gate = 'CONSERVATIVE-HOLD') AS minor_hold, count(*) FILTER (NOT c AND r.gate = 'BLOCKED') AS minor_blocked
 FROM (SELECT *, r.field IN ('signaturesRequired', 'deadline', 'distributionRule') AS c FROM flat) GROUP BY ALL) """


@query("risk_board", BOARD + "SELECT *, CASE WHEN critical_blocked > 0 THEN 'red' WHEN critical_hold > 0 THEN 'amber' ELSE 'green' END AS status, CASE WHEN critical_blocked > 0 THEN 0 WHEN critical_hold > 0 THEN 1 ELSE 3 END AS rank FROM tally")
def risk_board(spark, d):
    return rulebook.risk_board(rules(spark, d))


@query("risk_board_all", BOARD + """SELECT id, status, rank FROM (SELECT *, CASE WHEN critical_blocked + minor_blocked > 0 THEN 'red' WHEN critical_hold + minor_hold > 0 THEN 'amber' ELSE 'green' END AS status,
 CASE WHEN critical_blocked + minor_blocked > 0 THEN 0 WHEN critical_hold > 0 THEN 1 WHEN minor_hold > 0 THEN 2 ELSE 3 END AS rank FROM tally) WHERE status = 'amber' AND contains(lower(jurisdiction), 'o')""")
def risk_board_all(spark, d):
    board = rulebook.risk_board(rules(spark, d), lens="all")
    return rulebook.filter_board(board, status="amber", contains="o", sort="sos").select("id", "status", "rank")


@query("board_totals", BOARD + """SELECT count(*) AS records, count(*) FILTER (critical_blocked = 0 AND critical_hold = 0) AS clear, count(*) FILTER (critical_blocked = 0 AND critical_hold > 0) AS review,
 count(*) FILTER (critical_blocked > 0) AS blocked, CAST(sum(inquiries) AS BIGINT) AS inquiries FROM tally""")
def board_totals(spark, d):
    return rulebook.board_totals(rulebook.risk_board(rules(spark, d)))


@query("rules_coverage", W + """SELECT 'petition_type' AS facet, petition_type AS key, count(*) AS n FROM rules GROUP BY 2 UNION ALL SELECT 'gate', gate, count(*) FROM rules GROUP BY 2
 UNION ALL SELECT 'file_tier', coalesce(tier, 'UNKNOWN'), count(*) FROM rules GROUP BY 2 UNION ALL SELECT 'per_signature', pay, count(*) FROM rules GROUP BY 2
 UNION ALL SELECT 'total', 'records', count(*) FROM rules UNION ALL SELECT 'total', 'citations', CAST(sum(citations) AS BIGINT) FROM rules
 UNION ALL SELECT 'total', 'inquiries', CAST(sum(inquiries) AS BIGINT) FROM rules UNION ALL SELECT 'total', 'jurisdictions', count(DISTINCT abbr) FROM rules""")
def rules_coverage(spark, d):
    return rulebook.rules_coverage(rules(spark, d))


@query("rule_violations", W + """, flat AS (SELECT id, unnest(rules) AS r, generate_subscripts(rules, 1) - 1 AS i FROM rules)
SELECT id, 'abbr' AS path, 'pattern' AS problem FROM rules WHERE NOT regexp_full_match(abbr, '[A-Z]{2}') UNION ALL SELECT id, 'deadline', 'required' FROM rules WHERE headline IS NULL
 UNION ALL SELECT id, 'petitionType', 'enum' FROM rules WHERE petition_type = 'other' UNION ALL SELECT id, 'rules[' || i || '].confidence', 'range' FROM flat WHERE r.confidence > 1""")
def rule_violations(spark, d):
    return rulebook.rule_violations(rules(spark, d))


FRESH = W + f""", assessed AS (SELECT jurisdiction AS "group", CAST(verified AS DATE) + 180 AS due FROM rules),
fresh AS (SELECT *, due - DATE '{TODAY}' AS days_left FROM assessed), st AS (SELECT *, CASE WHEN days_left < 0 THEN 'stale' WHEN days_left <= 30 THEN 'soon' ELSE 'fresh' END AS state FROM fresh) """


@query("freshness", FRESH + """SELECT "group", count(*) AS records, count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'soon') AS soon, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'unknown') AS unknown,
 min(due) AS next_due, count(*) FILTER (due = first_due) AS tied FROM (SELECT *, min(due) OVER (PARTITION BY "group") AS first_due FROM st) GROUP BY 1""")
def freshness(spark, d):
    records = rules(spark, d).select(
        F.col("jurisdiction").alias("group"), F.col("id").alias("label"), F.col("voterFile.verifiedAsOf").alias("verified_as_of"),
        F.lit(fixed.VOTER_FILE_DAYS).alias("window_days"))
    return rulebook.freshness_summary(rulebook.freshness(records, TODAY))


@query("layout_freshness", f"""WITH files AS (SELECT s_suppkey AS label, {O.pick(tuple(LAYOUTS), f's_suppkey % {len(LAYOUTS)}')} AS jurisdiction, CASE WHEN s_suppkey % 10 > 0 THEN DATE '{TODAY}' - CAST(s_suppkey * 13 % 500 AS INTEGER) END AS verified FROM supplier)
SELECT label, jurisdiction, verified + 365 AS due, verified + 365 - DATE '{TODAY}' AS days_left,
 CASE WHEN verified IS NULL THEN 'unknown' WHEN verified + 365 < DATE '{TODAY}' THEN 'stale' WHEN verified + 335 <= DATE '{TODAY}' THEN 'soon' ELSE 'fresh' END AS state,
 CASE WHEN verified IS NULL THEN 'no verification date' WHEN jurisdiction IN ({', '.join(O.quoted(n) for n, x in LAYOUTS.items() if x.confidence == 'low')}) THEN 'low confidence' END AS flag FROM files""")
def layout_freshness(spark, d):
    """Suppliers as roll files, each in one of the layouts; every tenth has no date."""
    k = F.col("s_suppkey")
    files = ft.read(spark, d, "supplier").select(
        k.alias("label"), ft.pick(tuple(LAYOUTS), k % len(LAYOUTS)).alias("jurisdiction"),
        F.when(k % 10 > 0, F.date_sub(F.lit(TODAY).cast("date"), (k * 13 % 500).cast("int")).cast("string")).otherwise("").alias("verified_as_of"))
    return rulebook.layout_freshness(files, TODAY).select("label", "jurisdiction", "due", "days_left", "state", "flag")


@query("deadline_days", W + f""", parsed AS (SELECT id, lower(regexp_extract(coalesce(headline, ''), '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z.]*\\s+([0-9]{{1,2}})', 1, 'i')) AS m,
 regexp_extract(coalesce(headline, ''), '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z.]*\\s+([0-9]{{1,2}})', 2, 'i') AS dd FROM rules),
due AS (SELECT id, m, CASE WHEN m <> '' THEN make_date(2028, list_position({O.sql_list(fixed.MONTHS)}, m), 1) + CAST(dd AS INTEGER) - 1 - DATE '{TODAY}' END AS gap FROM parsed)
SELECT id, CASE WHEN m = '' THEN 120 WHEN gap > 0 THEN gap ELSE 30 END AS days_left FROM due""")
def deadline_days(spark, d):
    return rules(spark, d).select("id", days_to_deadline("deadline.headline", TODAY).alias("days_left"))


@query("campaign_compliance", W + """, camps AS (SELECT 'c' || n_nationkey AS campaign_id, """ + O.pick(STATES, "n_nationkey * 2") + """ AS jurisdiction, 'initiated-statute' AS petition_type FROM nation)
SELECT campaign_id, c.jurisdiction, c.petition_type, coalesce(pay, 'unknown') AS pay_rule, CASE WHEN pay IN ('yes', 'unaddressed') AND gate = 'AUTO-LIVE' THEN 'per-valid-signature' ELSE 'hourly' END AS basis,
 coalesce(residency IN ('required', 'in-state only', 'unknown'), true) AS residency_required, coalesce(gate, 'BLOCKED') AS gate FROM camps c LEFT JOIN rules r ON r.jurisdiction = c.jurisdiction AND r.petition_type = c.petition_type""")
def campaign_compliance(spark, d):
    n = F.col("n_nationkey")
    campaigns = ft.read(spark, d, "nation").select(
        F.concat(F.lit("c"), n).alias("campaign_id"), ft.pick(STATES, n * 2).alias("jurisdiction"), F.lit("initiated-statute").alias("petition_type"))
    return rulebook.campaign_compliance(campaigns, rules(spark, d))


# --- pages and citations -------------------------------------------------------------------------
def _fold_sql(x: str) -> str:
    """Quote fold for the letters that occur in the documents (accents stay)."""
    return f"trim(regexp_replace(lower(replace(translate({x}, '‘’“”–— `', '''''\"\"-- '''), '…', '...')), '\\s+', ' ', 'g'))"


PAGE = "page_texts AS (SELECT page_id, trim(regexp_replace(" + "regexp_replace(" * 10 + """html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;|&apos;', '''', 'gi'), '\\s+', ' ', 'g')) AS content FROM pages)"""


@query("page_text", f"WITH {PAGE} SELECT page_id, content FROM page_texts")
def page_text(spark, d):
    return dealt(ft.read(spark, d, "pages").select("page_id", "html")).select("page_id", X.page_text("html").alias("content"))


def _documents(spark, d):
    """Documents as pages; the whole text is the content."""
    docs = dealt(ft.read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("url"), F.col("text").alias("content"))


def citations(spark, d):
    """One citation per document: its own words, altered ones, invented ones, or a page that is missing.

    The kind follows from the document id; three neighbouring citations back one field.
    """
    pages = _documents(spark, d)
    k = F.col("doc_id") % 6
    w = F.split(F.col("folded"), " ", 21)  # the words that quotes take, and the rest of the text
    own = F.array_join(F.slice(w, 3, 18), " ")
    dropped = F.array_join(F.concat(F.slice(w, 3, 6), F.slice(w, 10, 9)), " ")
    base = pages.select("doc_id", "url", X.quote_fold("content").alias("folded"))
    return base.select(
        "doc_id", F.floor(F.col("doc_id") / 3).alias("field_id"),
        F.when(k == 5, F.concat(F.lit("gone/"), "doc_id")).otherwise(F.col("url")).alias("url"),
        F.when(k == 1, F.replace(own, F.lit(" "), F.lit("  "))).when(k == 2, dropped).when(k == 3, F.lit("invented words that no page contains anywhere at all"))
        .otherwise(own).alias("quote"))


CITED = f"""docs AS (SELECT doc_id, 'doc/' || doc_id AS url, {_fold_sql('text')} AS content FROM documents), w AS (SELECT *, string_split(content, ' ') AS ws FROM docs),
citations AS (SELECT doc_id, doc_id // 3 AS field_id, CASE WHEN doc_id % 6 = 5 THEN 'gone/' || doc_id ELSE url END AS url,
 CASE doc_id % 6 WHEN 1 THEN replace(array_to_string(ws[3:20], ' '), ' ', '  ') WHEN 2 THEN array_to_string(list_concat(ws[3:8], ws[10:18]), ' ') WHEN 3 THEN 'invented words that no page contains anywhere at all' ELSE array_to_string(ws[3:20], ' ') END AS quote FROM w),
exact AS (SELECT c.doc_id, c.field_id, d.content IS NOT NULL AND d.content <> '' AS found, coalesce({_fold_sql('quote')} <> '' AND contains(d.content, {_fold_sql('quote')}), false) AS is_exact FROM citations c LEFT JOIN docs d ON d.url = c.url),
checked AS (SELECT *, CASE WHEN NOT found THEN 'UNREACHABLE' WHEN is_exact THEN 'GROUNDED' ELSE 'NOT_FOUND' END AS verdict FROM exact)"""
CW = f"WITH {CITED} "
#: The window search by its definition: windows of two lengths around the rarest word of the quote, bigrams as multisets.
FUZZY = CITED.replace("checked AS (", "exactly AS (") + f""",
searched AS (SELECT e.doc_id, string_split(d.content, ' ') AS w, string_split({_fold_sql('c.quote')}, ' ') AS q FROM exact e JOIN citations c USING (doc_id) JOIN docs d ON d.url = c.url WHERE e.found AND NOT e.is_exact AND len(string_split({_fold_sql('c.quote')}, ' ')) >= 2),
counted AS (SELECT doc_id, w, q, i, q[i] AS word, len(list_filter(w, lambda x: x = q[i])) AS n FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM searched)),
anchored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, length(word) DESC, i) AS turn FROM counted WHERE n > 0) WHERE turn = 1),
spots AS (SELECT doc_id, w, q, unnest(list_filter(range(1, len(w) + 1), lambda k: w[k] = word)) AS p FROM anchored),
spans AS (SELECT DISTINCT doc_id, w, len(q) AS m, l, s, least(s + l - 1, len(w)) AS e FROM (SELECT doc_id, w, q, l, unnest(range(greatest(1, p - l + 1), p + 1)) AS s FROM (SELECT *, unnest([len(q), len(q) + {fixed.WIDER_WINDOW}]) AS l FROM spots))),
have AS (SELECT doc_id, m, l, s, e - s AS total, g, count(*) AS n FROM (SELECT *, unnest(list_transform(range(s, e), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM spans) GROUP BY ALL),
need AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(q)), lambda k: q[k] || ' ' || q[k + 1])) AS g FROM searched) GROUP BY ALL),
shared AS (SELECT doc_id, m, l, s, total, sum(least(have.n, need.n)) AS common FROM have JOIN need USING (doc_id, g) GROUP BY ALL),
best AS (SELECT doc_id, max(greatest(2{D} * common / (m - 1 + total), common::DOUBLE / (m - 1))) AS score FROM shared GROUP BY 1),
scored AS (SELECT exact.*, CASE WHEN NOT found THEN 0{D} WHEN is_exact THEN 1{D} ELSE coalesce(best.score, 0{D}) END AS score FROM exact LEFT JOIN best USING (doc_id)),
checked AS (SELECT *, CASE WHEN NOT found THEN 'UNREACHABLE' WHEN score >= {fixed.GROUNDED_AT} THEN 'GROUNDED' WHEN score >= {fixed.PARTIAL_AT} THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS verdict FROM scored)"""
FW = f"WITH {FUZZY} "


def _checked(spark, d, fuzzy: bool = True):
    return grounding.check_citations(citations(spark, d), _documents(spark, d).select("url", "content"), fuzzy=fuzzy)


@query("ground_exact", CW + "SELECT doc_id, verdict, is_exact FROM checked")
def ground_exact(spark, d):
    return _checked(spark, d, fuzzy=False).select("doc_id", "verdict", "is_exact")


@query("ground_fuzzy", FW + "SELECT doc_id, verdict, round(score, 6) AS score FROM checked")
def ground_fuzzy(spark, d):
    return _checked(spark, d).select("doc_id", "verdict", F.round("score", 6).alias("score"))


@query("ground_report", FW + "SELECT field_id % 7 AS batch, count(*) AS citations, count(*) FILTER (verdict = 'GROUNDED') AS grounded, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'NOT_FOUND') AS not_found, count(*) FILTER (verdict = 'UNREACHABLE') AS unreachable, round(count(*) FILTER (verdict = 'GROUNDED') / CAST(count(*) FILTER (verdict <> 'UNREACHABLE') AS DOUBLE), 6) AS grounded_rate, CASE WHEN count(*) FILTER (verdict = 'NOT_FOUND') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'UNREACHABLE') > 0 THEN 'RE-FETCH' WHEN count(*) FILTER (verdict = 'PARTIAL') > 0 THEN 'REVIEW' ELSE 'PASS' END AS gate FROM checked GROUP BY 1")
def ground_report(spark, d):
    checked = _checked(spark, d).withColumn("batch", F.col("field_id") % 7)
    return grounding.ground_report(checked, ["batch"]).withColumn("grounded_rate", F.round("grounded_rate", 6))


def _gated(spark, d):
    checked = _checked(spark, d)
    fields = ft.read(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 3).alias("field_id")).distinct().withColumn("value", F.concat(F.lit("value "), "field_id")).withColumn(
        "fallback", F.when(F.col("field_id") % 2 == 0, F.concat(F.lit("strict "), "field_id")))
    judgements = ft.read(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 3).alias("field_id")).agg(
        F.bool_and(F.col("quality") == 1).alias("agree"), F.bool_or(F.col("toxic") == 1).alias("interpretation_required"))
    return grounding.rule_gate(fields, checked, judgements)


GATED = FW + """, j AS (SELECT doc_id // 3 AS field_id, bool_and(quality = 1) AS agree, bool_or(toxic = 1) AS interp FROM labels GROUP BY 1),
c AS (SELECT field_id, count(*) AS n, count(*) FILTER (verdict = 'GROUNDED') AS grounded, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'NOT_FOUND') AS not_found, count(*) FILTER (verdict = 'UNREACHABLE') AS unreachable FROM checked GROUP BY 1),
reasoned AS (SELECT c.*, CASE WHEN not_found > 0 THEN 'citation_integrity' WHEN grounded = 0 AND unreachable = n THEN 'all_unreachable' WHEN grounded = 0 THEN 'none_grounded'
 WHEN NOT coalesce(agree, false) THEN 'disagree' WHEN coalesce(interp, true) THEN 'interpretation' WHEN partial > 0 THEN 'partial' ELSE 'ok' END AS reason FROM c LEFT JOIN j USING (field_id)),
gated AS (SELECT *, reason NOT IN ('citation_integrity', 'all_unreachable', 'none_grounded') AS judged, CASE WHEN reason IN ('citation_integrity', 'all_unreachable', 'none_grounded') THEN 'BLOCKED' WHEN reason = 'ok' THEN 'AUTO-LIVE' ELSE 'CONSERVATIVE-HOLD' END AS gate FROM reasoned) """


@query("rule_gate", GATED + "SELECT field_id, grounded, partial, not_found, unreachable, gate, reason, judged, CASE WHEN NOT judged THEN NULL WHEN reason IN ('disagree', 'interpretation') THEN (CASE WHEN field_id % 2 = 0 THEN 'strict ' || field_id ELSE 'STRICTEST reading of: value ' || field_id END) ELSE 'value ' || field_id END AS relied_value FROM gated")
def rule_gate(spark, d):
    return _gated(spark, d)


@query("gate_summary", GATED + "SELECT count(*) AS fields, count(*) FILTER (gate = 'AUTO-LIVE') AS auto_live, count(*) FILTER (gate = 'CONSERVATIVE-HOLD') AS held, count(*) FILTER (gate = 'BLOCKED') AS blocked, count(*) FILTER (NOT judged) AS short_circuited FROM gated")
def gate_summary(spark, d):
    return grounding.gate_summary(_gated(spark, d))


@query("default_judgements", """SELECT o_orderkey AS field_id, NOT stale AS agree, legal AND NOT stale AS interpretation_required, CAST(CASE WHEN stale THEN 0.4 WHEN legal THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence
 FROM (SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS stale, o_orderpriority IN ('1-URGENT', '2-HIGH') AS legal FROM orders)""")
def default_judgements(spark, d):
    o = F.col("o_orderkey")
    fields = ft.read(spark, d, "orders").select(
        o.alias("field_id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "filingDeadline").otherwise("captureMode").alias("field"),
        F.when(o % 3 == 0, "a fee of $500").when(o % 5 == 0, "at least 5,000 signatures").otherwise("by statute").alias("value"))
    return grounding.default_judgements(fields)
