"""Nested rule records: schema, scan, canonical form, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CITATION = T.StructType(_strings("field", "url", "quote"))
RULE_RECORD = T.StructType([
    *_strings("schemaVersion", "id", "jurisdiction", "abbr", "petitionType"),
    T.StructField("signatures", T.StructType([T.StructField("required", T.LongType()), *_strings("headline")])),
    T.StructField("deadline", T.StructType(_strings("headline"))),
    T.StructField("rules", T.ArrayType(T.StructType([
        *_strings("field", "gate", "value"), T.StructField("confidence", T.DoubleType()),
        T.StructField("interpretationRequired", T.BooleanType()), *_strings("note")]))),
    T.StructField("compensation", T.StructType(_strings(
        "perSignatureAllowed", "paidCirculatorsAllowed", "payMethod", "circulatorResidency", "operatingStance", "gate"))),
    T.StructField("voterFile", T.StructType(_strings(
        "tier", "cost", "whoCanObtain", "useRestrictions", "requestProcess", "hasNeededFields", "downloadUrl",
        "layoutDocUrl", "verifiedAsOf"))),
    T.StructField("circulator", T.StructType([
        T.StructField("minAge", T.LongType()),
        *_strings("ageRule", "minorCanCirculate", "registeredVoterRequired", "usCitizenRequired",
                  "stateResidentRequired", "signerVsCirculator", "gate", "note", "verifiedAsOf")])),
    T.StructField("verification", T.StructType([
        *_strings("gate"), T.StructField("sosInquiries", T.LongType()), *_strings("riskNote")])),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("provenance", T.StructType(_strings("verifiedAsOf", "method", "source"))),
])


def scan_rules(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Rule records; one JSON document per file, or one per line."""
    return spark.read.schema(RULE_RECORD).option("multiLine", one_per_file).json(path)


def publish_rules(records: DataFrame, path: str) -> None:
    """Canonical records, one folder per record id; null fields are left out of the JSON."""
    keyed = records.select(F.to_json(F.struct(*records.columns)).alias("value"), F.col("id").alias("record"))
    keyed.repartition("record").write.partitionBy("record").text(path)


#: The order of published records.
RECORD_ORDER = ("jurisdiction", "petitionType", "id")


def publish(records: DataFrame, path: str, number: int, rows_per_file: int = 10_000) -> None:
    """Publish a whole set of records in record order as edition ``number``.

    The records go to range-ordered files of an edition folder, and its manifest is written last: edition, folder, files, records and tallies.  Readers only
    follow manifests, so an edition that was not finished is not there, and one that is written again replaces its files first.
    """
    order = [F.col(c) for c in RECORD_ORDER]
    folder = f"{path}/edition={number}"
    files = max(1, -(-records.count() // rows_per_file))
    lines = records.repartitionByRange(files, *order).sortWithinPartitions(*order).select(F.to_json(F.struct(*records.columns)).alias("value"))
    lines.write.mode("overwrite").text(folder)
    written = records.sparkSession.read.schema(RULE_RECORD).json(folder).select("*", F.col("_metadata.file_path").alias("_file"))
    tallies = written.agg(
        F.count_distinct("_file").alias("files"), F.count(F.lit(1)).alias("records"), F.count_distinct("abbr").alias("jurisdictions"),
        F.sum(F.coalesce(F.array_size("citations"), F.lit(0))).cast("long").alias("citations"), F.sum(F.coalesce("verification.sosInquiries", F.lit(0))).alias("inquiries"))
    tallies.select(F.lit(number).cast("long").alias("edition"), F.lit(folder).alias("folder"), "*").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: the newest finished edition."""
    return spark.read.parquet(f"{path}/manifest").drop("number").orderBy(F.desc("edition")).limit(1)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The records of the newest finished edition."""
    return spark.read.schema(RULE_RECORD).json(manifest(spark, path).first().folder)


def canonical_rules(research: DataFrame, source: str = "research file") -> DataFrame:
    """Research rows to rule records: projections without nulls, citations of four places in one list.

    ``research`` has jurisdiction, abbr, petition_type, id, required, headline, deadline, fields (array of
    struct field, gate, reliedValue, confidence, interpretationRequired, note, citations),
    compensation, voter_file, circulator (structs with ``citations``), sos_inquiries, risk_note.
    """
    def picked(column: str, target: str) -> Column:
        """The record's fields of a research struct; fields that the research lacks are null."""
        have = research.schema[column].dataType.names
        return F.struct(*[
            (F.col(f"{column}.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RULE_RECORD[target].dataType.fields])

    def cited(label: str, citations) -> object:
        return F.transform(citations, lambda c: F.struct(
            F.coalesce(c["field"], F.lit(label)).alias("field"), c["url"].alias("url"), c["quote"].alias("quote")))

    nested = F.flatten(F.transform("fields", lambda f: F.transform(f["citations"], lambda c: F.struct(
        f["field"].alias("field"), c["url"].alias("url"), c["quote"].alias("quote")))))
    citations = F.concat(
        nested, cited("compensation", F.col("compensation.citations")),
        cited("voterFile", F.col("voter_file.citations")), cited("circulator", F.col("circulator.citations")))
    rules = F.transform("fields", lambda f: F.struct(
        f["field"].alias("field"), f["gate"].alias("gate"), f["reliedValue"].alias("value"),
        f["confidence"].alias("confidence"), f["interpretationRequired"].alias("interpretationRequired"),
        f["note"].alias("note")))
    gates = F.concat(F.transform("fields", lambda f: f["gate"]), F.array("compensation.gate"))
    known = F.create_map(*[F.lit(x) for kv in fixed.REQUIRED_SIGNATURES.items() for x in kv])
    required = F.coalesce(
        "required", F.element_at(known, F.col("jurisdiction")).cast("long"), F.lit(fixed.REQUIRED_SIGNATURES_DEFAULT).cast("long"))
    return research.select(
        F.lit(fixed.RULE_SCHEMA_VERSION).alias("schemaVersion"), "id", "jurisdiction", "abbr",
        F.col("petition_type").alias("petitionType"),
        F.struct(required.alias("required"), F.col("headline").alias("headline")).alias("signatures"),
        F.struct(F.col("deadline").alias("headline")).alias("deadline"),
        rules.alias("rules"),
        picked("compensation", "compensation").alias("compensation"),
        picked("voter_file", "voterFile").alias("voterFile"),
        picked("circulator", "circulator").alias("circulator"),
        F.struct(strictest_gate(gates).alias("gate"), F.col("sos_inquiries").alias("sosInquiries"),
                 F.col("risk_note").alias("riskNote")).alias("verification"),
        citations.alias("citations"),
        F.struct(F.coalesce("voter_file.verifiedAsOf", F.lit("2026-06-07")).alias("verifiedAsOf"),
                 F.lit("grounded and verified").alias("method"), F.lit(source).alias("source")).alias("provenance"),
    )


def strictest_gate(gates) -> object:
    """The strictest of an array of gates; an empty array is AUTO-LIVE."""
    order = F.array(*[F.lit(g) for g in fixed.GATES])
    rank = F.array_max(F.transform(F.filter(gates, lambda g: g.isNotNull() & (g != "")),
                                   lambda g: F.greatest(F.array_position(order, g), F.lit(1))))
    return F.element_at(order, F.coalesce(rank, F.lit(1)).cast("int"))


def union_rules(*parts: DataFrame) -> DataFrame:
    """Candidate and measure records as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


DRAFT = T.StructType([
    *_strings("id", "jurisdiction"),
    T.StructField("fields", T.ArrayType(T.StructType([
        *_strings("field", "value", "fallback"), T.StructField("citations", T.ArrayType(T.StructType(_strings("url", "quote"))))]))),
])


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts of rule records as JSON lines, each with fields and their citations."""
    return spark.read.schema(DRAFT).json(path)


def draft_citations(drafts: DataFrame) -> DataFrame:
    """One row per citation of a draft's field; a field without any keeps one row with nulls, as does a draft without fields."""
    fields = drafts.select("id", F.explode_outer("fields").alias("f"))
    cited = fields.select("id", "f.field", "f.value", F.explode_outer("f.citations").alias("c"))
    return cited.select("id", "field", "value", "c.url", "c.quote")
