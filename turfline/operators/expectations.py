"""Quality of raw JSON documents against a table of expectations.

An expectation is (path, kind, argument); ``[*]`` in a path stands for every element of a list.  Documents are parsed to VARIANT, so what a fixed read
schema would turn into nulls is seen: wrong types, keys that nobody expects, text that is no JSON.  One pass, no join; the checks go down a document
from member to member, so each value is taken out of the one above it once and not once for each expectation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed

Expectation = tuple[str, str, object]
_FOUND = "array<struct<path:string,problem:string>>"
_STEP = re.compile(r"\.[^.\[]+|\[[^\]]*\]")  # the steps of a path: a member's name, or a place in a list
_NAMED = re.compile(r"\.[^.\[]+")
_YES_NO = ("yes", "no", "unknown")

#: What rule records promise beyond the types and keys of their schema.
RULE_EXPECTATIONS: list[Expectation] = [
    *[("$", "required", k) for k in ("schemaVersion", "id", "jurisdiction", "abbr", "petitionType", "signatures", "deadline", "verification", "provenance")],
    ("$.signatures", "required", "required"), ("$.verification", "required", "gate"), ("$.provenance", "required", "verifiedAsOf"), ("$.provenance", "required", "method"),
    ("$.rules[*]", "required", "field"), ("$.rules[*]", "required", "gate"), ("$.citations[*]", "required", "url"),
    ("$.schemaVersion", "enum", (fixed.RULE_SCHEMA_VERSION,)), ("$.petitionType", "enum", fixed.PETITION_TYPES), ("$.abbr", "pattern", "^[A-Z]{2}$"),
    ("$.compensation.perSignatureAllowed", "enum", fixed.PAY_RULES), ("$.voterFile.tier", "enum", fixed.FILE_TIERS),
    *[(p, "enum", fixed.GATES) for p in ("$.rules[*].gate", "$.compensation.gate", "$.circulator.gate", "$.verification.gate")],
    *[(f"$.circulator.{k}", "enum", _YES_NO) for k in ("minorCanCirculate", "registeredVoterRequired", "usCitizenRequired", "stateResidentRequired")],
    *[(p, "minimum", 0) for p in ("$.signatures.required", "$.circulator.minAge", "$.verification.sosInquiries", "$.rules[*].confidence")],
    ("$.rules[*].confidence", "maximum", 1),
]


def of_schema(schema: T.DataType, path: str = "$") -> list[Expectation]:
    """Types and allowed keys of a read schema as expectations."""
    if isinstance(schema, T.StructType):
        inner = [e for f in schema.fields for e in of_schema(f.dataType, f"{path}.{f.name}")]
        return [(path, "type", "object"), (path, "keys", tuple(schema.names)), *inner]
    if isinstance(schema, T.ArrayType):
        return [(path, "type", "array"), *of_schema(schema.elementType, f"{path}[*]")]
    names = {T.StringType: "string", T.LongType: "integer", T.DoubleType: "number", T.BooleanType: "boolean"}
    return [(path, "type", names[type(schema)])]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _is(kind: str, x: Column, members: Column, items: Column) -> Column:
    if kind in ("object", "array"):
        return (members if kind == "object" else items).isNotNull()
    said = F.schema_of_variant(x)
    number = said.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if kind == "integer":
        value = F.try_variant_get(x, "$", "double")
        return number & (value == F.floor(value))
    return {"number": number, "string": said == "STRING", "boolean": said == "BOOLEAN"}[kind]


def _part(x: Column, members: Column, step: str) -> Column:
    """What one step of a path leads to: a member by its name, else whatever else a variant path may say."""
    return F.try_element_at(members, F.lit(step[1:])) if _NAMED.fullmatch(step) else F.try_variant_get(x, "$" + step, "variant")


def _checks(x: Column, members: Column, items: Column, where: Column, wanted: list[tuple[str, object]]) -> Column:
    """Problems of one value; a value of a wrong type has no other."""
    def problem(name: str, at: Column = where) -> Column:
        return F.struct(at.alias("path"), F.lit(name).alias("problem"))

    parts: list[Column] = []
    lists: list[Column] = []
    kind = next((argument for what, argument in wanted if what == "type"), None)
    text, number = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
    for what, argument in wanted:
        if what == "enum":
            parts.append(F.when(~text.isin(*argument), problem("enum")))
        elif what == "pattern":
            parts.append(F.when(~text.rlike(argument), problem("pattern")))
        elif what == "minimum":
            parts.append(F.when(number < argument, problem("minimum")))
        elif what == "maximum":
            parts.append(F.when(number > argument, problem("maximum")))
        elif what == "required":
            parts.append(F.when(_part(x, members, f".{argument}").isNull(), problem("required", F.concat(where, F.lit(f".{argument}")))))
        elif what == "keys":
            extra = F.array_except(F.map_keys(members), F.array(*[F.lit(k) for k in argument]))
            lists.append(F.coalesce(F.transform(extra, lambda k: problem("additional", F.concat(where, F.lit("."), k))), F.array().cast(_FOUND)))
    found = F.concat(F.array_compact(F.array(*parts)).cast(_FOUND) if parts else F.array().cast(_FOUND), *lists)
    right = _is(kind, x, members, items) if kind else F.lit(True)
    return F.when(~right, F.array(problem("type"))).otherwise(found)


class _Place:
    """What is expected of the value at one place, and of the places below it by the step that leads there."""

    def __init__(self) -> None:
        self.wanted: list[tuple[str, object]] = []
        self.below: dict[str, _Place] = {}

    def at(self, path: str) -> _Place:
        place = self
        for step in _STEP.findall(path):
            place = place.below.setdefault(step, _Place())
        return place

    def of_item(self, where: Column) -> Callable[[Column, Column], Column]:
        return lambda x, i: self.found(x, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")))

    def of_member(self, where: Column, step: str) -> Callable[[Column], Column]:
        return lambda x: self.found(x, F.concat(where, F.lit(step)))

    def found(self, x: Column, where: Column) -> Column:
        """Problems of a value and of everything below it; what is not there has none."""
        def inside(members: Column, items: Column) -> Column:
            each = [_checks(x, members, items, where, self.wanted)]
            for step, place in self.below.items():
                if step == "[*]":
                    each.append(F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), place.of_item(where))))
                else:
                    each.append(_bound(_part(x, members, step), place.of_member(where, step)))
            return F.concat(*each) if len(each) > 1 else each[0]

        def of_items(members: Column) -> Column:
            return _bound(F.try_variant_get(x, "$", "array<variant>"), lambda items: inside(members, items)) if listed else inside(members, F.lit(None).cast("array<variant>"))

        kinds = {argument for what, argument in self.wanted if what == "type"}
        listed = "array" in kinds or "[*]" in self.below
        named = "object" in kinds or set(self.below) - {"[*]"} or any(what in ("required", "keys") for what, _ in self.wanted)
        whole = _bound(F.try_variant_get(x, "$", "map<string,variant>"), of_items) if named else of_items(F.lit(None).cast("map<string,variant>"))
        return F.when(x.isNull(), F.array().cast(_FOUND)).otherwise(whole)


def violations(documents: DataFrame, expectations: list[Expectation], id_: str = "id", value: str = "value") -> DataFrame:
    """(id, path, problem) for every broken expectation of ``documents`` (id, value: JSON text).

    Problems: json (no JSON, or null), type, required, enum, pattern, minimum, maximum, additional.  What is not there breaks only ``required``.
    """
    root = _Place()
    for path, kind, argument in expectations:
        root.at(path).wanted.append((kind, argument))
    v = F.col("_v")
    whole = F.when(v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("problem")))).otherwise(root.found(v, F.lit("$")))
    parsed = documents.select(F.col(id_).alias("id"), F.try_parse_json(value).alias("_v"))
    return parsed.select("id", F.explode(whole).alias("p")).select("id", "p.path", "p.problem")
