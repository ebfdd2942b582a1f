"""JSON in free text, and the extraction contract's validation, as Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.text import strip
from docketlake.schema import DEGREES, EXTRACTED, OUTCOMES, PROCESSING_SOURCES

DATE = r"^\d{4}-\d{2}-\d{2}$"


def _object(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def extract_json_object(text: Column) -> Column:
    """The JSON object in a model's answer, as VARIANT: the whole text, else a fenced block, else first to last brace; null if none parses."""
    s = strip(text)
    fenced = F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), F.lit("}")) + 1
    braces = F.when((first > 0) & F.contains(s, F.lit("}")) & (last > first), F.substr(s, first, last - first + 1))
    return F.coalesce(_object(s), _object(strip(fenced)), _object(braces))


def envelope_answer(stdout: Column) -> Column:
    """A model tool's answer: its structured_output object, else the object in its result text, else in all of its output."""
    outer = F.try_parse_json(strip(stdout))
    structured = F.try_variant_get(outer, "$.structured_output", "variant")
    result = F.try_variant_get(outer, "$.result", "string")
    return F.coalesce(F.when(F.schema_of_variant(structured).startswith("OBJECT"), structured), extract_json_object(result), F.when(result.isNull(), extract_json_object(stdout)))


def envelope_cost(stdout: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(strip(stdout)), "$.total_cost_usd", "double")


def _allowed_keys(text: Column, path: str | None, names: list[str]) -> Column:
    """Whether the object at ``path`` has no key beyond ``names`` (null and absent objects do not)."""
    keys = F.json_object_keys(F.get_json_object(text, path) if path else text)
    return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0, F.lit(True))


def parse_extracted(text: Column) -> Column:
    """The contract of a JSON text, as ``schema.EXTRACTED``; ``known`` is derived from the value and never read."""
    raw = F.from_json(text, EXTRACTED)
    known = lambda c: F.struct(c["value"].alias("value"), c["value"].isNotNull().alias("known"))
    names = ("publications", "patents", "citations", "recommendation_letters", "years_experience")
    return F.struct(*[raw[f].alias(f) for f in ("is_niw_i140_decision", "outcome", "degree", "field_raw", "profession_raw", "law_firm_raw")], *[known(raw[f]).alias(f) for f in names], raw["timeline"].alias("timeline"))


def violations(text: Column) -> Column:
    """What in a JSON text breaks the contract: unknown keys, values outside their sets, bad dates, negative days, or a decision without outcome."""
    schema = T._parse_datatype_string(EXTRACTED)
    x = parse_extracted(text)
    t = x["timeline"]
    none = F.lit(None).cast("string")
    rule = lambda broken, name: F.when(F.coalesce(broken, F.lit(False)), name).otherwise(none)
    dates = [rule(t[d].isNotNull() & ~(t[d].rlike(DATE) & t[d].try_cast("date").isNotNull()), d) for d in ("receipt_date", "decision_date", "rfe_date", "rfe_response_date")]
    pairs = [f for f in schema.fields if f.name != "timeline" and isinstance(f.dataType, T.StructType)]
    checks = [
        rule(F.json_object_keys(text).isNull(), "not an object"),
        rule(~_allowed_keys(text, None, schema.fieldNames()), "unknown key"),
        rule(~_allowed_keys(text, "$.timeline", schema["timeline"].dataType.fieldNames()), "unknown key in timeline"),
        *[rule(~_allowed_keys(text, f"$.{f.name}", ["value", "known"]), f"unknown key in {f.name}") for f in pairs],
        rule(x["is_niw_i140_decision"].isNull(), "is_niw_i140_decision"),
        rule(~x["outcome"].isin(*OUTCOMES), "outcome"),
        rule(~x["degree"].isin(*DEGREES), "degree"),
        *dates,
        rule(t["processing_days"] < 0, "processing_days"),
        rule(~t["processing_source"].isin(*PROCESSING_SOURCES), "processing_source"),
        rule(x["is_niw_i140_decision"] & x["outcome"].isNull(), "decision without outcome"),
    ]
    return F.array_compact(F.array(*checks))


def contract_schema() -> str:
    """The contract as JSON."""
    return json.dumps(T._parse_datatype_string(EXTRACTED).jsonValue())
