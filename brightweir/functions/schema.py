"""JSON schemas compiled to columns: what is wrong with a VARIANT value, as an array of (path, code).

Understood are type (one or several), enum, const, pattern, minLength, maxLength, minimum, maximum, required, properties,
additionalProperties (false), items, minItems, maxItems, uniqueItems and $ref into the same document's $defs. A keyword that
isn't is an error when the schema is compiled, not a check that is left out. Paths are as in $.a.b[2]; codes are the keywords.
Order: the value's own faults, then those of its properties as the schema lists them, then those of its items.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULT = "array<struct<path: string, code: string>>"
KNOWN = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "$ref", "$defs", "$schema", "$id", "title", "description", "default"}


def kind(v: Column) -> Column:
    """JSON type of a VARIANT: null, boolean, string, integer, number, array or object. Whole numbers are integers however written."""
    return F.transform(F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("name"))), lambda x: _kind(x["v"], x["name"]))[0]


def _kind(v: Column, name: Column) -> Column:
    whole = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name == "BIGINT", "integer")
        .when(name.rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.when(whole, "integer").otherwise("number")).when(name.startswith("ARRAY"), "array").otherwise("object")
    )


def faults(value: Column, schema: dict) -> Column:
    """Faults of a VARIANT column; a null column (no value at all) has none."""
    return F.when(value.isNull(), F.lit(None).cast(FAULT)).otherwise(_faults(value, F.lit("$"), schema, schema.get("$defs", {}), 0))


def _faults(v: Column, path: Column, schema: dict, defs: dict, depth: int) -> Column:
    if depth > 32:
        raise ValueError("the schema refers to itself")
    if "$ref" in schema:
        return _faults(v, path, defs[schema["$ref"].removeprefix("#/$defs/")], defs, depth + 1)
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"not understood: {sorted(unknown)}")
    # What a value is and holds is looked up once: the array's element is bound, not copied.
    def opened(x: Column) -> Column:
        v, k = x["v"], x["k"]
        text = F.when(k == "string", F.try_variant_get(v, "$", "string"))
        number = F.when(k.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        fields = F.when(k == "object", F.try_variant_get(v, "$", "map<string,variant>"))
        parts = F.when(k == "array", F.try_variant_get(v, "$", "array<variant>"))
        return F.struct(v.alias("v"), k.alias("k"), x["p"].alias("p"), text.alias("text"), number.alias("number"), fields.alias("fields"), parts.alias("parts"))

    one = F.transform(F.array(F.struct(v.alias("v"), kind(v).alias("k"), path.alias("p"))), opened)
    return F.transform(one, lambda x: _own(x, schema, defs, depth))[0]


def _own(x: Column, schema: dict, defs: dict, depth: int) -> Column:
    v, k, path, text, number, fields, parts = (x[c] for c in ("v", "k", "p", "text", "number", "fields", "parts"))
    is_text, is_number = k == "string", k.isin("integer", "number")
    literal = F.when(is_text, F.to_json(F.array(text))).otherwise(F.concat(F.lit("["), F.to_json(v), F.lit("]")))
    out = []

    def fault(when: Column, code: str, at: Column = path) -> None:
        out.append(F.when(when, F.struct(at.alias("path"), F.lit(code).alias("code"))))

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fault(~k.isin(*kinds, *(["integer"] if "number" in kinds else [])), "type")
    for key in ("enum", "const"):
        if key in schema:
            allowed = schema[key] if key == "enum" else [schema[key]]
            fault(~literal.isin(*[json.dumps([a], ensure_ascii=False, separators=(",", ":")) for a in allowed]), key)
    if "pattern" in schema:
        fault(is_text & ~text.rlike(schema["pattern"]), "pattern")
    if "minLength" in schema:
        fault(is_text & (F.char_length(text) < schema["minLength"]), "minLength")
    if "maxLength" in schema:
        fault(is_text & (F.char_length(text) > schema["maxLength"]), "maxLength")
    if "minimum" in schema:
        fault(is_number & (number < schema["minimum"]), "minimum")
    if "maximum" in schema:
        fault(is_number & (number > schema["maximum"]), "maximum")
    has = lambda name: F.coalesce(F.map_contains_key(fields, name), F.lit(False))
    for name in schema.get("required", []):
        fault((k == "object") & ~has(name), "required", F.concat(path, F.lit(f".{name}")))
    size = F.coalesce(F.size(parts), F.lit(0))
    if "minItems" in schema:
        fault((k == "array") & (size < schema["minItems"]), "minItems")
    if "maxItems" in schema:
        fault((k == "array") & (size > schema["maxItems"]), "maxItems")
    if schema.get("uniqueItems"):
        fault((k == "array") & (F.size(F.array_distinct(F.transform(parts, lambda x: F.to_json(x)))) < size), "uniqueItems")
    found = [F.array_compact(F.array(*out)).cast(FAULT) if out else F.array().cast(FAULT)]
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {}))
        more = F.array_sort(F.filter(F.map_keys(fields), lambda n: ~n.isin(*known) if known else F.lit(True)))
        found.append(F.transform(more, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("additionalProperties").alias("code"))))
    for name, one in schema.get("properties", {}).items():
        inner = _faults(F.try_element_at(fields, F.lit(name)), F.concat(path, F.lit(f".{name}")), one, defs, depth + 1)
        found.append(F.when(has(name), inner))
    if "items" in schema:
        found.append(F.flatten(F.transform(parts, lambda x, i: _faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], defs, depth + 1))))
    return F.concat(*[F.coalesce(f, F.array().cast(FAULT)) for f in found])
