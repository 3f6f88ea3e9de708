"""Checks of JSON against a JSON-schema document, compiled to one column over a VARIANT: each line is parsed once."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that say nothing about what is valid.
_ANNOTATIONS = frozenset(("$schema", "$id", "$comment", "title", "description", "examples", "default", "format"))
_CHECKED = frozenset(("type", "const", "enum", "required", "properties", "additionalProperties", "unevaluatedProperties", "items", "minItems", "minimum", "maximum", "oneOf"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _fault(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(text))).otherwise(_none())


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _of_type(value: Column, name: str) -> Column:
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    whole = (kind == "BIGINT") | (number & (_as(value, "double") == F.floor(_as(value, "double"))))
    tests = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN",
        "null": kind == "VOID", "number": number, "integer": whole,
    }
    return tests[name]


def _equals(value: Column, constant: object) -> Column:
    if constant is None:
        return _of_type(value, "null")
    if isinstance(constant, bool):
        return _of_type(value, "boolean") & (_as(value, "boolean") == constant)
    if isinstance(constant, int | float):
        return _of_type(value, "number") & (_as(value, "double") == float(constant))
    if isinstance(constant, str):
        return _of_type(value, "string") & (_as(value, "string") == constant)
    raise ValueError(f"only plain values can be compared: {constant!r}")


def _property(value: Column, name: str) -> Column:
    if '"' in name or "\\" in name:
        raise ValueError(f"a property's name has no quotes: {name!r}")
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _branches(schema: dict) -> tuple[str, dict[str, dict]]:
    """The property whose constant tells the branches of oneOf apart, and each constant's schema, what stands outside joined to it."""
    branches = schema["oneOf"]
    told = [n for n in branches[0].get("properties", {}) if all("const" in b.get("properties", {}).get(n, {}) for b in branches)]
    if not told:
        raise ValueError("the branches of oneOf must differ by a constant property")
    name, outer = told[0], schema.get("properties", {})
    closed = {"additionalProperties": False} if schema.get("unevaluatedProperties") is False else {}
    merged = {}
    for b in branches:
        required = [*schema.get("required", []), *(r for r in b.get("required", []) if r not in schema.get("required", []))]
        merged[b["properties"][name]["const"]] = {"type": "object", **closed, **b, "properties": outer | b["properties"], "required": required}
    if len(merged) < len(branches):
        raise ValueError("two branches of oneOf have one constant")
    return name, merged


def compiled(schema: dict, value: Column, at: str = "$") -> Column:
    """What is wrong with a VARIANT, as array<string> of "place: fault", empty if it is valid.

    Places are $, names after dots, and [] for any element of an array; a fault is said once of each place.  Known are type, const,
    enum, required, properties, additionalProperties, items, minItems, minimum, maximum, and oneOf over objects that a constant
    property tells apart, closed by unevaluatedProperties; another keyword raises, so nothing goes unchecked in silence.
    A value of the wrong type is said to be so, and what only holds for the right type is not looked at.
    """
    unknown = set(schema) - _ANNOTATIONS - _CHECKED
    if unknown:
        raise ValueError(f"{at}: no rule for {sorted(unknown)}")
    if "oneOf" in schema:
        name, branches = _branches(schema)
        own = _property(value, name)
        lacks = [_fault(_of_type(value, "object") & _property(value, r).isNull(), f"{at}: lacks {r}") for r in schema.get("required", ())]
        unheard = F.when(own.isNull(), _joined(lacks) if lacks else F.array(F.lit(f"{at}: lacks {name}"))).otherwise(F.array(F.lit(f"{at}.{name}: unknown")))
        by_kind = reduce(lambda c, kv: c.when(_equals(own, kv[0]), compiled(kv[1], value, at)), list(branches.items())[1:], F.when(_equals(own, next(iter(branches))), compiled(next(iter(branches.values())), value, at)))
        return F.when(~_of_type(value, "object"), F.array(F.lit(f"{at}: not object"))).otherwise(by_kind.otherwise(unheard))
    parts = []
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if types:
        parts.append(_fault(~reduce(lambda a, b: a | b, (_of_type(value, t) for t in types)), f"{at}: not {' or '.join(types)}"))
    for constants in ([schema["const"]] if "const" in schema else None, schema.get("enum")):
        if constants is not None:
            parts.append(_fault(~reduce(lambda a, b: a | b, (_equals(value, c) for c in constants), F.lit(False)), f"{at}: none of {json.dumps(constants)}"))
    for word, wrong in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b)):
        if word in schema:
            parts.append(_fault(_of_type(value, "number") & wrong(_as(value, "double"), F.lit(float(schema[word]))), f"{at}: {word} {schema[word]}"))
    inner = schema.get("properties", {})
    for name in schema.get("required", ()):
        parts.append(_fault(_of_type(value, "object") & _property(value, name).isNull(), f"{at}: lacks {name}"))
    for name, sub in inner.items():
        own = _property(value, name)
        parts.append(F.when(own.isNull(), _none()).otherwise(compiled(sub, own, f"{at}.{name}")))
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.map_filter(_as(value, "map<string,variant>"), lambda k, _: ~k.isin(*inner)) if inner else _as(value, "map<string,variant>")
        if more is False:
            said = F.transform(F.array_sort(F.map_keys(others)), lambda k: F.concat(F.lit(f"{at}."), k, F.lit(": not allowed")))
        else:
            said = F.flatten(F.transform(F.map_values(others), lambda v: compiled(more, v, f"{at}.*")))
        parts.append(F.when(_of_type(value, "object"), said).otherwise(_none()))
    elements = _as(value, "array<variant>")
    if "items" in schema:
        parts.append(F.when(_of_type(value, "array"), F.array_distinct(F.flatten(F.transform(elements, lambda v: compiled(schema["items"], v, f"{at}[]"))))).otherwise(_none()))
    if "minItems" in schema:
        parts.append(_fault(_of_type(value, "array") & (F.size(elements) < schema["minItems"]), f"{at}: under {schema['minItems']} items"))
    return _joined(parts)


def json_faults(rows: DataFrame, schema: dict, column: str = "line") -> DataFrame:
    """rows without the column, with a row for each fault of its JSON; valid rows, null and blank ones go, and what is no JSON has the one
    fault "not JSON"."""
    keys = [c for c in rows.columns if c != column]
    parsed = rows.where(F.trim(column) != "").select(*keys, F.try_parse_json(column).alias("_value"))
    faults = F.when(F.col("_value").isNull(), F.array(F.lit("not JSON"))).otherwise(compiled(schema, F.col("_value")))
    return parsed.select(*keys, F.explode(faults).alias("fault"))
