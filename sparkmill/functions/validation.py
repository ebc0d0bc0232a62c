"""JSON Schema compiled into one Spark expression over a variant: the first rule that a value breaks.

Rules: type (one or a list), enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
maxLength, pattern, required, properties, additionalProperties false, items, minItems, maxItems, uniqueItems, minProperties,
maxProperties, allOf, anyOf, oneOf, not. A schema that holds a rule of `schemas` (local references, also recursive ones,
patternProperties, if and others) is checked value by value, in Arrow batches; one with any other rule is refused when it
is compiled. The result is null for a valid value, else a struct of instance_path and schema_path; values never appear
in it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmill.functions import schemas
from sparkmill.functions.schemas import SchemaError

_KNOWN = set("type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required properties additionalProperties items minItems maxItems allOf anyOf oneOf uniqueItems minProperties maxProperties not".split())
_NOTES = {"$schema", "$id", "title", "description", "default", "examples"}


def _is(v: Column, name: str) -> Column:
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    whole = F.try_variant_get(v, "$", "double")
    found = {
        "null": kind == "VOID", "boolean": kind == "BOOLEAN", "string": kind == "STRING", "number": number,
        "integer": number & (whole == F.floor(whole)), "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }
    if name not in found:
        raise SchemaError(f"unknown type {name}")
    return found[name]


def _canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _broken(at: Column, rule: str) -> Column:
    return F.struct(at.alias("instance_path"), F.lit(rule).alias("schema_path"))


def _rules(schema: object, v: Column, at: Column, path: str) -> list[Column]:
    if schema is True:
        return []
    if schema is False:
        return [_broken(at, path or "/")]
    if not isinstance(schema, dict):
        raise SchemaError(f"{path or '/'} is not a schema")
    if odd := set(schema) - _KNOWN - _NOTES:
        raise SchemaError(f"{path}/{sorted(odd)[0]} is not supported")
    out: list[Column] = []

    def need(rule: str, applies: Column, holds: Column) -> None:
        out.append(F.when(applies & ~F.coalesce(holds, F.lit(False)), _broken(at, f"{path}/{rule}")))

    always, x, s = F.lit(True), F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        holds = _is(v, names[0])
        for n in names[1:]:
            holds = holds | _is(v, n)
        need("type", always, holds)
    for rule, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            need(rule, always, F.to_json(v).isin(*[_canonical(a) for a in allowed]))
    for rule, holds in {"minimum": x.__ge__, "maximum": x.__le__, "exclusiveMinimum": x.__gt__, "exclusiveMaximum": x.__lt__}.items():
        if rule in schema:
            need(rule, _is(v, "number"), holds(F.lit(float(schema[rule]))))
    if "multipleOf" in schema:
        q = x / F.lit(float(schema["multipleOf"]))
        need("multipleOf", _is(v, "number"), q == F.floor(q))
    if "minLength" in schema:
        need("minLength", _is(v, "string"), F.length(s) >= schema["minLength"])
    if "maxLength" in schema:
        need("maxLength", _is(v, "string"), F.length(s) <= schema["maxLength"])
    if "pattern" in schema:
        need("pattern", _is(v, "string"), s.rlike(schema["pattern"]))
    child = lambda n: F.try_variant_get(v, "$['" + n.replace("'", "\\'") + "']", "variant")
    for n in schema.get("required", []):
        need("required", _is(v, "object"), child(n).isNotNull())
    for n, sub in schema.get("properties", {}).items():
        for r in _rules(sub, child(n), F.concat(at, F.lit("/" + n)), f"{path}/properties/{n}"):
            out.append(F.when(child(n).isNotNull(), r))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        need("additionalProperties", _is(v, "object"), F.size(F.array_except(keys, known)) == 0)
    elif schema.get("additionalProperties") not in (None, True):
        raise SchemaError(f"{path}/additionalProperties takes true or false")
    items = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in schema:
        need("minItems", _is(v, "array"), F.size(items) >= schema["minItems"])
    if "maxItems" in schema:
        need("maxItems", _is(v, "array"), F.size(items) <= schema["maxItems"])
    if "items" in schema and schema["items"] is not True:
        each = F.transform(items, lambda e, i: _first(_rules(schema["items"], e, F.concat(at, F.lit("/"), i.cast("string")), f"{path}/items")))
        out.append(F.when(_is(v, "array"), F.get(F.filter(each, lambda b: b.isNotNull()), F.lit(0))))
    for k, sub in enumerate(schema.get("allOf", [])):
        out += _rules(sub, v, at, f"{path}/allOf/{k}")
    if schema.get("anyOf"):
        holds = F.lit(False)
        for k, sub in enumerate(schema["anyOf"]):
            holds = holds | _first(_rules(sub, v, at, f"{path}/anyOf/{k}")).isNull()
        need("anyOf", always, holds)
    if schema.get("oneOf"):
        hits = F.lit(0)
        for k, sub in enumerate(schema["oneOf"]):
            hits = hits + _first(_rules(sub, v, at, f"{path}/oneOf/{k}")).isNull().cast("int")
        need("oneOf", always, hits == 1)
    if schema.get("uniqueItems") is True:
        need("uniqueItems", _is(v, "array"), F.size(items) == F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))))
    count = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    if "minProperties" in schema:
        need("minProperties", _is(v, "object"), count >= schema["minProperties"])
    if "maxProperties" in schema:
        need("maxProperties", _is(v, "object"), count <= schema["maxProperties"])
    if "not" in schema:
        need("not", always, _first(_rules(schema["not"], v, at, f"{path}/not")).isNotNull())
    return out


_NOTHING = "struct<instance_path:string,schema_path:string>"


def _first(rules: list[Column]) -> Column:
    return F.coalesce(*rules).cast(_NOTHING) if rules else F.lit(None).cast(_NOTHING)


def broken(schema: object, value: object) -> tuple[str, str] | None:
    """The first rule that a value of this process breaks: (instance_path, schema_path)."""
    return schemas.Checker(schema).first(value)


def _checked(schema: object, value: Column) -> Column:
    """The rules of `schemas`, over the texts of values."""

    def run(texts: pd.Series) -> pd.DataFrame:
        checker = schemas.Checker(schema)
        found = [None if t is None else checker.first(schemas.parsed(t)) for t in texts]
        return pd.DataFrame({"instance_path": [f and f[0] for f in found], "schema_path": [f and f[1] for f in found]})

    got = F.pandas_udf(run, _NOTHING)(F.to_json(value))
    return F.when(got.getField("schema_path").isNotNull(), got)


def compile_schema(schema: object, value: Column) -> Column:
    """Null where `value` is valid, else {instance_path, schema_path} of the first broken rule."""
    if schemas.rules_of(schema):
        check_schema(schema)
        return _checked(schema, value)
    return _first(_rules(schema, value, F.lit(""), ""))


def check_schema(schema: object, path: str = "", root: object = None) -> None:
    """SchemaError where a schema holds a rule that is not known, or a reference that names no schema; names of properties
    and values are free."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise SchemaError(f"{path or '/'} is not a schema")
    if odd := set(schema) - _KNOWN - _NOTES - schemas.RULES:
        raise SchemaError(f"{path}/{sorted(odd)[0]} is not supported")
    if "$ref" in schema and not isinstance(schemas.resolved(root, schema["$ref"]), (bool, dict)):
        raise SchemaError(f"{path}/$ref names no schema")
    for at, sub in schemas.each(schema):
        check_schema(sub, path + at, root)
