"""A compiler of nested JSON Schemas to one column of faults over JSON texts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path:string,rule:string,value:string>>"


def _none() -> Column:
    return F.array().cast(FAULT)


def _fault(bad: Column, path: Column, rule: str, value: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), value.alias("value")))).otherwise(_none())


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(v: Column) -> Column:
    """The JSON type of a value; whole numbers are ``integer``."""
    whole = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))

    def named(s: Column) -> Column:
        plain = F.when(s == "BIGINT", "integer").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        return plain.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.startswith("DECIMAL") & whole, "integer").otherwise("number")

    return _bound(F.schema_of_variant(v), named)


def _named(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    """The schema that a ``$ref`` names, and the names on the way to it."""
    while "$ref" in schema:
        name = schema["$ref"]
        if not name.startswith("#") or name in seen:
            raise ValueError(f"a reference must lie in the schema, and not in itself: {name}")
        seen, target = (*seen, name), root
        for part in name.removeprefix("#").strip("/").split("/") if name != "#" else []:
            target = target[part.replace("~1", "/").replace("~0", "~")]
        schema = target
    return schema, seen


def faults(v: Column, path: Column, schema: dict | bool, root: dict | None = None, seen: tuple[str, ...] = ()) -> Column:
    """What is wrong with a variant, as an array of path, rule and value.

    Rules: ``type`` (one or a list), ``enum``, ``const``, ``minimum``, ``maximum``,
    ``minLength``, ``maxLength``, ``pattern``, ``items``, ``minItems``, ``maxItems``, ``required``,
    ``properties``, ``additionalProperties`` (false or a schema), ``oneOf``, ``anyOf``,
    ``allOf``, and ``$ref`` within the schema; a rule says nothing about values of
    another type than its own.
    """
    if isinstance(schema, bool):
        return _none() if schema else _fault(F.lit(True), path, "false", F.to_json(v))
    root = schema if root is None else root
    schema, seen = _named(schema, root, seen)

    def seen_once(x: Column, kind: Column) -> Column:
        as_kind = lambda t, *kinds: F.when(kind.isin(*kinds), F.try_variant_get(x, "$", t))
        parts = [x.alias("v"), kind.alias("kind"), F.to_json(x).alias("shown"), as_kind("string", "string").alias("text"), as_kind("double", "integer", "number").alias("number"), as_kind("array<variant>", "array").alias("elements"), as_kind("map<string, variant>", "object").alias("members"), path.alias("path")]
        return F.struct(*parts)

    return _bound(v, lambda x: _bound(_kind(x), lambda kind: _bound(seen_once(x, kind), lambda m: _broken(m, schema, root, seen))))


def _broken(m: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
    v, kind, shown, text, number, elements, members, path = (m[c] for c in ("v", "kind", "shown", "text", "number", "elements", "members", "path"))
    out: list[Column] = []
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        out.append(_fault(~kind.isin(*wanted, *(["integer"] if "number" in wanted else [])), path, "type", shown))
    for rule, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            out.append(_fault(~F.coalesce(F.exists(F.array(*[F.lit(json.dumps(a, ensure_ascii=False)) if a is None or isinstance(a, str | bool | int) else F.to_json(F.parse_json(F.lit(json.dumps(a)))) for a in allowed]), lambda a: a == shown), F.lit(False)), path, rule, shown))
    for rule, bad in (
        ("minimum", lambda n: number < n),
        ("maximum", lambda n: number > n),
        ("minLength", lambda n: F.length(text) < n),
        ("maxLength", lambda n: F.length(text) > n),
        ("pattern", lambda p: ~text.rlike(p)),
    ):
        if rule in schema:
            out.append(_fault(bad(schema[rule]), path, rule, shown))
    if "minItems" in schema:
        out.append(_fault(F.size(elements) < schema["minItems"], path, "minItems", shown))
    if "maxItems" in schema:
        out.append(_fault(F.size(elements) > schema["maxItems"], path, "maxItems", shown))
    if "items" in schema:
        each = F.transform(elements, lambda e, i: faults(e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], root, seen))
        out.append(F.coalesce(F.flatten(each), _none()))
    keys = F.map_keys(members)
    below = lambda name: F.concat(path, F.lit("."), name)
    for name in schema.get("required", []):
        out.append(_fault(~F.array_contains(keys, name), below(F.lit(name)), "required", F.lit(None).cast("string")))
    properties = schema.get("properties", {})
    for name, rule in properties.items():
        out.append(F.when(F.coalesce(F.array_contains(keys, name), F.lit(False)), faults(F.element_at(members, name), below(F.lit(name)), rule, root, seen)).otherwise(_none()))
    if "additionalProperties" in schema and schema["additionalProperties"] is not True:
        more = schema["additionalProperties"]
        others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*properties)) if properties else F.map_entries(members)
        if more is False:
            each = F.transform(others, lambda e: F.struct(below(e["key"]).alias("path"), F.lit("additionalProperties").alias("rule"), F.to_json(e["value"]).alias("value")))
        else:
            each = F.flatten(F.transform(others, lambda e: faults(e["value"], below(e["key"]), more, root, seen)))
        out.append(F.coalesce(each, _none()))
    for rule, right in (("oneOf", lambda n: n == 1), ("anyOf", lambda n: n >= 1)):
        if rule in schema:
            good = [(F.size(faults(v, path, branch, root, seen)) == 0).cast("int") for branch in schema[rule]]
            out.append(_fault(~right(sum(good[1:], good[0])), path, rule, shown))
    out += [faults(v, path, branch, root, seen) for branch in schema.get("allOf", [])]
    return F.concat(_none(), *out)


def validate(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """``key``, ``path`` (from ``$``), ``rule`` and ``value`` of every fault of JSON texts; a text that is no JSON has the rule ``json``, a null none."""
    parsed = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), F.try_parse_json(text).alias("_v"))
    found = F.when(F.col("_v").isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.col("_text").alias("value")))).otherwise(faults(F.col("_v"), F.lit("$"), schema))
    return parsed.select(key, F.explode(found).alias("f")).select(key, "f.*")
