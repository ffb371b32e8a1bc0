"""A JSON schema compiled to column expressions over VARIANT values.

Supported keywords: type, required, properties, patternProperties, additionalProperties, items, enum, const, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern, minItems, maxItems, uniqueItems,
allOf, anyOf, oneOf, not, and $ref to a place in the same schema (not to one around itself).  Annotations say nothing
about a value, ``format`` is one of them; any other keyword is an error.  Every error is (depth, path, message); a
record's reported error is its shallowest, first in schema order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATIONS = {
    "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "id", "$comment", "$anchor", "definitions", "$defs",
    "contentEncoding", "contentMediaType",
}
ERROR = "struct<depth:int,path:string,message:string>"
NUMBER_KINDS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def kind_of(node: Column) -> Column:
    """Leading word of the value's type: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def child(node: Column, *names: str) -> Column:
    """The value under a chain of object keys, null when any is absent."""
    steps = "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in names)
    return F.try_variant_get(node, "$" + steps, "variant")


class Node:
    """A value of the record with its type and its number, each computed once where ``columns`` collects them."""

    def __init__(self, value: Column, kind: Column, number: Column):
        self.value, self.kind, self.number = value, kind, number

    @classmethod
    def direct(cls, value: Column) -> "Node":
        kind = kind_of(value)
        return cls(value, kind, as_number(value, kind))


def as_number(value: Column, kind: Column) -> Column:
    return F.when(kind.isin(*NUMBER_KINDS), F.try_variant_get(value, "$", "double"))


def shown(node: Node) -> Column:
    """A value as it appears in messages: text in single quotes, other values as JSON, names of constants as in Python."""
    text = F.try_variant_get(node.value, "$", "string")
    return (
        F.when(node.kind == "STRING", F.concat(F.lit("'"), text, F.lit("'")))
        .when(node.kind == "VOID", F.lit("None"))
        .when(node.kind == "BOOLEAN", F.initcap(text))
        .otherwise(F.to_json(node.value))
    )


def is_type(node: Node, name: str) -> Column:
    tests = {
        "string": node.kind == "STRING",
        "boolean": node.kind == "BOOLEAN",
        "null": node.kind == "VOID",
        "object": node.kind == "OBJECT",
        "array": node.kind == "ARRAY",
        "number": node.kind.isin(*NUMBER_KINDS),
        "integer": F.coalesce(node.number == F.floor(node.number), F.lit(False)),
    }
    if name not in tests:
        raise ValueError(f"unsupported type: {name}")
    return tests[name]


def python_list(values: list) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _empty() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _error(failed: Column, depth: int, path: Column, message: Column) -> Column:
    one = F.array(F.struct(F.lit(depth).alias("depth"), path.alias("path"), message.alias("message")))
    return F.when(F.coalesce(failed, F.lit(False)), one).otherwise(_empty())


def _step(path: Column, depth: int, name: Column) -> Column:
    return F.concat(path, F.lit("/"), name) if depth else name


def _equals(node: Node, v) -> Column:
    """Whether the value is the constant; numbers by value, true and false are no numbers."""
    if v is None:
        return is_type(node, "null")
    if isinstance(v, bool):
        return is_type(node, "boolean") & (F.try_variant_get(node.value, "$", "boolean") == v)
    if isinstance(v, (int, float)):
        return F.coalesce(node.number == F.lit(float(v)), F.lit(False))
    if isinstance(v, str):
        return is_type(node, "string") & (F.try_variant_get(node.value, "$", "string") == v)
    return F.coalesce(F.to_json(node.value) == F.to_json(F.parse_json(F.lit(json.dumps(v)))), F.lit(False))


def _referred(schema: dict | bool, root: dict | bool, seen: tuple[str, ...]) -> tuple[dict | bool, tuple[str, ...]]:
    """The schema that a $ref to a place of the root schema means."""
    place = schema["$ref"]
    if place in seen:
        raise ValueError(f"the schema refers to itself at {place}")
    if not place.startswith("#"):
        raise ValueError(f"unsupported reference: {place}")
    found = root
    for step in place[1:].strip("/").split("/") if place.strip("#/") else []:
        step = step.replace("~1", "/").replace("~0", "~")
        found = found[int(step)] if isinstance(found, list) else found.get(step)
        if found is None:
            raise ValueError(f"the schema has no {place}")
    return found, (*seen, place)


def _keyword_errors(schema: dict | bool, node: Node, path: Column, depth: int, property_node, root: dict | bool, seen: tuple[str, ...] = ()) -> list[Column]:
    """Error arrays of each keyword in schema order; ``property_node(name)`` gives the node of a property."""
    if isinstance(schema, bool):
        return [] if schema else [_error(F.lit(True), depth, path, F.concat(F.lit("False schema does not allow "), shown(node)))]
    parts = []
    is_object, is_array, is_text = (is_type(node, t) for t in ("object", "array", "string"))
    text = F.when(is_text, F.try_variant_get(node.value, "$", "string"))
    values = F.when(is_array, F.try_variant_get(node.value, "$", "array<variant>"))
    same = lambda sub: _all(_keyword_errors(sub, node, path, depth, property_node, root, seen))
    for keyword, rule in schema.items():
        if keyword == "type":
            names = rule if isinstance(rule, list) else [rule]
            ok = F.lit(False)
            for n in names:
                ok = ok | is_type(node, n)
            listed = ", ".join(repr(n) for n in names)
            parts.append(_error(~ok, depth, path, F.concat(shown(node), F.lit(f" is not of type {listed}"))))
        elif keyword == "required":
            for name in rule:
                parts.append(_error(is_object & child(node.value, name).isNull(), depth, path, F.lit(f"{name!r} is a required property")))
        elif keyword in ("minimum", "maximum"):
            low = keyword == "minimum"
            failed = node.number < F.lit(float(rule)) if low else node.number > F.lit(float(rule))
            words = f" is less than the minimum of {rule}" if low else f" is greater than the maximum of {rule}"
            parts.append(_error(failed, depth, path, F.concat(shown(node), F.lit(words))))
        elif keyword in ("exclusiveMinimum", "exclusiveMaximum"):
            low = keyword == "exclusiveMinimum"
            failed = node.number <= F.lit(float(rule)) if low else node.number >= F.lit(float(rule))
            words = f" is less than or equal to the minimum of {rule}" if low else f" is greater than or equal to the maximum of {rule}"
            parts.append(_error(failed, depth, path, F.concat(shown(node), F.lit(words))))
        elif keyword == "multipleOf":
            times = node.number / F.lit(float(rule))
            parts.append(_error(F.abs(times - F.round(times)) > 1e-9, depth, path, F.concat(shown(node), F.lit(f" is not a multiple of {rule}"))))
        elif keyword in ("minLength", "maxLength", "minItems", "maxItems"):
            size = F.length(text) if keyword.endswith("Length") else F.size(values)
            short = keyword.startswith("min")
            failed = (size < rule if short else size > rule) & (is_text if keyword.endswith("Length") else is_array)
            parts.append(_error(failed, depth, path, F.concat(shown(node), F.lit(" is too short" if short else " is too long"))))
        elif keyword == "pattern":
            parts.append(_error(~text.rlike(rule), depth, path, F.concat(shown(node), F.lit(f" does not match {rule!r}"))))
        elif keyword == "uniqueItems":
            kinds = F.transform(values, lambda x: F.to_json(x))
            failed = is_array & (F.size(F.array_distinct(kinds)) < F.size(kinds)) if rule else F.lit(False)
            parts.append(_error(failed, depth, path, F.concat(shown(node), F.lit(" has non-unique elements"))))
        elif keyword == "const":
            parts.append(_error(~_equals(node, rule), depth, path, F.lit(f"{rule!r} was expected")))
        elif keyword == "enum":
            allowed = F.lit(False)
            for v in rule:
                allowed = allowed | _equals(node, v)
            parts.append(_error(~allowed, depth, path, F.concat(shown(node), F.lit(f" is not one of {python_list(rule)}"))))
        elif keyword == "allOf":
            parts += [same(sub) for sub in rule]
        elif keyword in ("anyOf", "oneOf"):
            good = sum((F.when(F.size(same(sub)) == 0, F.lit(1)).otherwise(F.lit(0)) for sub in rule), F.lit(0))
            parts.append(_error(good == 0, depth, path, F.concat(shown(node), F.lit(" is not valid under any of the given schemas"))))
            if keyword == "oneOf":
                parts.append(_error(good > 1, depth, path, F.concat(shown(node), F.lit(" is valid under more than one of the given schemas"))))
        elif keyword == "not":
            parts.append(_error(F.size(same(rule)) == 0, depth, path, F.concat(shown(node), F.lit(f" should not be valid under {rule!r}"))))
        elif keyword == "$ref":
            found, into = _referred(schema, root, seen)
            parts += _keyword_errors(found, node, path, depth, property_node, root, into)
        elif keyword == "additionalProperties":
            named = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
            entries = F.map_entries(F.when(is_object, F.try_variant_get(node.value, "$", "map<string,variant>")))
            other = F.filter(entries, lambda e: ~F.array_contains(named, e["key"]))
            patterns = "|".join(f"(?:{x})" for x in schema.get("patternProperties", {}))
            if patterns:
                other = F.filter(other, lambda e: ~e["key"].rlike(patterns))
            if rule is False:
                names = F.transform(other, lambda e: F.concat(F.lit("'"), e["key"], F.lit("'")))
                were = F.when(F.size(names) == 1, F.lit(" was unexpected)")).otherwise(F.lit(" were unexpected)"))
                message = F.concat(F.lit("Additional properties are not allowed ("), F.array_join(names, ", "), were)
                parts.append(_error(is_object & (F.size(names) > 0), depth, path, message))
            elif rule is not True:
                found = F.flatten(F.transform(other, lambda e: _direct_errors(rule, e["value"], _step(path, depth, e["key"]), depth + 1, root, seen)))
                parts.append(F.coalesce(found, _empty()))
        elif keyword == "properties":
            for name, sub in rule.items():
                part, inner = property_node(name)
                found = _all(_keyword_errors(sub, part, _step(path, depth, F.lit(name)), depth + 1, inner, root, seen))
                parts.append(F.when(is_object & part.value.isNotNull(), found).otherwise(_empty()))
        elif keyword == "items":
            found = F.flatten(F.transform(values, lambda x, i: _direct_errors(rule, x, _step(path, depth, i.cast("string")), depth + 1, root, seen)))
            parts.append(F.coalesce(found, _empty()))
        elif keyword == "patternProperties":
            for pattern, sub in rule.items():
                entries = F.map_entries(F.when(is_object, F.try_variant_get(node.value, "$", "map<string,variant>")))
                matching = F.filter(entries, lambda e: e["key"].rlike(pattern))
                found = F.flatten(F.transform(matching, lambda e: _direct_errors(sub, e["value"], _step(path, depth, e["key"]), depth + 1, root, seen)))
                parts.append(F.coalesce(found, _empty()))
        elif keyword not in ANNOTATIONS:
            raise ValueError(f"unsupported schema keyword: {keyword}")
    return parts


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _empty()


def _direct_errors(schema: dict | bool, value: Column, path: Column, depth: int, root: dict | bool, seen: tuple[str, ...] = ()) -> Column:
    """Errors of a value inside a list or map, where its node cannot be a column of its own."""

    def lookup(value: Column):
        def one(name: str):
            part = child(value, name)
            return Node.direct(part), lookup(part)

        return one

    return _all(_keyword_errors(schema, Node.direct(value), path, depth, lookup(value), root, seen))


def with_errors(df: DataFrame, value: str, schema: dict, output: str = "errors") -> DataFrame:
    """Add ``output``: array<struct<depth, path, message>> of every violation of the VARIANT column ``value``.

    Every fixed path of the schema is read from the record once, as a helper column.
    """
    paths: dict[tuple[str, ...], str] = {}

    def node(path: tuple[str, ...]) -> Node:
        alias = paths.setdefault(path, f"_n{len(paths)}")
        return Node(F.col(alias), F.col(f"{alias}_kind"), F.col(f"{alias}_number"))

    def lookup(path: tuple[str, ...]):
        return lambda name: (node((*path, name)), lookup((*path, name)))

    errors = _all(_keyword_errors(schema, node(()), F.lit(""), 0, lookup(()), schema))
    root = F.col(value)
    kept = df.columns
    read = df.withColumns({alias: child(root, *path) if path else root for path, alias in paths.items()})
    read = read.withColumns({f"{alias}_kind": kind_of(F.col(alias)) for alias in paths.values()})
    read = read.withColumns({f"{alias}_number": as_number(F.col(alias), F.col(f"{alias}_kind")) for alias in paths.values()})
    return read.select(*[F.col(f"`{c}`") for c in kept], errors.alias(output))


def first_error(errors: Column) -> Column:
    """Shallowest error, first in order, as text; null without errors."""
    ranked = F.transform(errors, lambda e, i: F.struct(e["depth"].alias("depth"), i.alias("i"), e["path"].alias("path"), e["message"].alias("message")))
    best = F.array_min(ranked)
    placed = F.concat(F.lit("Validation error at path '"), best["path"], F.lit("': "), best["message"])
    return F.when(best["depth"] > 0, placed).otherwise(best["message"])
