"""The ten keyword families of $jsonSchema, compiled to one two-valued Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths
from ..errors import fail
from ..functions import values as V

#: The keywords.
KEYWORDS = ("type", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum", "enum")


def _count(x: object, word: str) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else fail("VAL_INVALID_SHAPE", f"{word} takes a nonnegative integer")


def _validate(spec: object) -> dict:
    if not isinstance(spec, dict):
        fail("VAL_INVALID_SHAPE", "a schema is an object")
    for word, x in spec.items():
        if word not in KEYWORDS:
            fail("VAL_UNKNOWN_OPERATOR", f"$jsonSchema {word}")
        if word == "required" and not (isinstance(x, list) and all(isinstance(n, str) for n in x) and len(set(x)) == len(x)):
            fail("VAL_INVALID_SHAPE", word)
        if word == "properties":
            if not isinstance(x, dict):
                fail("VAL_INVALID_SHAPE", word)
            for v in x.values():
                _validate(v)
        if word == "items":
            _validate(x)
        if word == "additionalProperties" and not isinstance(x, bool):
            fail("VAL_INVALID_SHAPE", word)
        if word in ("minItems", "maxItems", "minLength", "maxLength"):
            _count(x, word)
        if word in ("minimum", "maximum") and V.literal(x).type not in V.NUMERIC:
            fail("VAL_INVALID_SHAPE", word)
        if word == "enum" and not (isinstance(x, list) and x):
            fail("VAL_INVALID_SHAPE", word)
        if word == "type":
            from .filters import type_names

            type_names(x)
    return spec


def compile_schema(spec: object, schema: T.StructType) -> Column:
    """Whether a row of `schema` satisfies the schema."""
    return _object(_validate(spec), schema, None)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _object(spec: dict, schema: T.StructType, root: Column | None, path: str = "") -> Column:
    """path: where the object stands in the row, with a dot, or None below an array."""
    from .filters import type_names

    def there(name: str) -> Column:
        found = None if path is None else paths.marked(schema[name], path + name)
        return F.lit(True) if found is None else found

    parts = []
    if "type" in spec:
        parts.append(F.lit("object" in type_names(spec["type"])))
    for name in spec.get("required", []):
        parts.append(there(name) if name in schema.names else F.lit(False))
    for name, inner in spec.get("properties", {}).items():
        if name in schema.names:  # a missing property isn't judged
            at = paths.resolve([name], schema, root)
            parts.append(~there(name) | _value(inner, at.value, at.type, None if path is None else f"{path}{name}."))
    if spec.get("additionalProperties") is False:
        parts += [~there(n) for n in schema.names if n not in spec.get("properties", {}) and n != paths.SEEN]
    return _all(parts)


def _value(spec: dict, c: Column, kind: T.DataType, path: str | None) -> Column:
    from .filters import compare, logical_type, member, of_type

    name = logical_type(kind)
    parts = []
    if "type" in spec:
        parts.append(of_type(c, kind, spec["type"]))
    if "enum" in spec:
        parts.append(F.coalesce(member(c, kind, [V.literal(x) for x in spec["enum"]]), F.lit(False)))
    # A keyword judges values of its own type only.
    judged = lambda test: F.coalesce(test, F.lit(True))
    if name in V.NUMERIC:
        parts += [judged(F.when(c.isNotNull(), compare(op, c, kind, V.literal(spec[w])))) for w, op in (("minimum", "$gte"), ("maximum", "$lte")) if w in spec]
    if name == "string":
        n = F.char_length(c)
        parts += [judged(n >= spec["minLength"])] * ("minLength" in spec) + [judged(n <= spec["maxLength"])] * ("maxLength" in spec)
    if name == "array":
        n = F.when(c.isNotNull(), F.size(c))
        parts += [judged(n >= spec["minItems"])] * ("minItems" in spec) + [judged(n <= spec["maxItems"])] * ("maxItems" in spec)
        if "items" in spec:
            parts.append(judged(F.forall(c, lambda x: _value(spec["items"], x, kind.elementType, None))))
    if name == "object" and set(spec) & {"required", "properties", "additionalProperties"}:
        inner = {k: v for k, v in spec.items() if k in ("required", "properties", "additionalProperties")}
        parts.append(F.when(c.isNull(), F.lit(True)).otherwise(_object(inner, kind, c, path)))
    return _all(parts)
