"""Dotted paths, resolved against a schema to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import limits
from .errors import fail

INDEX = re.compile(r"0|[1-9][0-9]*")

#: A collection's column that lists, for a row, the declared fields that it lacks ("-path") and those created later that it has
#: ("+path"); and the key of a field's metadata that says which of the two is asked.
SEEN, PRESENCE = "__seen", "presence"


def seen() -> Column:
    return F.coalesce(F.col(SEEN), F.array().cast("array<string>"))


def marked(field: T.StructField, path: str) -> Column | None:
    """Whether a row has a field, or None if every row has it wherever its object is there."""
    sign = field.metadata.get(PRESENCE)
    if not sign:
        return None
    said = F.array_contains(seen(), sign + path)
    return said if sign == "+" else ~said


def parse(path: object) -> list[str]:
    if not isinstance(path, str) or not path:
        fail("VAL_INVALID_PATH", repr(path))
    limits.check("path.utf8_bytes", len(path.encode()))
    parts = path.split(".")
    limits.check("path.segments", len(parts))
    for p in parts:
        if not p or p.startswith("$") or any(ord(c) < 32 or ord(c) == 127 for c in p):
            fail("VAL_INVALID_PATH", path)
        limits.check("field_name.scalars", len(p))
    return parts


@dataclass
class Resolved:
    """Where a path leads in a row. always: `present` holds in every row. one: at most one candidate, `value`, there if `present`; else `value` is the array of candidates."""

    type: T.DataType | None
    value: Column | None
    present: Column
    one: bool = True
    always: bool = False
    path: str | None = None

    @property
    def absent(self) -> bool:
        return self.value is None


def nowhere() -> Resolved:
    return Resolved(None, None, F.lit(False))


def _position(part: str) -> int:
    n = int(part)
    return n if n < 2**31 - 1 else fail("VAL_INVALID_PATH", "index too large")


def resolve(parts: list[str], schema: T.StructType, root: Column | None = None) -> Resolved:
    """Names step into objects; on arrays an index takes an element and a name visits the immediate objects.

    A field that the schema declares is present wherever its parent is, unless
    its metadata says that rows may lack it (SEEN): NULL is an explicit null.
    Undeclared fields are missing. root: a struct column to start from instead
    of the row.
    """
    if parts[0] not in schema.names:
        return nowhere()
    field = schema[parts[0]]
    value = F.col(f"`{parts[0]}`") if root is None else root.getField(parts[0])
    there = marked(field, parts[0]) if root is None else None
    present = root.isNotNull() if root is not None else F.lit(True) if there is None else there
    here = Resolved(field.dataType, value, present, always=root is None and there is None, path=parts[0] if root is None else None)
    for part in parts[1:]:
        here = _step(here, part)
        if here.absent:
            break
    return here


def _step(at: Resolved, part: str) -> Resolved:
    if isinstance(at.type, T.StructType):
        if part not in at.type.names:
            return nowhere()
        kind = at.type[part].dataType
        if at.one:
            path = None if at.path is None else f"{at.path}.{part}"
            there = None if path is None else marked(at.type[part], path)
            present = at.present & at.value.isNotNull()
            return Resolved(kind, at.value.getField(part), present if there is None else present & there, path=path)
        return Resolved(kind, F.transform(F.filter(at.value, lambda x: x.isNotNull()), lambda x: x.getField(part)), at.present, False)
    if not isinstance(at.type, T.ArrayType):
        return nowhere()
    element = at.type.elementType
    if INDEX.fullmatch(part):
        k = _position(part)
        if at.one:
            return Resolved(element, F.get(at.value, F.lit(k)), at.present & F.coalesce(F.size(at.value) > k, F.lit(False)))
        held = F.filter(at.value, lambda x: F.coalesce(F.size(x) > k, F.lit(False)))
        return Resolved(element, F.transform(held, lambda x: F.get(x, F.lit(k))), at.present, False)
    if not isinstance(element, T.StructType) or part not in element.names:
        return nowhere()
    visit = lambda a: F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: x.getField(part))
    if at.one:
        cands = F.when(at.present & at.value.isNotNull(), visit(at.value)).otherwise(F.array().cast(T.ArrayType(element[part].dataType)))
    else:
        cands = F.flatten(F.transform(F.filter(at.value, lambda x: x.isNotNull()), visit))
    cands = F.when(F.size(cands) > limits.LIMITS["path.candidates"], F.raise_error(F.lit("QUOTA_LIMIT_EXCEEDED")).cast(T.ArrayType(element[part].dataType))).otherwise(cands)
    return Resolved(element[part].dataType, cands, F.lit(True), False)
