"""Filters: a JSON filter is validated as a whole, then compiled to one two-valued Column.

Equality compiles to eqNullSafe and ranges to plain comparisons with literals of
the column's own type, so that Parquet scans get them as pushed filters.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits, paths
from ..errors import fail
from ..functions import decimals
from ..functions import values as V
from . import regex, vectors

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
LOGICAL = ("$and", "$or", "$nor", "$not")
#: Type names and aliases that $type accepts.
TYPE_NAMES = {
    "null": ("null",), "bool": ("bool",), "int32": ("int32",), "int64": ("int64",), "float64": ("float64",), "decimal128": ("decimal128",),
    "string": ("string",), "binary": ("binary",), "object": ("object",), "array": ("array",), "timestamp": ("timestamp",), "date": ("date",),
    "uuid": ("uuid",), "objectId": ("objectId",), "vector_f16": ("vector_f16",), "vector_f32": ("vector_f32",),
    "number": ("int32", "int64", "float64", "decimal128"), "integer": ("int32", "int64"), "vector": ("vector_f16", "vector_f32"),
}


def logical_type(kind: T.DataType) -> str:
    """The logical type of a typed column's values."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int32"
    if isinstance(kind, T.LongType):
        return "int64"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float64"
    if isinstance(kind, T.DecimalType):
        return "decimal128"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.StructType):
        return "decimal128" if decimals.is_general(kind) else "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    return "null"


@dataclass
class Context:
    """What a filter is bound to. now: the pinned time for expiry; ttl: the collection's expiry path; vector_path: set where top-k is allowed."""

    schema: T.StructType
    now: dt.datetime | None = None
    ttl: str | None = None


@dataclass
class TopK:
    path: str
    vector: tuple[float, ...]
    metric: str
    k: int
    threshold: float | None = None
    inclusive: bool = True


# -- literals against typed columns --------------------------------------------


def _bound(kind: T.DataType, x: Fraction) -> tuple[object, bool] | None:
    """The greatest value of the column's type at or below x, and whether it is x; None if there is none."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        f = float(x) if abs(x) < Fraction(2) ** 1024 else math.copysign(math.inf, x)
        if math.isinf(f) or Fraction(f) > x:
            f = math.nextafter(f, -math.inf)
        return f, Fraction(f) == x
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    n = math.floor(x * 10**scale)
    if isinstance(kind, T.DecimalType):
        top = 10**kind.precision - 1
        if n < -top:
            return None
        exact = n <= top and Fraction(n, 10**scale) == x
        n = min(n, top)
        return Decimal((int(n < 0), tuple(map(int, str(abs(n)))), -scale)), exact  # whatever the context's precision
    if n < -(2**63):
        return None
    return min(n, 2**63 - 1), n < 2**63 and n == x


def _numeric(op: str, c: Column, kind: T.DataType, lit: V.Value) -> Column:
    """A comparison in the exact numeric domain: the literal is moved to the column's type, never the column."""
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    c = c.cast("double") if isinstance(kind, T.FloatType) else c
    x = V.exact(lit)
    if isinstance(x, float):  # NaN, which equals itself and is the greatest, or an infinity
        if floating:
            return _plain(op, c, F.lit(x))
        above = x != x or x > 0
        return {"$eq": F.lit(False), "$lt": c.isNotNull() if above else F.lit(False), "$lte": c.isNotNull() if above else F.lit(False), "$gt": F.lit(False) if above else c.isNotNull(), "$gte": F.lit(False) if above else c.isNotNull()}[op]
    if decimals.is_general(kind):
        rank, coefficient, exact = decimals.parts(x)
        b = decimals.literal(rank, coefficient)
        return _plain(op, c, b) if exact else {"$eq": F.lit(False), "$gt": c > b, "$gte": c > b, "$lt": c <= b, "$lte": c <= b}[op]
    below = _bound(kind if not isinstance(kind, T.FloatType) else T.DoubleType(), x)
    if below is None:
        return c.isNotNull() if op in ("$gt", "$gte") else F.lit(False)
    b, exact = F.lit(below[0]), below[1]
    if isinstance(kind, T.DecimalType):
        b = b.cast(kind)
    if exact:
        return _plain(op, c, b)
    return {"$eq": F.lit(False), "$gt": c > b, "$gte": c > b, "$lt": c <= b, "$lte": c <= b}[op]


def _plain(op: str, c: Column, x: Column) -> Column:
    return {"$eq": c.eqNullSafe(x), "$gt": c > x, "$gte": c >= x, "$lt": c < x, "$lte": c <= x}[op]


def literal_column(kind: T.DataType, lit: V.Value) -> Column | None:
    """The literal as a value of the column's type, or None if it can't be equal to one."""
    if lit.type == "null":
        return F.lit(None).cast(kind)
    name = logical_type(kind)
    if name in V.NUMERIC and lit.type in V.NUMERIC:
        x = V.exact(lit)
        if isinstance(x, float):
            return F.lit(x).cast(kind) if name == "float64" else None
        if decimals.is_general(kind):
            rank, coefficient, exact = decimals.parts(x)
            return decimals.literal(rank, coefficient) if exact else None
        b = _bound(kind, x)
        return F.lit(b[0]).cast(kind) if b and b[1] else None
    if name == "array" and (lit.type == "array" or lit.type.startswith("vector")):
        parts = lit.value if lit.type == "array" else [V.Value("float64", x) for x in lit.value]
        each = [literal_column(kind.elementType, x) for x in parts]
        return None if any(x is None for x in each) else (F.array(*each) if each else F.array()).cast(kind)
    if name == "object" and lit.type == "object":
        if set(kind.names) != set(lit.value):
            return None
        each = {f.name: literal_column(f.dataType, lit.value[f.name]) for f in kind}
        return None if any(x is None for x in each.values()) else F.struct(*(each[n].alias(n) for n in kind.names))
    if name != lit.type:
        return None
    if name == "timestamp":
        t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=lit.value)
        return F.lit(t.isoformat(sep=" ") + ("" if isinstance(kind, T.TimestampNTZType) else "+00:00")).cast(kind)
    if name == "date":
        return F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=lit.value))
    if name == "binary":
        return F.lit(lit.value[1]) if lit.value[0] == 0 else None
    return F.lit(lit.value)


def compare(op: str, c: Column, kind: T.DataType, lit: V.Value) -> Column:
    """c op literal on one candidate; false where c is null, unless the literal is, and across types."""
    name = logical_type(kind)
    if lit.type == "null":
        return c.isNull() if op == "$eq" else F.lit(False)  # ranges never match null
    if name in V.NUMERIC:
        return _numeric(op, c, kind, lit) if lit.type in V.NUMERIC else F.lit(False)
    other = literal_column(kind, lit)
    if other is None:
        if name == "array" and lit.type == "array" and op != "$eq":
            fail("VAL_UNSUPPORTED_COMBINATION", "a range over an array needs literals of the elements' type")
        return F.lit(False)
    if name == "object" and op != "$eq":
        fail("VAL_UNSUPPORTED_COMBINATION", "ranges over objects")
    return _plain(op, c, other)


# -- predicates ----------------------------------------------------------------


def any_candidate(at: paths.Resolved, test, top: bool) -> Column:
    """Some candidate passes. top: a filter drops nulls by itself, so nothing has to be coalesced and the scan sees the bare test."""
    if at.absent:
        return F.lit(False)
    if not at.one:
        return F.coalesce(F.exists(at.value, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    out = test(at.value)
    if not at.always:
        out = at.present & out
    return out if top else F.coalesce(out, F.lit(False))


def compile_filter(spec: object, ctx: Context, top: bool = True, root: Column | None = None, schema: T.StructType | None = None) -> Column:
    """The whole filter; every part is validated even if another decides."""
    if not isinstance(spec, dict):
        fail("VAL_INVALID_SHAPE", "a filter is an object")
    schema = schema or ctx.schema
    parts = []
    for key, operand in spec.items():
        if key in LOGICAL:
            parts.append(_logical(key, operand, ctx, root, schema, top))
        elif key in ("$expiresBefore", "$expiresAfter", "$ttl"):
            parts.append(_expiry(key, operand, ctx))
        elif key == "$jsonSchema":
            from .jsonschema import compile_schema

            parts.append(compile_schema(operand, schema))
        elif key.startswith("$"):
            fail("VAL_UNKNOWN_OPERATOR", key)
        else:
            parts.append(_field(key, operand, ctx, root, schema, top))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _logical(op: str, operand: object, ctx: Context, root, schema, top: bool) -> Column:
    if op == "$not":
        return ~compile_filter(operand, ctx, False, root, schema)
    if not isinstance(operand, list):
        fail("VAL_INVALID_SHAPE", f"{op} takes an array")
    bare = top and op == "$and"
    each = [compile_filter(x, ctx, bare, root, schema) for x in operand]
    if op == "$and":
        return reduce(lambda a, b: a & b, each) if each else F.lit(True)
    either = reduce(lambda a, b: a | b, each) if each else F.lit(False)
    return either if op == "$or" else ~either


def _is_operators(operand: object) -> bool:
    if not isinstance(operand, dict) or not operand or set(operand) == {"$value"}:
        return False
    named = [k.startswith("$") for k in operand]
    if any(named) and not all(named):
        fail("VAL_INVALID_SHAPE", "operators and fields together")
    return all(named)


def _field(path: str, operand: object, ctx: Context, root, schema, top: bool) -> Column:
    at = paths.resolve(paths.parse(path), schema, root)
    if not _is_operators(operand):
        operand = {"$eq": operand}
    return reduce(lambda a, b: a & b, [_operator(op, x, at, path, ctx, top) for op, x in operand.items()])


def literals(operand: object, op: str) -> list[V.Value]:
    if not isinstance(operand, list):
        fail("VAL_INVALID_SHAPE", f"{op} takes an array")
    limits.check("literal_list.items", len(operand))
    return [V.literal(x) for x in operand]


def _operator(op: str, operand: object, at: paths.Resolved, path: str, ctx: Context, top: bool) -> Column:
    some = lambda test: any_candidate(at, test, top)
    if op in COMPARISONS:
        lit = V.literal(operand)
        if op == "$ne":
            return ~any_candidate(at, lambda c: compare("$eq", c, at.type, lit), at.always)
        return some(lambda c: compare(op, c, at.type, lit))
    if op in ("$in", "$nin"):
        items = literals(operand, op)
        found = any_candidate(at, lambda c: member(c, at.type, items), top and op == "$in")
        return found if op == "$in" else ~F.coalesce(found, F.lit(False))
    if op == "$not":
        if not _is_operators(operand):
            fail("VAL_INVALID_SHAPE", "$not takes operators")
        return ~reduce(lambda a, b: a & b, [_operator(o, x, at, path, ctx, False) for o, x in operand.items()])
    if op == "$exists":
        if not isinstance(operand, bool):
            fail("VAL_INVALID_SHAPE", "$exists takes a Boolean")
        there = F.lit(False) if at.absent else (at.present if at.one else F.size(at.value) > 0)
        there = F.coalesce(there, F.lit(False))
        return there if operand else ~there
    if op == "$type":
        return some(lambda c: of_type(c, at.type, operand)) if not at.absent else (type_names(operand) and F.lit(False))
    if op == "$size":
        n = V.literal(operand)
        if n.type not in ("int32", "int64") or n.value < 0:
            fail("VAL_INVALID_SHAPE", "$size takes a nonnegative integer")
        limits.check("array.elements", n.value)
        return some(lambda c: (F.size(c) == n.value) & c.isNotNull() if isinstance(at.type, T.ArrayType) else F.lit(False))
    if op == "$all":
        items = literals(operand, op)

        def contains_all(c: Column) -> Column:
            if not isinstance(at.type, T.ArrayType):
                return F.lit(False)
            holds = lambda v: F.exists(c, lambda x: F.coalesce(compare("$eq", x, at.type.elementType, v), F.lit(False)))
            each = [holds(v) for v in items]
            return reduce(lambda a, b: a & b, each, c.isNotNull())

        return some(contains_all)
    if op == "$elemMatch":
        return some(_elem_match(operand, at.type, ctx))
    if op in ("$prefix", "$contains"):
        if not isinstance(operand, str):
            fail("TYPE_MISMATCH", f"{op} takes a string")
        find = F.startswith if op == "$prefix" else F.contains
        return some(lambda c: find(c, F.lit(operand)) if logical_type(at.type) == "string" else F.lit(False))
    if op == "$regex":
        pattern = regex.java_pattern(operand)
        return some(lambda c: c.rlike(pattern) if logical_type(at.type) == "string" else F.lit(False))
    if op in ("$expiresBefore", "$expiresAfter"):
        t = V.literal(operand)
        if t.type == "string":
            t = V.parse_timestamp(t.value)
        if t.type != "timestamp":
            fail("TYPE_MISMATCH", op)
        return some(lambda c: compare("$lt" if op == "$expiresBefore" else "$gt", c, at.type, t))
    if op == "$vectorNear":
        return F.coalesce(vectors.near(at, operand), F.lit(False))
    if op == "$vectorTopK":
        fail("VAL_UNSUPPORTED_COMBINATION", "$vectorTopK stands at the top of a find filter only")
    return fail("VAL_UNKNOWN_OPERATOR", op)


def member(c: Column, kind: T.DataType, items: list[V.Value]) -> Column:
    """Some item equals the candidate. Items that can't be of the column's type fall away; null is asked apart."""
    cols = [x for v in items if v.type != "null" and (x := literal_column(kind, v)) is not None]
    nan = isinstance(kind, (T.FloatType, T.DoubleType)) or isinstance(kind, (T.ArrayType, T.StructType))
    if nan:
        out = reduce(lambda a, b: a | b, [F.coalesce(c.eqNullSafe(x), F.lit(False)) for x in cols], F.lit(False)) if len(cols) <= 64 else F.coalesce(F.array_contains(F.array(*cols), c), F.lit(False))
    else:
        out = c.isin(cols) if cols else F.lit(False)
    has_null = any(v.type == "null" for v in items)
    return F.coalesce(out, F.lit(has_null)) if has_null else out


def type_names(operand: object) -> set[str]:
    names = operand if isinstance(operand, list) else [operand]
    if not 1 <= len(names) <= 32 or len(set(map(str, names))) != len(names) or any(n not in TYPE_NAMES for n in names):
        fail("VAL_INVALID_SHAPE", "$type takes a type's name or 1 to 32 different ones")
    return {t for n in names for t in TYPE_NAMES[n]}


def of_type(c: Column, kind: T.DataType, operand: object) -> Column:
    names = type_names(operand)
    own = F.lit(logical_type(kind) in names)
    return F.when(c.isNull(), F.lit("null" in names)).otherwise(own)


def _elem_match(operand: object, kind: T.DataType, ctx: Context):
    if not isinstance(operand, dict) or not operand:
        fail("VAL_INVALID_SHAPE", "$elemMatch takes operators or fields")
    element = kind.elementType if isinstance(kind, T.ArrayType) else T.NullType()
    if _is_operators(operand) and not set(operand) & set(LOGICAL[:3]):

        def test(x: Column) -> Column:
            at = paths.Resolved(element, x, F.lit(True), always=True)
            return reduce(lambda a, b: a & b, [_operator(op, v, at, "", ctx, False) for op, v in operand.items()])
    else:
        inner = element if isinstance(element, T.StructType) else T.StructType([])
        probe = F.struct(F.lit(None).alias("_")) if not inner.fields else None

        def test(x: Column) -> Column:
            if probe is not None:
                compile_filter(operand, ctx, False, probe, inner)
                return F.lit(False)
            return x.isNotNull() & compile_filter(operand, ctx, False, x, inner)

    test(F.lit(None).cast(element))  # invalid operands are errors whatever the type
    return lambda c: F.coalesce(F.exists(c, test), F.lit(False)) if isinstance(kind, T.ArrayType) else F.lit(False)


def _expiry(op: str, operand: object, ctx: Context) -> Column:
    """Predicates on the collection's own expiry path."""
    if ctx.ttl is None:
        fail("VAL_UNSUPPORTED_COMBINATION", "the collection declares no expiry path")
    if op != "$ttl":
        return _field(ctx.ttl, {op: operand}, ctx, None, ctx.schema, False)
    return ttl_state(ctx, operand)


def ttl_state(ctx: Context, state: object) -> Column:
    """active, expired (the cutoff itself has expired) or unbounded, at the pinned time."""
    if state not in ("active", "expired", "unbounded"):
        fail("VAL_INVALID_SHAPE", "$ttl takes active, expired or unbounded")
    at = paths.resolve(paths.parse(ctx.ttl), ctx.schema)
    if at.absent or logical_type(at.type) != "timestamp" or not at.one:
        return F.lit(state == "unbounded")
    now = V.Value("timestamp", V.micros(ctx.now or dt.datetime.now(dt.UTC)))
    bounded = at.present & at.value.isNotNull()
    if state == "unbounded":
        return ~bounded
    return bounded & F.coalesce(compare("$gt" if state == "active" else "$lte", at.value, at.type, now), F.lit(False))


def split_top_k(spec: object) -> tuple[dict, TopK | None]:
    """A find filter without its $vectorTopK, and that."""
    if not isinstance(spec, dict):
        fail("VAL_INVALID_SHAPE", "a filter is an object")
    rest, top = {}, None
    for path, operand in spec.items():
        if isinstance(operand, dict) and "$vectorTopK" in operand and not path.startswith("$"):
            if top:
                fail("VAL_UNSUPPORTED_COMBINATION", "two $vectorTopK")
            top = vectors.top_k(path, operand["$vectorTopK"])
            operand = {k: v for k, v in operand.items() if k != "$vectorTopK"}
            if not operand:
                continue
        rest[path] = operand
    return rest, top
