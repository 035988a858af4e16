"""The value operations on typed columns, as built-in expressions.

What the type decides is an error when the column is made; what a row decides
is raised with its code. Null operands of arithmetic, sizes and distances are
errors, as null is of another type.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths
from ..errors import fail
from ..operators.filters import compare, logical_type
from . import decimals
from . import values as V

INTEGERS = ("int32", "int64")


def _raised(code: str, kind: str) -> Column:
    return F.raise_error(F.lit(code)).cast(kind)


def _numbers(*kinds: T.DataType) -> list[str]:
    names = [logical_type(k) for k in kinds]
    for n in names:
        if n not in V.NUMERIC:
            fail("TYPE_MISMATCH", n)
    return names


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def add(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """A checked sum: int64 for integers, which may widen; an integer joins floats only if exact; decimals keep 34 digits."""
    names = set(_numbers(kind_a, kind_b))
    given = a.isNotNull() & b.isNotNull()
    if names <= set(INTEGERS):
        total = F.try_add(a.cast("long"), b.cast("long"))
        wrong = F.when(a > 0, _raised("TYPE_NUMERIC_OVERFLOW", "long")).otherwise(_raised("TYPE_NUMERIC_UNDERFLOW", "long"))
        return F.when(~given, _raised("TYPE_MISMATCH", "long")).when(total.isNull(), wrong).otherwise(total)
    if names >= {"decimal128", "float64"}:
        fail("TYPE_MISMATCH", "decimal and float")
    if "float64" in names:
        parts = []
        for c, k in ((a, kind_a), (b, kind_b)):
            d = c.cast("double")
            parts.append(d if logical_type(k) == "float64" else F.when(_whole(d) == _whole(c), d).otherwise(_raised("TYPE_COERCION_LOSS", "double")))
        total = parts[0] + parts[1]
        finite = lambda x: (F.abs(x) < float("inf")) & ~F.isnan(x)
        over = finite(parts[0]) & finite(parts[1]) & ~finite(total)
        return F.when(~given, _raised("TYPE_MISMATCH", "double")).when(over, _raised("TYPE_NUMERIC_OVERFLOW", "double")).otherwise(total)
    scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in (kind_a, kind_b))
    kind = T.DecimalType(38, scale)
    total = F.try_add(a.cast(kind), b.cast(kind)).cast(kind)
    return F.when(given, decimals.to_34_digits(total, scale)).otherwise(_raised("TYPE_MISMATCH", kind.simpleString()))


def negate(c: Column, kind: T.DataType) -> Column:
    """The negative: int64 for integers, whose least has none."""
    (name,) = _numbers(kind)
    if name in INTEGERS:
        out = F.try_subtract(F.lit(0).cast("long"), c.cast("long"))
        return F.when(c.isNull(), _raised("TYPE_MISMATCH", "long")).when(out.isNull(), _raised("TYPE_NUMERIC_OVERFLOW", "long")).otherwise(out)
    sql = "double" if name == "float64" else kind.simpleString()
    out = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c.cast("double") * F.lit(-1.0)) if name == "float64" else (-c).cast(kind)
    return F.when(c.isNull(), _raised("TYPE_MISMATCH", sql)).otherwise(out)


def _double_as_decimal(d: Column, scale: int) -> tuple[Column, Column]:
    """(the value as DECIMAL(38, scale), whether that is exact) of doubles below 2**63: a fraction fits if it has `scale` binary digits."""
    inside = F.abs(d) < float(2**63)
    whole = F.when(inside, F.floor(d))
    part = (d - whole.cast("double")) * float(2**scale)
    fits = inside & (part == F.floor(part))
    fraction = F.when(fits, part.cast("long").cast("decimal(20,0)") * F.lit(Decimal(5) ** scale).cast(T.DecimalType(18, 0)))
    value = _whole(whole).cast(T.DecimalType(38, scale)) + fraction.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale)).cast(T.DecimalType(38, scale))
    return value.cast(T.DecimalType(38, scale)), F.coalesce(fits, F.lit(False))


def equal(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """Semantic equality, exact across numeric types; two nulls are equal."""
    name_a, name_b = logical_type(kind_a), logical_type(kind_b)
    both_null = a.isNull() & b.isNull()
    if name_a not in V.NUMERIC or name_b not in V.NUMERIC:
        return a.eqNullSafe(b) if kind_a.simpleString() == kind_b.simpleString() else both_null
    if name_a in INTEGERS and name_b in INTEGERS or name_a == name_b == "float64":
        return a.eqNullSafe(b)
    if name_a == "float64":
        a, b, kind_a, kind_b, name_a, name_b = b, a, kind_b, kind_a, name_b, name_a
    if name_b == "float64":
        scale = min(18, kind_a.scale) if name_a == "decimal128" else 0
        if name_a == "decimal128" and kind_a.scale > 18:
            fail("CAP_UNSUPPORTED_FEATURE", "a decimal of more than 18 places and a float")
        value, exact = _double_as_decimal(b.cast("double"), scale)
        same = exact & (value == a.cast(T.DecimalType(38, scale)))
    else:
        same = a.cast("decimal(38,18)" if max(getattr(kind_a, "scale", 0), getattr(kind_b, "scale", 0)) <= 18 else "decimal(38,38)") == b
    return F.coalesce(same, F.lit(False)) | both_null


def identical(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """Type and payload alike, the sign of a zero included."""
    if kind_a.simpleString() != kind_b.simpleString():
        return F.lit(False)
    if logical_type(kind_a) == "float64":
        return a.cast("string").eqNullSafe(b.cast("string"))
    return a.eqNullSafe(b)


def _array(c: Column, kind: T.DataType) -> T.ArrayType:
    return kind if isinstance(kind, T.ArrayType) else fail("TYPE_MISMATCH", logical_type(kind))


def array_size(c: Column, kind: T.DataType) -> Column:
    _array(c, kind)
    return F.when(c.isNull(), _raised("TYPE_MISMATCH", "long")).otherwise(F.size(c).cast("long"))


def array_elem_match(c: Column, kind: T.DataType, wanted: object) -> Column:
    """Some element equals the literal."""
    element, lit = _array(c, kind).elementType, V.literal(wanted)
    return F.when(c.isNull(), _raised("TYPE_MISMATCH", "boolean")).otherwise(F.exists(c, lambda x: F.coalesce(compare("$eq", x, element, lit), F.lit(False))))


def array_all(c: Column, kind: T.DataType, wanted: list) -> Column:
    """Each literal equals some element."""
    return reduce(lambda x, y: x & y, (array_elem_match(c, kind, w) for w in wanted), array_size(c, kind) >= 0)


def string_contains(c: Column, kind: T.DataType, part: Column) -> Column:
    if logical_type(kind) != "string":
        fail("TYPE_MISMATCH", logical_type(kind))
    return F.when(c.isNull(), _raised("TYPE_MISMATCH", "boolean")).otherwise(F.contains(c, part))


def path_resolve(path: str, schema: T.StructType, fanout: bool = False) -> Column:
    """The one value of a path in a row (null if it is missing), an error for several; with fanout the array of candidates."""
    at = paths.resolve(paths.parse(path), schema)
    if at.absent:
        return F.array() if fanout else F.lit(None)
    if fanout:
        return at.value if not at.one else F.when(at.present, F.array(at.value)).otherwise(F.array().cast(T.ArrayType(at.type)))
    if at.one:
        return F.when(at.present, at.value)
    several = F.raise_error(F.lit("VAL_UNSUPPORTED_COMBINATION")).cast(at.type)
    return F.when(F.size(at.value) > 1, several).otherwise(F.get(at.value, F.lit(0)))


def _through_object(here: Column, name: str) -> Column:
    return F.transform(F.filter(here, lambda x: x["v"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["v"].getField(name).alias("v")))


def _at_index(here: Column, k: int) -> Column:
    held = F.filter(here, lambda x: F.coalesce(F.size(x["v"]) > k, F.lit(False)))
    return F.transform(held, lambda x: F.struct(F.concat(x["at"], F.array(F.lit(k))).alias("at"), F.get(x["v"], F.lit(k)).alias("v")))


def _through_elements(here: Column, name: str) -> Column:
    def visit(x: Column) -> Column:
        placed = F.transform(x["v"], lambda y, i: F.struct(F.concat(x["at"], F.array(i)).alias("at"), y.alias("y")))
        return F.transform(F.filter(placed, lambda z: z["y"].isNotNull()), lambda z: F.struct(z["at"].alias("at"), z["y"].getField(name).alias("v")))

    return F.flatten(F.transform(F.filter(here, lambda x: x["v"].isNotNull()), visit))


def path_positions(path: str, schema: T.StructType) -> Column:
    """Where a path's candidates stand: for each, the positions in the arrays that it passes through, in order."""
    parts = paths.parse(path)
    kind: T.DataType = schema
    here = None
    for part in parts:
        if here is None:
            at = paths.resolve([part], schema)
            if at.absent:
                return F.array().cast("array<array<int>>")
            here, kind = F.array(F.struct(F.array().cast("array<int>").alias("at"), at.value.alias("v"))), at.type
            continue
        if isinstance(kind, T.StructType) and part in kind.names:
            here, kind = _through_object(here, part), kind[part].dataType
        elif isinstance(kind, T.ArrayType) and paths.INDEX.fullmatch(part):
            here, kind = _at_index(here, int(part)), kind.elementType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and part in kind.elementType.names:
            here, kind = _through_elements(here, part), kind.elementType[part].dataType
        else:
            return F.array().cast("array<array<int>>")
    return F.transform(here, lambda x: x["at"])


def path_exists(path: str, schema: T.StructType) -> Column:
    at = paths.resolve(paths.parse(path), schema)
    return F.lit(False) if at.absent else F.coalesce(at.present if at.one else F.size(at.value) > 0, F.lit(False))


def vector_distance(a: Column, b: Column, metric: str) -> Column:
    """l2, dot or cosine distance of two vector columns: left folds in binary64; unlike sizes and zero norms are errors."""
    if metric not in ("l2", "dot", "cosine"):
        fail("VAL_INVALID_SHAPE", f"metric {metric}")
    fold = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    if metric == "l2":
        out = F.sqrt(fold(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    else:
        out = fold(F.zip_with(x, y, lambda p, q: p * q))
    if metric == "cosine":
        norms = F.sqrt(fold(F.transform(x, lambda v: v * v))) * F.sqrt(fold(F.transform(y, lambda v: v * v)))
        out = F.when(norms > 0, 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out / norms))).otherwise(_raised("TYPE_VECTOR_ZERO_NORM", "double"))
    checked = F.when(F.isnan(out) | (F.abs(out) == float("inf")), _raised("TYPE_NUMERIC_OVERFLOW", "double")).otherwise(out)
    return F.when(a.isNull() | b.isNull(), _raised("TYPE_MISMATCH", "double")).when(F.size(a) != F.size(b), _raised("TYPE_VECTOR_DIMENSION", "double")).otherwise(checked)
