"""Typed values on the driver: literals, exact comparison, order keys, checked arithmetic, timestamps."""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import uuid
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation
from fractions import Fraction
from functools import lru_cache

from .. import limits
from ..errors import fail

#: The types' ranks in the total order.
RANKS = ("missing", "null", "bool", "numeric", "string", "binary", "object", "array", "timestamp", "date", "uuid", "objectId", "vector_f16", "vector_f32")
NUMERIC = ("int32", "int64", "float64", "decimal128")
MISSING_TYPE = "missing"
DECIMAL = Context(prec=34, rounding=ROUND_HALF_EVEN, Emin=-6143, Emax=6144, clamp=1)


@dataclass(frozen=True)
class Value:
    """A value and its logical type. Objects hold a dict, arrays and vectors a tuple, binary (subtype, bytes)."""

    type: str
    value: object = None

    def __hash__(self) -> int:
        return hash(order_key(self))


MISSING, NULL = Value(MISSING_TYPE), Value("null")


def integer(n: int) -> Value:
    return Value("int32" if -(2**31) <= n < 2**31 else "int64", n)


def literal(x: object) -> Value:
    """The value of a JSON literal; {"$value": {"type": ..., "value": ...}} names a type."""
    if x is None:
        return NULL
    if isinstance(x, bool):
        return Value("bool", x)
    if isinstance(x, int):
        return integer(x) if -(2**63) <= x < 2**63 else fail("VAL_INVALID_LITERAL", str(x))
    if isinstance(x, float):
        return Value("float64", x)
    if isinstance(x, str):
        return Value("string", x)
    if isinstance(x, Decimal):
        return Value("decimal128", x)
    if isinstance(x, dt.datetime):
        return Value("timestamp", micros(x))
    if isinstance(x, dt.date):
        return Value("date", (x - dt.date(1970, 1, 1)).days)
    if isinstance(x, (list, tuple)):
        return Value("array", tuple(map(literal, x)))
    if isinstance(x, dict):
        if "$value" in x:
            return tagged(x["$value"]) if len(x) == 1 else fail("VAL_INVALID_LITERAL", "$value has siblings")
        for name in x:
            field_name(name)
        return Value("object", {k: literal(v) for k, v in x.items()})
    return fail("VAL_INVALID_LITERAL", repr(x))


def field_name(name: str) -> str:
    return _field_name(name) if type(name) is str else _field_name.__wrapped__(name)


@lru_cache(4096)
def _field_name(name: str) -> str:
    if not name or name.startswith("$") or "." in name or any(ord(c) < 32 or ord(c) == 127 for c in name):
        fail("VAL_INVALID_FIELD_NAME", name)
    limits.check("field_name.scalars", len(name))
    limits.check("field_name.utf8_bytes", len(name.encode()))
    return name


def tagged(x: object) -> Value:
    """The value that a {"type": ..., payload} object spells out exactly."""
    if not isinstance(x, dict) or not isinstance(x.get("type"), str):
        fail("PAR_INVALID_TYPED_VALUE")
    kind, v = x["type"], x.get("value")
    try:
        if kind == "null":
            return NULL
        if kind == "bool" and isinstance(v, bool):
            return Value(kind, v)
        if kind in ("int32", "int64"):
            n, bits = int(v), int(kind[3:])
            return Value(kind, n) if -(1 << bits - 1) <= n < 1 << bits - 1 else fail("VAL_INVALID_LITERAL", f"{v} is no {kind}")
        if kind == "float64":
            return Value(kind, struct.unpack(">d", bytes.fromhex(x["bits"]))[0] if "bits" in x else float(v))
        if kind == "decimal128":
            return Value(kind, DECIMAL.create_decimal(v) if "coefficient" not in x else Decimal((int(x["sign"] in ("-", "negative", 1)), tuple(map(int, str(x["coefficient"]))), int(x["exponent"]))))
        if kind == "string" and isinstance(v, str):
            return Value(kind, v)
        if kind == "binary":
            return Value(kind, (int(x.get("subtype", 0)), bytes.fromhex(x["hex"])))
        if kind == "timestamp":
            return Value(kind, int(x["microseconds"]) if "microseconds" in x else parse_timestamp(v).value)
        if kind == "date":
            return Value(kind, int(x["days"]) if "days" in x else (dt.date.fromisoformat(v) - dt.date(1970, 1, 1)).days)
        if kind == "uuid":
            return Value(kind, uuid.UUID(v).bytes)
        if kind == "objectId" and len(v) == 24:
            return Value(kind, bytes.fromhex(v))
        if kind == "array":
            return Value(kind, tuple(map(tagged, x["values"])))
        if kind == "object":
            return Value(kind, {field_name(f["name"]): tagged(f["value"]) for f in x["fields"]})
        if kind in ("vector", "vector_f32", "vector_f16"):
            element = x.get("element", kind[-3:] if "_" in kind else "f32")
            parts = tuple(struct.unpack(">f" if element == "f32" else ">e", bytes.fromhex(b))[0] for b in x["bits"]) if "bits" in x else tuple(map(float, v))
            return vector(parts, element)
    except (ValueError, TypeError, KeyError, InvalidOperation, struct.error):
        pass
    return fail("PAR_INVALID_TYPED_VALUE", kind)


def vector(parts: tuple[float, ...], element: str = "f32") -> Value:
    limits.check("vector.dimension", len(parts))
    if not parts or not all(map(math.isfinite, parts)):
        fail("TYPE_INVALID_SPECIAL", "vectors are finite and not empty")
    return Value(f"vector_{element}", parts)


def rank(v: Value) -> int:
    return RANKS.index("numeric" if v.type in NUMERIC else v.type)


def is_nan(v: Value) -> bool:
    return v.type == "float64" and math.isnan(v.value) or v.type == "decimal128" and v.value.is_nan()


def exact(v: Value) -> Fraction | float:
    """A numeric value as a fraction, or as an infinity or NaN."""
    x = v.value
    if is_nan(v):
        return math.nan
    if isinstance(x, float) and math.isinf(x) or isinstance(x, Decimal) and x.is_infinite():
        return math.inf if x > 0 else -math.inf
    return Fraction(x)


def _bytes(raw: bytes) -> bytes:
    return raw.replace(b"\0", b"\0\xff") + b"\0\0"


def _number(v: Value) -> bytes:
    """Class byte, then sign, decimal exponent and digits of the exact expansion, complemented below zero."""
    x = exact(v)
    if x != x:
        return b"\x04"
    if x in (math.inf, -math.inf):
        return b"\x03" if x > 0 else b"\x01"
    if x == 0:
        return b"\x02\x01"
    d = Decimal(v.value).as_tuple()  # exact for every int, float and decimal
    digits = "".join(map(str, d.digits)).lstrip("0")
    body = struct.pack(">H", len(digits) + d.exponent + 20_000) + digits.rstrip("0").encode() + b"\0"
    return b"\x02\x02" + body if x > 0 else b"\x02\x00" + bytes(255 - b for b in body)


def order_key(v: Value) -> bytes:
    """Bytes whose order is the total order of values."""
    head = bytes([rank(v) + 1])
    if v.type in (MISSING_TYPE, "null"):
        return head
    if v.type == "bool":
        return head + bytes([v.value])
    if v.type in NUMERIC:
        return head + _number(v)
    if v.type == "string":
        return head + _bytes(v.value.encode())
    if v.type == "binary":
        return head + bytes([v.value[0]]) + struct.pack(">I", len(v.value[1])) + v.value[1]
    if v.type == "object":
        return head + b"".join(b"\x01" + _bytes(k.encode()) + order_key(x) for k, x in sorted(v.value.items(), key=lambda i: i[0].encode())) + b"\0"
    if v.type == "array":
        return head + b"".join(map(order_key, v.value)) + b"\0"
    if v.type in ("timestamp", "date"):
        return head + struct.pack(">Q", v.value + (1 << 63))
    if v.type in ("uuid", "objectId"):
        return head + v.value
    flip = lambda bits: bits ^ (0xFFFFFFFF if bits >> 31 else 0x80000000)
    return head + struct.pack(">I", len(v.value)) + b"".join(struct.pack(">I", flip(struct.unpack(">I", struct.pack(">f", x + 0.0))[0])) for x in v.value)


def compare(a: Value, b: Value) -> int:
    x, y = order_key(a), order_key(b)
    return (x > y) - (x < y)


def equal(a: Value, b: Value) -> bool:
    return order_key(a) == order_key(b)


def identical(a: Value, b: Value) -> bool:
    """Type and payload alike, signs of zero and order of fields included."""
    if a.type != b.type:
        return False
    if a.type == "float64":
        return struct.pack(">d", a.value) == struct.pack(">d", b.value)
    if a.type == "decimal128":
        return a.value.as_tuple() == b.value.as_tuple()
    if a.type == "object":
        return list(a.value) == list(b.value) and all(identical(a.value[k], b.value[k]) for k in a.value)
    if a.type == "array":
        return len(a.value) == len(b.value) and all(map(identical, a.value, b.value))
    return a.value == b.value


def add(a: Value, b: Value) -> Value:
    """Checked sum: integers widen, decimals round half even at 34 digits, an integer joins floats only if exact."""
    for v in (a, b):
        if v.type not in NUMERIC:
            fail("TYPE_MISMATCH", v.type)
    kinds = {a.type, b.type}
    if kinds <= {"int32", "int64"}:
        n = a.value + b.value
        if not -(2**63) <= n < 2**63:
            fail("TYPE_NUMERIC_OVERFLOW" if n > 0 else "TYPE_NUMERIC_UNDERFLOW")
        return Value("int64", n) if "int64" in kinds else integer(n)
    if kinds >= {"decimal128", "float64"}:
        fail("TYPE_MISMATCH", "decimal and float")
    if "float64" in kinds:
        for v in (a, b):
            if v.type != "float64" and int(float(v.value)) != v.value:
                fail("TYPE_COERCION_LOSS", str(v.value))
        total = float(a.value) + float(b.value)
        if math.isinf(total) and math.isfinite(float(a.value)) and math.isfinite(float(b.value)):
            fail("TYPE_NUMERIC_OVERFLOW")
        return Value("float64", total)
    try:
        return Value("decimal128", DECIMAL.add(Decimal(a.value), Decimal(b.value)))
    except InvalidOperation:
        return Value("decimal128", Decimal("NaN"))
    except ArithmeticError:
        return fail("TYPE_NUMERIC_OVERFLOW")


def negate(a: Value) -> Value:
    if a.type not in NUMERIC:
        fail("TYPE_MISMATCH", a.type)
    if a.type in ("int32", "int64"):
        if a.value == -(2**63):
            fail("TYPE_NUMERIC_OVERFLOW")
        return integer(-a.value) if a.type == "int32" else Value("int64", -a.value)
    if is_nan(a):
        return Value(a.type, math.nan if a.type == "float64" else Decimal("NaN"))
    return Value(a.type, -a.value if a.type == "float64" else a.value.copy_negate())


_TIMESTAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(Z|[+-]\d\d:\d\d)")


def micros(t: dt.datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


def parse_timestamp(text: str) -> Value:
    """RFC 3339 with at most six digits of a second, offsets to 14:00, no -00:00, no leap second, years 1 to 9999."""
    m = _TIMESTAMP.fullmatch(text) if isinstance(text, str) and text.isascii() else None
    if not m or m[8] == "-00:00":
        fail("VAL_INVALID_LITERAL", "no timestamp")
    offset = 0
    if m[8] != "Z":
        hours, minutes = int(m[8][1:3]), int(m[8][4:])
        offset = (hours * 60 + minutes) * (1 if m[8][0] == "+" else -1)
        if minutes > 59 or abs(offset) > 14 * 60:
            fail("VAL_INVALID_LITERAL", "offset")
    try:
        local = dt.datetime(*map(int, m.group(1, 2, 3, 4, 5, 6)), int((m[7] or "0").ljust(6, "0")))
        return Value("timestamp", micros(local - dt.timedelta(minutes=offset)))
    except ValueError:
        return fail("VAL_INVALID_LITERAL", "no such time")
    except OverflowError:
        return fail("TYPE_TEMPORAL_RANGE")


def distance(a: Value, b: Value, metric: str) -> float:
    """Left folds in binary64; cosine is a distance, clamped."""
    for v in (a, b):
        if not v.type.startswith("vector"):
            fail("TYPE_MISMATCH", v.type)
    if a.type != b.type or len(a.value) != len(b.value):
        fail("TYPE_VECTOR_DIMENSION")
    fold = lambda xs: _left_sum(xs)
    if metric == "l2":
        out = math.sqrt(fold((x - y) * (x - y) for x, y in zip(a.value, b.value, strict=True)))
    elif metric == "dot":
        out = fold(x * y for x, y in zip(a.value, b.value, strict=True))
    elif metric == "cosine":
        norms = math.sqrt(fold(x * x for x in a.value)) * math.sqrt(fold(y * y for y in b.value))
        if norms == 0:
            fail("TYPE_VECTOR_ZERO_NORM")
        out = 1 - max(-1.0, min(1.0, fold(x * y for x, y in zip(a.value, b.value, strict=True)) / norms))
    else:
        fail("VAL_INVALID_SHAPE", f"metric {metric}")
    if not math.isfinite(out):
        fail("TYPE_NUMERIC_OVERFLOW")
    return out


def _left_sum(xs) -> float:
    total = 0.0
    for x in xs:
        total += x
    return total
