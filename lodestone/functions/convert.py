"""Explicit conversions of columns: exact ones fail on any loss, rounding ones on range only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import fail

#: RFC 3339 as the engine takes it: six digits of a second at most, no -00:00, no leap second.
TIMESTAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d{1,6})?(Z|\+(0\d|1[0-3]):[0-5]\d|\+14:00|-(0[1-9]|1[0-3]):[0-5]\d|-00:(0[1-9]|[1-5]\d)|-14:00)$"
TARGETS = {"int32": "int", "int64": "bigint", "float64": "double", "decimal128": "decimal(38,18)", "string": "string"}


def parse_timestamp(c: Column) -> Column:
    """The instant (UTC) that a text spells, or null if it isn't one that the engine takes."""
    return F.when(c.rlike(TIMESTAMP), F.try_to_timestamp(c)).cast("timestamp")


def convert(c: Column, kind: T.DataType, to: str, mode: str = "exact") -> Column:
    """A number as another numeric type. exact: an error if the value changes; round: half even to integers, an error out of range."""
    if to not in TARGETS or mode not in ("exact", "round"):
        fail("VAL_INVALID_SHAPE", f"{to} {mode}")
    if not isinstance(kind, T.NumericType):
        fail("TYPE_MISMATCH", str(kind))
    sql = TARGETS[to]
    source = F.bround(c) if mode == "round" and to.startswith("int") and not isinstance(kind, T.IntegralType) else c
    if to == "float64" and isinstance(kind, T.IntegralType):  # a double holds integers to 2**53 and some beyond
        back = c.cast("double").cast("decimal(38,0)") == c.cast("decimal(38,0)")
        out = c.cast("double")
        return out if mode == "round" else F.when(back | c.isNull(), out).otherwise(F.raise_error(F.lit("TYPE_COERCION_LOSS")).cast("double"))
    out = source.try_cast(sql)
    out = F.when(out.isNull() & c.isNotNull(), F.raise_error(F.lit("TYPE_NUMERIC_OVERFLOW")).cast(sql)).otherwise(out)
    if mode == "round" or to == "string":
        return out
    return F.when(out.cast(kind).eqNullSafe(c), out).otherwise(F.raise_error(F.lit("TYPE_COERCION_LOSS")).cast(sql))


def to_date(c: Column) -> Column:
    """The UTC day of an instant."""
    return c.cast("timestamp_ntz").cast("date")


def to_timestamp(c: Column) -> Column:
    """The first instant (UTC) of a day."""
    return c.cast("timestamp_ntz")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_f16(vectors: pd.Series) -> pd.Series:
    """Elements rounded to binary16, nearest even, and widened again; overflow is an error."""

    def narrow(v):
        if v is None:
            return None
        with np.errstate(over="ignore"):
            half = np.asarray(v, np.float32).astype(np.float16)
        if not np.isfinite(half).all():
            raise ValueError("TYPE_NUMERIC_OVERFLOW")
        return half.astype(np.float32)

    return vectors.map(narrow)
