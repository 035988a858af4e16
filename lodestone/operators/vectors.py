"""Exact vector scores as expressions: left folds in binary64 over the stored elements."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits, paths
from ..errors import fail
from ..functions import values as V

METRICS = ("l2", "cosine", "dot")


def query_vector(operand: object) -> tuple[float, ...]:
    if isinstance(operand, dict) and "$value" in operand:
        v = V.literal(operand)
        return v.value if v.type.startswith("vector") else fail("TYPE_MISMATCH", v.type)
    if not isinstance(operand, (list, tuple)) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in operand):
        fail("VAL_INVALID_SHAPE", "a vector is an array of numbers")
    return V.vector(tuple(float(x) for x in operand)).value


def _fold(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def score(c: Column, vector: tuple[float, ...], metric: str) -> Column:
    """l2 and cosine are distances, dot a similarity; null where the stored vector isn't eligible: another size, or no norm under cosine."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    d = F.transform(c, lambda x: x.cast("double"))
    if metric == "l2":
        out = F.sqrt(_fold(F.zip_with(d, q, lambda x, y: (x - y) * (x - y))))
    else:
        out = _fold(F.zip_with(d, q, lambda x, y: x * y))
    if metric == "cosine":
        own = math.sqrt(V._left_sum(x * x for x in vector))
        norms = F.sqrt(_fold(F.transform(d, lambda x: x * x))) * F.lit(own)
        out = F.when(norms > 0, 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out / norms)))
    bad = F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("DUR_CORRUPTION")).cast("double")).otherwise(out)
    return F.when(F.size(c) == len(vector), out)


def _shape(operand: object, allowed: set[str]) -> tuple[tuple[float, ...], str]:
    if not isinstance(operand, dict) or set(operand) - allowed or "vector" not in operand or operand.get("metric") not in METRICS:
        fail("VAL_INVALID_SHAPE", "a vector operator takes vector, metric and its bound")
    v = query_vector(operand["vector"])
    if operand["metric"] == "cosine" and not any(v):
        fail("TYPE_VECTOR_ZERO_NORM")
    return v, operand["metric"]


def _number(x: object) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        fail("VAL_INVALID_SHAPE", "a bound is a finite number")
    return float(x)


def _within(s: Column, metric: str, bound: float, inclusive: bool) -> Column:
    if metric == "dot":
        return s >= bound if inclusive else s > bound
    return s <= bound if inclusive else s < bound


def near(at: paths.Resolved, operand: object) -> Column:
    v, metric = _shape(operand, {"vector", "metric", "maxDistance", "minScore", "inclusive"})
    bound = "minScore" if metric == "dot" else "maxDistance"
    if bound not in operand or ("maxDistance" in operand and "minScore" in operand) or not isinstance(operand.get("inclusive", True), bool):
        fail("VAL_INVALID_SHAPE", f"{metric} takes {bound}")
    limit = _number(operand[bound])
    if at.absent or not is_vector(at.type) or not at.one:
        return F.lit(False)
    return at.present & _within(score(at.value, v, metric), metric, limit, operand.get("inclusive", True))


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def top_k(path: str, operand: object):
    from .filters import TopK

    v, metric = _shape(operand, {"vector", "metric", "k", "threshold", "inclusive"})
    k = operand.get("k")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        fail("VAL_INVALID_SHAPE", "k is a positive integer")
    limits.check("vector.top_k", k)
    threshold = operand.get("threshold")
    return TopK(path, v, metric, k, None if threshold is None else _number(threshold), operand.get("inclusive", True))


def normalise(c: Column) -> Column:
    """A vector scaled to norm 1; an error for a zero vector."""
    d = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(_fold(F.transform(d, lambda x: x * x)))
    return F.when(norm > 0, F.transform(d, lambda x: (x / norm).cast("float"))).otherwise(F.raise_error(F.lit("TYPE_VECTOR_ZERO_NORM")).cast("array<float>"))
