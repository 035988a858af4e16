"""The aggregation pipeline: each stage maps a DataFrame and the order it stands in.

Order is carried as sort columns, and a sort is only planned where a position
matters: before skip and limit, and at the end. A hidden row identity breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits, paths
from ..errors import fail
from ..functions import decimals
from ..functions import values as V
from ..sources.folders import stored
from . import find as finding
from .filters import compile_filter, literal_column, logical_type

STAGES = ("$match", "$project", "$sort", "$skip", "$limit", "$count", "$group", "$unwind")
#: Stages that are known and put off.
DEFERRED = ("$lookup", "$facet", "$bucket", "$bucketAuto", "$graphLookup", "$geoNear", "$search", "$unionWith", "$merge", "$out", "$sample", "$setWindowFields", "$densify", "$fill")
ACCUMULATORS = ("$count", "$sum", "$avg", "$min", "$max")
EXPRESSIONS = ("$literal", "$ifNull", "$type", "$size")
#: Floats are added in chunks of so many by ordinal, then pairwise.
CHUNK = 1024
HIDDEN = "__ord"


@dataclass
class Expr:
    """A value and whether it is there; type None: never there."""

    type: T.DataType | None
    value: Column | None
    present: Column
    always: bool = False


@dataclass
class Stream:
    """Rows in an order. order: sort columns by name and direction; exact: the rows stand in it physically."""

    df: DataFrame
    order: list[tuple[str, int]]
    hidden: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema if f.name not in self.hidden])

    def columns(self) -> list[Column]:
        return [F.col(f"`{n}`").asc_nulls_first() if way == 1 else F.col(f"`{n}`").desc_nulls_last() for n, way in self.order]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.columns())


def aggregate(source: finding.Source, command: dict) -> DataFrame:
    """{aggregate, pipeline}: the ordered rows."""
    for key in command:
        if key not in ("aggregate", "pipeline"):
            fail("VAL_UNKNOWN_OPTION", key)
    limits.check_tree(command)
    stages = command.get("pipeline")
    if not isinstance(stages, list):
        fail("VAL_INVALID_SHAPE", "a pipeline is an array")
    limits.check("pipeline.stages", len(stages))
    for s in stages:
        if not isinstance(s, dict) or len(s) != 1:
            fail("VAL_INVALID_SHAPE", "a stage has one key")
        name = next(iter(s))
        if name not in STAGES:
            fail("CAP_UNSUPPORTED_FEATURE" if name in DEFERRED else "VAL_UNKNOWN_OPERATOR", name)
    hidden = {f"{HIDDEN}_{k}": c for k, c in enumerate(source.id)}
    df = source.visible().withColumns({h: F.col(f"`{c}`") for h, c in hidden.items()})
    now = Stream(df, [(h, 1) for h in hidden], (*hidden, *(c for c in df.columns if c == paths.SEEN)))
    for positions, run in groupby(stages, lambda s: next(iter(s)) in ("$skip", "$limit")):
        if positions:
            now = _positions(now, run)
            continue
        for s in run:
            (name, operand), = s.items()
            now = globals()["_" + name[1:]](now, operand)
    return now.sorted().drop(*now.hidden)


# -- expressions ---------------------------------------------------------------


def expression(spec: object, schema: T.StructType) -> Expr:
    """Literals, $literal, field and root references, $ifNull, $type, $size, and objects and arrays of them."""
    if isinstance(spec, str) and spec.startswith("$"):
        if spec == "$$ROOT":
            return Expr(schema, F.struct(*(F.col(f"`{n}`") for n in schema.names)), F.lit(True), True)
        if spec.startswith("$$"):
            fail("VAL_UNKNOWN_OPERATOR", spec)
        at = paths.resolve(paths.parse(spec[1:]), schema)
        if at.absent:
            return Expr(None, None, F.lit(False))
        if not at.one:  # no candidate: missing; one: itself is out of static reach, so candidates stay a dense array
            return Expr(T.ArrayType(at.type), at.value, F.size(at.value) > 0)
        return Expr(at.type, at.value, at.present, at.always)
    if isinstance(spec, dict) and set(spec) != {"$value"} and any(k.startswith("$") for k in spec):
        if len(spec) != 1:
            fail("VAL_INVALID_SHAPE", "an expression has one operator")
        (op, x), = spec.items()
        if op not in EXPRESSIONS:
            fail("VAL_UNKNOWN_OPERATOR", op)
        return {"$literal": _lit, "$ifNull": _if_null, "$type": _type, "$size": _size}[op](x, schema)
    if isinstance(spec, dict) and set(spec) != {"$value"}:
        each = {V.field_name(k): expression(v, schema) for k, v in spec.items()}
        each = {k: e for k, e in each.items() if e.type is not None}  # a missing child is left out
        kind = T.StructType([T.StructField(k, e.type) for k, e in each.items()])
        return Expr(kind, F.struct(*(_or_null(e).alias(k) for k, e in each.items())), F.lit(True), True)
    if isinstance(spec, list):
        each = [expression(v, schema) for v in spec]
        if any(e.type is None for e in each):
            fail("TYPE_EXPRESSION_MISSING", "an array's child is missing")
        parts = [e.value if e.always else F.when(e.present, e.value).otherwise(F.raise_error(F.lit("TYPE_EXPRESSION_MISSING")).cast(e.type)) for e in each]
        return Expr(T.ArrayType(each[0].type if each else T.StringType()), F.array(*parts), F.lit(True), True)
    return _lit(spec, schema)


def _or_null(e: Expr) -> Column:
    return e.value if e.always else F.when(e.present, e.value)


def _typed(v: V.Value) -> tuple[T.DataType, Column]:
    kinds = {"null": T.StringType(), "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType()}
    if v.type == "decimal128":
        exponent = min(0, v.value.as_tuple().exponent) if v.value.is_finite() else fail("CAP_UNSUPPORTED_FEATURE", "special decimals")
        kind: T.DataType = T.DecimalType(38, -exponent)
    elif v.type == "array":
        each = [_typed(x) for x in v.value]
        return T.ArrayType(each[0][0] if each else T.StringType()), F.array(*(c for _, c in each))
    elif v.type == "object":
        named = {k: _typed(x) for k, x in v.value.items()}
        return T.StructType([T.StructField(k, t) for k, (t, _) in named.items()]), F.struct(*(c.alias(k) for k, (_, c) in named.items()))
    else:
        kind = kinds.get(v.type) or fail("CAP_UNSUPPORTED_FEATURE", v.type)
    return kind, literal_column(kind, v)


def _lit(x: object, schema: T.StructType) -> Expr:
    return Expr(*_typed(V.literal(x)), F.lit(True), True)


def _if_null(x: object, schema: T.StructType) -> Expr:
    if not isinstance(x, list) or len(x) != 2:
        fail("VAL_INVALID_SHAPE", "$ifNull takes two expressions")
    a, b = (expression(e, schema) for e in x)
    if a.type is None:
        return b
    if b.type is None:
        return Expr(a.type, a.value, a.present & a.value.isNotNull())
    return Expr(b.type if isinstance(a.type, T.NullType) else a.type, F.coalesce(_or_null(a), _or_null(b)), a.present & a.value.isNotNull() | b.present, a.always and b.always or b.always)


def _type(x: object, schema: T.StructType) -> Expr:
    e = expression(x, schema)
    if e.type is None:
        return Expr(T.StringType(), F.lit("missing"), F.lit(True), True)
    name = F.when(e.value.isNull(), F.lit("null")).otherwise(F.lit(logical_type(e.type)))
    return Expr(T.StringType(), name if e.always else F.when(e.present, name).otherwise(F.lit("missing")), F.lit(True), True)


def _size(x: object, schema: T.StructType) -> Expr:
    e = expression(x, schema)
    if e.type is None:
        return e
    bad = F.raise_error(F.lit("TYPE_MISMATCH")).cast("long")
    n = F.when(e.value.isNotNull(), F.size(e.value).cast("long")).otherwise(bad) if isinstance(e.type, T.ArrayType) else bad
    return Expr(T.LongType(), n if e.always else F.when(e.present, n), e.present, e.always)


# -- stages --------------------------------------------------------------------


def _match(now: Stream, spec: object) -> Stream:
    from .filters import Context

    return Stream(now.df.where(compile_filter(spec, Context(now.schema))), now.order, now.hidden)


def _kept_order(now: Stream) -> Stream:
    """The order under hidden names, so that a new shape keeps it."""
    if all(n in now.hidden for n, _ in now.order):
        return now
    names = [f"{HIDDEN}_{len(now.hidden) + k}_" for k in range(len(now.order))]
    df = now.df.withColumns({h: F.col(f"`{n}`") for h, (n, _) in zip(names, now.order, strict=True)})
    return Stream(df, [(h, w) for h, (_, w) in zip(names, now.order, strict=True)], (*now.hidden, *names))


def _project(now: Stream, spec: object) -> Stream:
    if not isinstance(spec, dict) or not spec:
        fail("VAL_INVALID_SHAPE", "$project names its fields")
    limits.check("projection.paths", len(spec))
    now = _kept_order(now)
    plain = {p: v for p, v in spec.items() if isinstance(v, (bool, int)) and not isinstance(v, float)}
    for v in plain.values():
        finding._sign(v)
    computed = {p: v for p, v in spec.items() if p not in plain}
    off = {p for p, v in plain.items() if not v}
    late: list[Column] = []
    shape = now.df.select(*(F.col(f"`{n}`") for n in now.schema.names))  # columns that may be lacking keep their metadata
    if not computed and off and off >= set(plain) - {"_id"}:
        out = _columns(shape, plain, ())
    else:
        if off - {"_id"}:
            fail("VAL_UNSUPPORTED_COMBINATION", "inclusion and exclusion together")
        on = {p: 1 for p, v in plain.items() if v}
        if "_id" in shape.columns and "_id" not in off and "_id" not in on:
            on["_id"] = 1
        finding._tree(dict.fromkeys((*on, *computed)))  # equal and nested paths are in conflict
        out = _columns(shape, on, ()) if on else []
        kept = list(on)
        for head, node in sorted(_nested(computed).items()):
            e = _computed(node, now.schema)
            if e.type is None:
                continue
            mine = [p for p in kept if p.split(".")[0] == head]
            if mine:  # some fields of the object are kept: computed ones follow them
                (here,) = _columns(shape, {p: 1 for p in mine}, ())
                out = [c for c in _columns(shape, {p: 1 for p in kept if p not in mine}, ())] if len(mine) < len(kept) else []
                kept = [p for p in kept if p not in mine]
                for inner in e.type.names:
                    here = here.withField(f"`{inner}`", e.value.getField(inner))
                late.append(here.alias(head))
            else:
                late.append(_or_null(e).alias(head))
        out += late
    return Stream(now.df.select(*out, *now.hidden), now.order, now.hidden)


def _nested(computed: dict) -> dict:
    """Paths as a tree of names; a leaf is (expression,)."""
    out: dict = {}
    for path, x in computed.items():
        *above, last = paths.parse(path)
        at = out
        for p in above:
            at = at.setdefault(p, {})
        at[last] = (x,)
    return out


def _computed(node, schema: T.StructType) -> Expr:
    """The value of a leaf, or the object of a tree's values; missing ones are left out."""
    if isinstance(node, tuple):
        return expression(node[0], schema)
    each = {V.field_name(k): _computed(v, schema) for k, v in sorted(node.items())}
    each = {k: e for k, e in each.items() if e.type is not None}
    if not each:
        return Expr(None, None, F.lit(False))
    return Expr(T.StructType([T.StructField(k, e.type) for k, e in each.items()]), F.struct(*(_or_null(e).alias(k) for k, e in each.items())), F.lit(True), True)


def _columns(df: DataFrame, spec: dict, ids: tuple[str, ...]) -> list[Column]:
    including = any(spec.values())
    tree = finding._tree(spec if including else {p: 0 for p, v in spec.items() if not v})
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if including and f.name in tree:
            inner = c if tree[f.name] is None else finding._included(c, f.dataType, tree[f.name])
            if inner is not None:
                out.append(inner.alias(f.name, metadata=f.metadata))
        elif not including and tree.get(f.name, {}) is not None:
            out.append((finding._excluded(c, f.dataType, tree[f.name]) if f.name in tree else c).alias(f.name, metadata=f.metadata))
    return out


def _sort(now: Stream, spec: object) -> Stream:
    finding.order_columns(spec, now.schema)  # validates
    names, order = {}, []
    for k, (path, way) in enumerate(spec.items()):
        at = paths.resolve(paths.parse(path), now.schema)
        if at.absent:
            continue
        for j, c in enumerate([at.value] if at.always else [at.present, at.value]):
            name = f"{HIDDEN}_{len(now.hidden)}_{k}_{j}"
            names[name] = c
            order.append((name, way))
    df = now.df.withColumns(names) if names else now.df
    return Stream(df, order + now.order, (*now.hidden, *names))


def _positions(now: Stream, stages: Iterable[dict]) -> Stream:
    """$skip and $limit, one after the other, as one range of positions."""
    skip, limit = 0, None
    for s in stages:
        (name, operand), = s.items()
        n = finding.position(operand, name)
        if name == "$skip":
            skip, limit = skip + n, None if limit is None else max(0, limit - n)
        else:
            limit = n if limit is None else min(limit, n)
    return Stream(finding.between(now.df, now.columns(), skip, limit), now.order, now.hidden) if skip or limit is not None else now


def _count(now: Stream, spec: object) -> Stream:
    if not isinstance(spec, str):
        fail("VAL_INVALID_SHAPE", "$count takes a field's name")
    name = V.field_name(spec)
    if name in ("_id", "_v", "_ts"):
        fail("VAL_PROTECTED_FIELD", name)
    return Stream(now.df.agg(F.count(F.lit(1)).alias(name)), [(name, 1)])


def _unwind(now: Stream, spec: object) -> Stream:
    """A row for each element; elements keep their order after the row's. Missing, null and empty go, or stay with their shape."""
    if isinstance(spec, str):
        spec = {"path": spec}
    if not isinstance(spec, dict) or set(spec) - {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"} or not isinstance(spec.get("path"), str) or not spec["path"].startswith("$"):
        fail("VAL_INVALID_SHAPE", "$unwind takes a path")
    preserve = spec.get("preserveNullAndEmptyArrays", False)
    if not isinstance(preserve, bool):
        fail("VAL_INVALID_SHAPE", "preserveNullAndEmptyArrays")
    parts = paths.parse(spec["path"][1:])
    at = paths.resolve(parts, now.schema)
    if not at.absent and not at.one:
        fail("VAL_UNSUPPORTED_COMBINATION", "$unwind of a path through an array")
    index = spec.get("includeArrayIndex")
    if index is not None:
        V.field_name(index)
        if index in now.schema.names:
            fail("VAL_CONFLICTING_PATHS", index)
    if at.absent:
        return now if preserve else Stream(now.df.where(F.lit(False)), now.order, now.hidden)
    if not isinstance(at.type, T.ArrayType):
        fail("TYPE_MISMATCH", "$unwind of a value that is no array")
    now = _kept_order(now)
    name, at_name = parts[0], f"{HIDDEN}_{len(now.hidden)}_at"
    explode = F.posexplode_outer if preserve else F.posexplode
    others = [F.col(f"`{n}`") for n in now.df.columns]
    df = now.df.select(*others, explode(at.value).alias(at_name, "__x"))
    # Without the element an empty array and null look alike: both keep no value here, as the column now has the element's type.
    inner = F.col("__x") if len(parts) == 1 else F.col(f"`{name}`").withField(".".join(f"`{p}`" for p in parts[1:]), F.col("__x"))
    df = df.withColumn(name, inner).drop("__x")
    if index is not None:
        df = df.withColumn(index, F.col(at_name).cast("long"))
    shown = [f.name for f in df.schema if f.name not in (*now.hidden, at_name)]
    return Stream(df.select(*(F.col(f"`{n}`") for n in shown), *now.hidden, at_name), [*now.order, (at_name, 1)], (*now.hidden, at_name))


def _divide(total: Column, kind: T.DataType, n: Column) -> Column:
    """total / n with 34 digits, half even; null for n = 0."""
    precision, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
    if precision <= 32:
        return decimals.divide(total, scale, n)
    return _divide_wide(total.cast("string"), n)


@F.pandas_udf(decimals.KIND)
def _divide_wide(total: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The same for quotients that the built-in division can't hold."""
    out = [None if not c else decimals.parts(Fraction(V.DECIMAL.divide(Decimal(t), Decimal(int(c)))))[:2] for t, c in zip(total, n, strict=True)]
    return pd.DataFrame([(None, None) if x is None else (x[0], Decimal(x[1])) for x in out], columns=decimals.KIND.names)


def _group(now: Stream, spec: object) -> Stream:
    """Groups by equal keys, in the keys' order; missing and null are different keys."""
    if not isinstance(spec, dict) or "_id" not in spec:
        fail("VAL_INVALID_SHAPE", "$group takes _id and accumulators")
    schema = now.schema
    key = expression(spec["_id"], schema)
    outs = {}
    for name, acc in spec.items():
        if name == "_id":
            continue
        V.field_name(name)
        if not isinstance(acc, dict) or len(acc) != 1:
            fail("VAL_INVALID_SHAPE", "a group's field takes one accumulator")
        (op, x), = acc.items()
        if op not in ACCUMULATORS:
            fail("VAL_UNKNOWN_OPERATOR", op)
        if op == "$count" and x != {}:
            fail("VAL_INVALID_SHAPE", "$count takes {}")
        outs[name] = (op, None if op == "$count" else expression(x, schema))
    value = F.lit(None).cast("string") if key.type is None else _or_null(key)
    keys = {"__k": value, "__kp": F.lit(True) if key.always else F.coalesce(key.present, F.lit(False))}
    ins = {f"__v{k}": _or_null(e) for k, (_, e) in enumerate(outs.values()) if e is not None and e.type is not None}
    there = {f"__p{k}": e.present for k, (_, e) in enumerate(outs.values()) if e is not None and e.type is not None and not e.always}
    keep = [n for n, _ in now.order]
    df = now.df.select(*(c.alias(n) for n, c in (keys | ins | there).items()), *(F.col(f"`{n}`") for n in keep))
    ordinal = _ordinal(now.order)
    aggs, late, floats = [], [], []
    for k, (name, (op, e)) in enumerate(outs.items()):
        v, present = F.col(f"__v{k}"), F.col(f"__p{k}") if f"__p{k}" in there else F.lit(True)
        if op == "$count":
            aggs.append(F.count(F.lit(1)).alias(name))
        elif op in ("$min", "$max"):
            if e.type is None:
                continue
            # Null is lowest; of equal values the first in order stands for all.
            rank = F.struct(v.isNotNull().alias("some"), v.alias("v"))
            pick = F.min_by(v, F.when(present, F.struct(rank, ordinal))) if op == "$min" else F.max(F.when(present, rank))["v"]
            aggs.append(pick.alias(name))
        else:
            name_in = f"__s{k}"
            kind = e.type
            if kind is None:
                late.append((name, F.lit(0).cast("long") if op == "$sum" else F.lit(None).cast("double")))
                continue
            if logical_type(kind) not in V.NUMERIC:
                fail("TYPE_MISMATCH", f"{op} of {logical_type(kind)}")
            aggs.append(F.count(v).alias(f"__n{k}"))
            if logical_type(kind) == "float64":
                floats.append((k, name_in))
                got = F.col(name_in)
                late.append((name, F.coalesce(got, F.lit(0.0)) if op == "$sum" else F.when(F.col(f"__n{k}") > 0, got / F.col(f"__n{k}"))))
                continue
            scale = kind.scale if isinstance(kind, T.DecimalType) else 0
            aggs.append(F.sum(v.cast(T.DecimalType(38, scale))).alias(name_in))
            total = F.coalesce(F.col(name_in), F.lit(0).cast(T.DecimalType(38, scale)))
            if op == "$sum" and not isinstance(kind, T.DecimalType):
                inside = total.between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63 - 1)))
                late.append((name, F.when(inside, total.cast("long")).otherwise(F.raise_error(F.lit("TYPE_NUMERIC_OVERFLOW")).cast("long"))))
            elif op == "$sum":
                late.append((name, decimals.to_34_digits(total, scale)))
            else:
                late.append((name, _divide(total, kind, F.col(f"__n{k}"))))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("__any")]
    if key.type is not None and logical_type(key.type) == "float64":
        # Both zeros are one key; the first in order stands for the group.
        aggs.append(F.min_by("__k", ordinal).alias("__shown"))
    grouped = df.groupBy("__k", "__kp").agg(*aggs)
    if floats:
        grouped = _with_float_sums(df, grouped, floats, now.order)
    made = dict(late)
    cols = [F.col("__shown" if "__shown" in grouped.columns else "__k").alias("_id")] + [(made[n] if n in made else F.col(f"`{n}`")).alias(n) for n in outs if n in made or n in grouped.columns]
    out = grouped.select(*cols, F.col("__kp").alias(f"{HIDDEN}_p"), F.col("__k").alias(f"{HIDDEN}_k"))
    return Stream(out, [(f"{HIDDEN}_p", 1), (f"{HIDDEN}_k", 1)], (f"{HIDDEN}_p", f"{HIDDEN}_k"))


def _ordinal(order: list[tuple[str, int]]) -> Column:
    """Something orderable that follows an ascending order; a descending one can't be a struct, so only rows decide there."""
    return F.struct(*(F.col(f"`{n}`") for n, way in order if way == 1)) if any(w == 1 for _, w in order) else F.struct(F.lit(0))


def _with_float_sums(df: DataFrame, grouped: DataFrame, floats: list[tuple[int, str]], order: list[tuple[str, int]]) -> DataFrame:
    """Sums of floats that don't depend on partitions: left folds of chunks of CHUNK values by ordinal, combined pairwise.

    Rows are dealt by ranges of key and order, so a large group lies in many
    tasks, and stored with their places; a value's ordinal is its place in its
    part plus what the group has in earlier parts. Chunks and blocks of CHUNK
    chunks are folded apart: no task sees more than CHUNK values of a group at
    a time.
    """
    sort = [F.col(f"`{n}`").asc_nulls_first() if way == 1 else F.col(f"`{n}`").desc_nulls_last() for n, way in order]
    same = lambda x: F.col("__k").eqNullSafe(F.col(f"k{x}")) & F.col("__kp").eqNullSafe(F.col(f"p{x}"))
    key = lambda x: (F.col("__k").alias(f"k{x}"), F.col("__kp").alias(f"p{x}"))
    for k, name in floats:
        v = F.col(f"__v{k}")
        rows = df.where(v.isNotNull()).select("__k", "__kp", v.cast("double").alias("v"), *(F.col(f"`{n}`") for n, _ in order))
        by = [F.col("__k").asc_nulls_first(), F.col("__kp").asc_nulls_first(), *sort]
        dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        dealt = stored(dealt.select("__k", "__kp", "v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
        held = dealt.groupBy("__k", "__kp", "part").agg(F.count("*").alias("n"), F.min("place").alias("begin"))
        earlier = W.partitionBy("__k", "__kp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
        held = held.select(*key(1), F.col("part").alias("part1"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"))
        at = F.col("place") + F.col("shift")
        rows = dealt.join(held, same(1) & (F.col("part") == F.col("part1"))).select("__k", "__kp", F.floor(at / CHUNK).alias("chunk"), at.alias("at"), "v")
        sums = rows.groupBy("__k", "__kp", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("xs"))
        sums = sums.select("__k", "__kp", "chunk", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["v"]).alias("s"))
        most = dealt.groupBy("__k", "__kp").count().agg(F.max("count")).first()[0] or 0
        left = -(-most // CHUNK)
        while left > 1:
            sums = sums.groupBy("__k", "__kp", F.floor(F.col("chunk") / CHUNK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("cs"))
            sums = sums.select("__k", "__kp", F.col("block").alias("chunk"), _pairwise(F.transform("cs", lambda c: c["s"])).alias("s"))
            left = -(-left // CHUNK)
        grouped = grouped.join(sums.select(*key(2), F.col("s").alias(name)), same(2), "left").drop("k2", "p2")
    return grouped


def _pairwise(xs: Column) -> Column:
    """The balanced pairwise sum of at most CHUNK numbers."""

    def halved(x: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(x), F.get(x, 2 * i) + F.get(x, 2 * i + 1)).otherwise(F.get(x, 2 * i)))

    out = F.array(xs)
    for _ in range(CHUNK.bit_length() - 1):
        out = F.transform(out, halved)
    return out[0][0]
