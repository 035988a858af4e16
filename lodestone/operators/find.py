"""find and count: filter, exact top-k, order, skip, limit, projection."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits, paths
from ..errors import fail
from ..sources.folders import stored
from . import vectors
from .filters import Context, compile_filter, split_top_k, ttl_state

OPTIONS = ("find", "filter", "projection", "sort", "skip", "limit")
PLACE = "__place"


@dataclass(frozen=True)
class Source:
    """A collection's rows: its id columns (the default order), and its expiry path if it has one."""

    df: DataFrame
    id: tuple[str, ...] = ("_id",)
    ttl: str | None = None
    now: dt.datetime | None = None

    def context(self) -> Context:
        return Context(self.df.schema, self.now, self.ttl)

    def expired(self) -> Column:
        """Whether a row has expired at the pinned time."""
        return F.lit(False) if self.ttl is None else ttl_state(self.context(), "expired")

    def visible(self) -> DataFrame:
        """Rows that have not expired at the pinned time."""
        return self.df if self.ttl is None else self.df.where(~self.expired())

    def shown(self) -> DataFrame:
        """All rows without what the collection keeps for itself."""
        return self.df.drop(paths.SEEN)

    def with_rows(self, df: DataFrame) -> Source:
        return replace(self, df=df)


def order_columns(spec: object, schema: T.StructType) -> list[Column]:
    """1 to 64 paths with 1 or -1. Null sorts lowest; a path that fans out is an error, an undeclared one orders nothing."""
    if not isinstance(spec, dict) or not spec:
        fail("VAL_INVALID_SHAPE", "a sort names its keys")
    limits.check("sort.keys", len(spec))
    out = []
    for path, way in spec.items():
        if isinstance(way, bool) or way not in (1, -1):
            fail("VAL_INVALID_SHAPE", "a sort key takes 1 or -1")
        at = paths.resolve(paths.parse(path), schema)
        if not at.absent and not at.one:
            fail("VAL_UNSUPPORTED_COMBINATION", f"{path} has several values")
        if at.absent:
            continue
        keys = [at.value] if at.always else [at.present, at.value]  # missing comes before null
        out += [k.asc_nulls_first() if way == 1 else k.desc_nulls_last() for k in keys]
    return out


#: Fixed value: the one collation, by bytes of UTF-8, which is Spark's own order of strings.
COLLATION = "binary_utf8_v1"


def without_collation(command: dict) -> dict:
    """The command without its collation, which may only be the one there is."""
    if "collation" not in command:
        return command
    if command["collation"] != COLLATION:
        fail("CAP_UNSUPPORTED_FEATURE", f"collation {command['collation']!r}")
    return {k: v for k, v in command.items() if k != "collation"}


def position(x: object, what: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 0:
        fail("VAL_INVALID_SHAPE", f"{what} takes a nonnegative integer")
    return x


#: So many ordered rows are kept in one task at most; positions beyond are found in rows that are stored in order.
MOST_KEPT = 10_000


def between(df: DataFrame, order: list[Column], skip: int, limit: int | None) -> DataFrame:
    """The rows of df in an order, without the first `skip`, and of the rest the first `limit`. No task counts all rows.

    Rows dealt by ranges and sorted get ids that rise with their places, so positions are bounds of the id once the rows of
    each part are counted.
    """
    if not skip and limit is None:
        return df.orderBy(*order)
    if limit is not None and skip + limit <= MOST_KEPT:
        return df.orderBy(*order).limit(skip + limit).offset(skip)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn(PLACE, F.monotonically_increasing_id()))
    parts = dealt.groupBy(F.shiftright(PLACE, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()

    def place(at: int) -> int | None:
        """The id at a position; None: no row is there."""
        for part, n in parts:
            if at < n:
                return (part << 33) + at
            at -= n
        return None

    begin, end = place(skip), None if limit is None else place(skip + limit)
    kept = dealt.where(F.lit(False) if begin is None else F.col(PLACE) >= begin)
    return (kept if end is None else kept.where(F.col(PLACE) < end)).drop(PLACE).orderBy(*order)


def _sign(v: object) -> bool:
    if isinstance(v, bool):
        return v
    return v == 1 if isinstance(v, int) and v in (0, 1) else fail("VAL_INVALID_SHAPE", "a projection takes 0, 1 or a Boolean")


def _tree(spec: dict) -> dict:
    """Paths as a tree; a path and its ancestor are in conflict."""
    out: dict = {}
    for path in spec:
        at = out
        parts = paths.parse(path)
        for k, p in enumerate(parts):
            if k == len(parts) - 1:
                if p in at:
                    fail("VAL_CONFLICTING_PATHS", path)
                at[p] = None
            else:
                at = at.setdefault(p, {})
                if at is None:
                    fail("VAL_CONFLICTING_PATHS", path)
    return out


def _included(c: Column, kind: T.DataType, tree: dict) -> Column | None:
    """An object with the tree's fields only, in its own order; null stays null. None: nothing of it is left."""
    if not isinstance(kind, T.StructType):
        return None
    fields = []
    for f in kind:
        if f.name in tree:
            inner = c.getField(f.name) if tree[f.name] is None else _included(c.getField(f.name), f.dataType, tree[f.name])
            if inner is not None:
                fields.append(inner.alias(f.name, metadata=f.metadata))
    return F.when(c.isNotNull(), F.struct(*fields)) if fields else None


def _excluded(c: Column, kind: T.DataType, tree: dict) -> Column:
    if not isinstance(kind, T.StructType):
        return c
    left = [f for f in kind if tree.get(f.name, {}) is not None]
    if not left:
        return F.when(c.isNotNull(), F.struct())
    return F.when(c.isNotNull(), F.struct(*((_excluded(c.getField(f.name), f.dataType, tree[f.name]) if f.name in tree else c.getField(f.name)).alias(f.name) for f in left)))


def project(df: DataFrame, spec: object, ids: tuple[str, ...]) -> DataFrame:
    """Inclusion in source order, with the id unless it is put to 0, or exclusion."""
    if not isinstance(spec, dict):
        fail("VAL_INVALID_SHAPE", "a projection is an object")
    limits.check("projection.paths", len(spec))
    if not spec:
        return df
    ways = {p: _sign(v) for p, v in spec.items()}
    rest = {p: w for p, w in ways.items() if p not in ids}
    if len(set(rest.values())) > 1:
        fail("VAL_UNSUPPORTED_COMBINATION", "inclusion and exclusion together")
    including = next(iter(rest.values())) if rest else next(iter(ways.values()))
    if not including and any(ways.values()) and rest:
        ways = rest | {p: w for p, w in ways.items() if not w}
    tree = _tree({p: w for p, w in ways.items() if w == including})
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if including:
            if f.name in ids and ways.get(f.name, True):
                out.append(c)
            elif f.name in tree:
                inner = c if tree[f.name] is None else _included(c, f.dataType, tree[f.name])
                if inner is not None:
                    out.append(inner.alias(f.name))
        elif f.name not in tree:
            out.append(c)
        elif tree[f.name] is not None:
            out.append(_excluded(c, f.dataType, tree[f.name]).alias(f.name))
    return df.select(*out)


def find(source: Source, command: dict) -> DataFrame:
    """{find, filter, projection?, sort?, skip?, limit?}. Rows come in the sort's order, or by rank, or by id."""
    for key in command:
        if key not in OPTIONS:
            fail("VAL_UNKNOWN_OPTION", key)
    limits.check_tree(command)
    spec, top = split_top_k(command.get("filter", {}))
    condition = compile_filter(spec, source.context())
    skip = position(command.get("skip", 0), "skip")
    limit = command.get("limit")
    df = source.visible().where(condition)
    ids = [F.col(f"`{c}`").asc_nulls_first() for c in source.id]
    if top:
        if "sort" in command:
            fail("VAL_UNSUPPORTED_COMBINATION", "$vectorTopK brings its own order")
        df, order = ranked(df, top, ids)
    elif "sort" in command:
        named = {p for p in command["sort"]} if isinstance(command["sort"], dict) else set()
        order = order_columns(command["sort"], df.schema) + [c for c, n in zip(ids, source.id, strict=True) if n not in named]
    else:
        order = ids
    df = between(df, order, skip, None if limit is None else position(limit, "limit"))
    if top:
        df = df.drop("__score")
    return (project(df, command["projection"], source.id) if "projection" in command else df).drop(paths.SEEN)


def ranked(df: DataFrame, top, ids: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The k best rows by score, then id, with their score as __score."""
    at = paths.resolve(paths.parse(top.path), df.schema)
    if at.absent or not vectors.is_vector(at.type) or not at.one:
        return df.where(F.lit(False)).withColumn("__score", F.lit(None).cast("double")), ids
    df = df.withColumn("__score", F.when(at.present, vectors.score(at.value, top.vector, top.metric))).where("__score is not null")
    if top.threshold is not None:
        df = df.where(vectors._within(F.col("__score"), top.metric, top.threshold, top.inclusive))
    best = F.col("__score").desc() if top.metric == "dot" else F.col("__score").asc()
    order = [best, *ids]
    return df.orderBy(*order).limit(top.k), order


def count(source: Source, command: dict) -> DataFrame:
    """{count, filter, skip?, limit?}: one row, n."""
    for key in command:
        if key not in ("count", "filter", "skip", "limit"):
            fail("VAL_UNKNOWN_OPTION", key)
    df = source.visible().where(compile_filter(command.get("filter", {}), source.context()))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    # Skip and limit only change the number: no order is needed.
    skip = position(command.get("skip", 0), "skip")
    n = n.select(F.greatest(F.col("n") - skip, F.lit(0)).cast("long").alias("n"))
    return n if "limit" not in command else n.select(F.least(F.col("n"), F.lit(position(command["limit"], "limit"))).cast("long").alias("n"))
