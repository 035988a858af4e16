"""Updates as post-image expressions: every operator reads the row as it was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths
from ..errors import fail
from ..functions import values as V
from .filters import compare, literal_column, logical_type
from .pipeline import _typed

OPERATORS = ("$set", "$unset", "$inc", "$setOnInsert", "$push", "$addToSet", "$pop", "$pull")
UNSUPPORTED = ("$rename", "$mul", "$min", "$max", "$currentDate", "$bit")
PROTECTED = ("_id", "_v", "_ts")


def validate(update: object, ids: tuple[str, ...] = ("_id",)) -> list[tuple[str, list[str], object]]:
    """(operator, path, operand) of an update; equal and nested paths are in conflict."""
    if not isinstance(update, dict) or not update:
        fail("VAL_INVALID_SHAPE", "an update names its operators")
    out = []
    for op, spec in update.items():
        if op in UNSUPPORTED:
            fail("CAP_UNSUPPORTED_FEATURE", op)
        if op not in OPERATORS:
            fail("VAL_UNKNOWN_OPERATOR", op)
        if not isinstance(spec, dict) or not spec:
            fail("VAL_INVALID_SHAPE", op)
        for path, operand in spec.items():
            if isinstance(path, str) and any(p.startswith("$") for p in path.split(".")):
                fail("CAP_UNSUPPORTED_FEATURE", "positional paths")
            parts = paths.parse(path)
            if parts[0] in PROTECTED or parts[0] in ids:
                fail("VAL_PROTECTED_FIELD", path)
            out.append((op, parts, operand))
    named = sorted(p for _, p, _ in out)
    for a, b in zip(named, named[1:], strict=False):
        if b[: len(a)] == a:
            fail("VAL_CONFLICTING_PATHS", ".".join(b))
    return out


def _items(operand: object, op: str, more: set[str] = frozenset()) -> tuple[list[V.Value], dict]:
    if isinstance(operand, dict) and "$each" in operand:
        if set(operand) - {"$each"} - more or not isinstance(operand["$each"], list):
            fail("VAL_INVALID_SHAPE", op)
        return [V.literal(x) for x in operand["$each"]], operand
    return [V.literal(operand)], {}


def _array_of(c: Column, kind: T.DataType, op: str) -> T.ArrayType:
    return kind if isinstance(kind, T.ArrayType) else fail("TYPE_MISMATCH", f"{op} of a value that is no array")


def _element(kind: T.ArrayType, v: V.Value) -> Column:
    x = literal_column(kind.elementType, v)
    return fail("TYPE_MISMATCH", f"{v.type} in an array of {logical_type(kind.elementType)}") if x is None else x


def _new_value(op: str, operand: object, c: Column | None, kind: T.DataType | None) -> Column | None:
    """The field's post-image; None drops it. c and kind are None for a field that isn't there."""
    if op in ("$set", "$setOnInsert"):
        v = V.literal(operand)
        same = literal_column(kind, v) if kind is not None else None
        return same if same is not None else _typed(v)[1]
    if op == "$unset":
        if operand is not True and operand != 1:
            fail("VAL_INVALID_SHAPE", "$unset takes true or 1")
        return None
    if op == "$inc":
        v = V.literal(operand)
        if v.type not in V.NUMERIC:
            fail("TYPE_MISMATCH", "$inc takes a number")
        if c is None:
            return _typed(v)[1]
        name = logical_type(kind)
        if name not in V.NUMERIC:
            fail("TYPE_MISMATCH", f"$inc of {name}")
        if {name, v.type} >= {"decimal128", "float64"}:
            fail("TYPE_MISMATCH", "decimal and float")
        delta = _typed(v)[1]
        bad = F.raise_error(F.lit("TYPE_MISMATCH"))
        if name in ("int32", "int64") and v.type in ("int32", "int64"):
            total = F.try_add(c.cast("long"), delta.cast("long"))
            wide = F.when(total.isNull() & c.isNotNull(), F.raise_error(F.lit("TYPE_NUMERIC_OVERFLOW")).cast("long")).otherwise(total)
        elif "float64" in (name, v.type):
            wide = c.cast("double") + delta.cast("double")
        else:
            scale = max(kind.scale if isinstance(kind, T.DecimalType) else 0, -v.value.as_tuple().exponent if v.type == "decimal128" else 0)
            wide = (c.cast(T.DecimalType(38, scale)) + delta.cast(T.DecimalType(38, scale))).cast(T.DecimalType(38, scale))
        return F.when(c.isNull(), bad.cast("double") if "float64" in (name, v.type) else bad.cast("long") if name in ("int32", "int64") else bad.cast("decimal(38,0)")).otherwise(wide)
    if op == "$push":
        items, options = _items(operand, op, {"$position"})
        at = options.get("$position")
        if at is not None and (isinstance(at, bool) or not isinstance(at, int) or at < 0):
            fail("VAL_INVALID_SHAPE", "$position takes a nonnegative integer")
        if c is None:
            return F.array(*(_typed(v)[1] for v in items))
        new = F.array(*(_element(_array_of(c, kind, op), v) for v in items)).cast(kind)
        if at is None:
            return F.concat(c, new)
        return F.concat(F.slice(c, 1, F.least(F.lit(at), F.size(c))), new, F.slice(c, F.least(F.lit(at), F.size(c)) + 1, F.greatest(F.size(c) - at, F.lit(0))))
    if op == "$addToSet":
        items, _ = _items(operand, op)
        distinct = list(dict.fromkeys(items))
        if c is None:
            return F.array(*(_typed(v)[1] for v in distinct))
        kind = _array_of(c, kind, op)
        each = [(v, _element(kind, v)) for v in distinct]
        return reduce(lambda a, x: F.when(F.exists(c, lambda y: F.coalesce(compare("$eq", y, kind.elementType, x[0]), F.lit(False))), a).otherwise(F.concat(a, F.array(x[1]).cast(kind))), each, c)
    if op == "$pop":
        if isinstance(operand, bool) or operand not in (1, -1):
            fail("VAL_INVALID_SHAPE", "$pop takes 1 or -1")
        if c is None:
            return None
        _array_of(c, kind, op)
        left = F.greatest(F.size(c) - 1, F.lit(0))
        return F.slice(c, 1 if operand == 1 else 2, left)
    v = V.literal(operand)  # $pull
    if c is None:
        return None
    kind = _array_of(c, kind, op)
    return F.filter(c, lambda x: ~F.coalesce(compare("$eq", x, kind.elementType, v), F.lit(False)))


#: Operators that leave a value where there was none.
CREATING = ("$set", "$setOnInsert", "$inc", "$push", "$addToSet")


def _alias(c: Column, name: str, field: T.StructField | None, sign: str | None) -> Column:
    metadata = (dict(field.metadata) if field is not None else {}) | ({paths.PRESENCE: sign} if sign else {})
    return c.alias(name, metadata=metadata) if metadata else c.alias(name)


def _patched(c: Column | None, kind: T.DataType | None, tree: dict, target: Column, path: str, signs: dict[str, str]) -> Column | None:
    """An object after the operators in the tree: name -> (operator, operand) or another tree.

    Rows outside the target keep their values; fields that the update creates
    are null there.
    """
    if kind is not None and not isinstance(kind, T.StructType):
        fail("TYPE_MISMATCH", "a path steps through a value that is no object")
    old = {f.name: f for f in kind} if kind is not None else {}
    parts = []
    for name in [*old, *(n for n in tree if n not in old)]:
        here, field = (c.getField(name), old[name]) if name in old else (None, None)
        below = f"{path}.{name}"
        new = here if name not in tree else _field_after(tree[name], here, field, target, below, signs)
        if new is not None:
            parts.append(_alias(new, name, field, signs.get(below)))
    if not parts:
        return None
    return F.struct(*parts) if c is None else F.when(c.isNotNull() | target, F.struct(*parts))


def _field_after(node, old: Column | None, field: T.StructField | None, target: Column, path: str, signs: dict[str, str]) -> Column | None:
    kind = field.dataType if field is not None else None
    if isinstance(node, dict):
        new = _patched(old, kind, node, target, path, signs)
        return F.when(target, new) if old is None and new is not None else new
    op, operand = node
    new = _new_value(op, operand, old, kind)
    if old is None:
        return None if new is None else F.when(target, new)
    there = paths.marked(field, path)
    if there is not None and op in ("$inc", "$push", "$addToSet"):  # a row that lacks the field starts from nothing
        new = F.when(there, new).otherwise(_new_value(op, operand, None, None).cast(kind))
    return F.when(target, F.lit(None).cast(kind) if new is None else new).otherwise(old)


def _find_field(schema: T.StructType, parts: list[str]) -> T.StructField | None:
    kind, field = schema, None
    for p in parts:
        if not isinstance(kind, T.StructType) or p not in kind.names:
            return None
        field = kind[p]
        kind = field.dataType
    return field


def _without_below(marks: Column, path: str) -> Column:
    """The marks but those of fields below a path."""
    return F.filter(marks, lambda m: ~F.startswith(F.substring(m, 2, 1 << 30), F.lit(path + ".")))


def _marks(df: DataFrame, steps: list, target: Column) -> tuple[Column | None, dict[str, str]]:
    """(which fields a row has or lacks after the steps, signs of the fields that rows may lack). None: every row has all its fields."""
    signs: dict[str, str] = {}
    now = paths.seen() if paths.SEEN in df.columns else F.array().cast("array<string>")
    changed = paths.SEEN in df.columns
    put = lambda c, mark: F.array_union(c, F.array(F.lit(mark)))
    for op, parts, _ in steps:
        path, field = ".".join(parts), _find_field(df.schema, parts)
        sign = field.metadata.get(paths.PRESENCE) if field is not None else "+"
        after = _without_below(now, path)
        if op == "$unset":
            if field is None:
                continue
            sign = sign or "-"
            after = put(after, "-" + path) if sign == "-" else F.array_remove(after, "+" + path)
        elif op in CREATING:
            if sign == "+":
                after = put(after, "+" + path)
            elif sign == "-":
                after = F.array_remove(after, "-" + path)
            for k in range(1, len(parts)):  # objects on the way are there now; one that was not lacks its other fields
                above, held = ".".join(parts[:k]), _find_field(df.schema, parts[:k])
                if held is None:
                    signs[above] = "+"
                    after = put(after, "+" + above)
                    continue
                here = paths.resolve(parts[:k], df.schema)
                lacks = ~here.present | here.value.isNull()
                if held.metadata.get(paths.PRESENCE) == "+":
                    after = put(after, "+" + above)
                after = F.array_remove(after, "-" + above)
                for f in held.dataType if isinstance(held.dataType, T.StructType) else ():
                    if f.metadata.get(paths.PRESENCE) != "+" and not any(p[: k + 1] == [*parts[:k], f.name] for _, p, _ in steps):
                        signs[f"{above}.{f.name}"] = "-"
                        after = F.when(lacks, put(after, f"-{above}.{f.name}")).otherwise(after)
        else:
            continue
        if sign:
            signs[path] = sign
        changed = changed or bool(sign) or bool(signs)
        now = F.when(target, after).otherwise(now)
    return (now if changed else None), signs


def post_image(df: DataFrame, update: object, target: Column, ids: tuple[str, ...] = ("_id",), inserting: bool = False) -> DataFrame:
    """df after the update of the rows where target holds.

    Fields that the update creates are null elsewhere and unset ones become
    null; which of these nulls mean that a row has no such field is kept in
    the column SEEN, and in the fields' metadata, which paths ask.
    """
    steps = [s for s in validate(update, ids) if inserting or s[0] != "$setOnInsert"]
    tree: dict = {}
    for op, parts, operand in steps:
        at = tree
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = (op, operand)
    marks, signs = _marks(df, steps, target)
    out = []
    for name in [*(c for c in df.columns if c != paths.SEEN), *(n for n in tree if n not in df.columns)]:
        field = df.schema[name] if name in df.columns else None
        old = F.col(f"`{name}`") if field is not None else None
        if name not in tree:
            out.append(old)
            continue
        new = _field_after(tree[name], old, field, target, name, signs)
        if new is not None:
            out.append(_alias(new, name, field, signs.get(name)))
    return df.select(*out, *([marks.alias(paths.SEEN)] if marks is not None else []))
