"""Lossless typed JSON: documents as strings that keep every type, payload and the order of fields."""

from __future__ import annotations

import json
import struct
import uuid
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits
from ..errors import EngineError, fail
from . import values as V


def spell(v: V.Value) -> dict:
    """The tagged form that V.tagged reads."""
    x = v.value
    if v.type == "null":
        return {"type": "null"}
    if v.type in ("bool", "string"):
        return {"type": v.type, "value": x}
    if v.type in ("int32", "int64"):
        return {"type": v.type, "value": str(x)}
    if v.type == "float64":
        return {"type": v.type, "bits": struct.pack(">d", x).hex()}
    if v.type == "decimal128":
        return {"type": v.type, "value": str(x)}
    if v.type == "binary":
        return {"type": v.type, "subtype": x[0], "hex": x[1].hex()}
    if v.type == "timestamp":
        return {"type": v.type, "microseconds": str(x)}
    if v.type == "date":
        return {"type": v.type, "days": str(x)}
    if v.type == "uuid":
        return {"type": v.type, "value": str(uuid.UUID(bytes=x))}
    if v.type == "objectId":
        return {"type": v.type, "value": x.hex()}
    if v.type == "array":
        return {"type": v.type, "values": [spell(y) for y in x]}
    if v.type == "object":
        return {"type": v.type, "fields": [{"name": k, "value": spell(y)} for k, y in x.items()]}
    if v.type.startswith("vector"):
        code = ">f" if v.type.endswith("32") else ">e"
        return {"type": "vector", "element": v.type[-3:], "dimension": len(x), "bits": [struct.pack(code, y).hex() for y in x]}
    return fail("VAL_INVALID_LITERAL", v.type)


def dumps(v: V.Value) -> str:
    return json.dumps(spell(v), ensure_ascii=False, separators=(",", ":"))


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    return out if len(out) == len(pairs) else fail("VAL_DUPLICATE_FIELD")


def loads(text: str) -> V.Value:
    """Strict: no repeated names, all limits, one root object with an id of an accepted type."""
    try:
        raw = json.loads(text, object_pairs_hook=_pairs)
    except json.JSONDecodeError as e:
        raise EngineError("PAR_INVALID_JSON", str(e)) from e
    names = [f.get("name") for f in _objects(raw)]
    limits.check("document.total_fields", len(names))
    v = V.tagged(raw)
    check_document(v)
    return v


def _objects(x: object):
    stack = [x]
    while stack:
        y = stack.pop()
        if isinstance(y, dict):
            if isinstance(y.get("fields"), list):
                given = [f.get("name") if isinstance(f, dict) else None for f in y["fields"]]
                if len(set(given)) != len(given):
                    fail("VAL_DUPLICATE_FIELD")
                yield from (f for f in y["fields"] if isinstance(f, dict))
            stack += list(y.values())
        elif isinstance(y, list):
            stack += y


def check_document(v: V.Value) -> None:
    if v.type != "object":
        fail("VAL_INVALID_SHAPE", "a document is an object")
    if "_id" not in v.value:
        fail("VAL_INVALID_SHAPE", "a document has an _id")
    key = v.value["_id"]
    if key.type not in ("int32", "int64", "string", "uuid", "objectId") and not (key.type == "binary" and key.value[0] == 0):
        fail("TYPE_MISMATCH", f"an _id of type {key.type}")
    if key.type in ("string", "binary"):
        limits.check("id.payload_bytes", len(key.value.encode() if key.type == "string" else key.value[1]))
    stack = [(v, 1)]
    while stack:
        x, depth = stack.pop()
        limits.check("document.depth", depth)
        if x.type == "object":
            limits.check("object.fields", len(x.value))
            stack += [(y, depth + 1) for y in x.value.values()]
        elif x.type == "array":
            limits.check("array.elements", len(x.value))
            stack += [(y, depth + 1) for y in x.value]


def _tag(c: Column, kind: T.DataType, path: str | None = None) -> Column:
    """A typed column as tagged JSON text, in built-in functions. path: where it stands in the row; None below an array."""
    from ..operators.filters import logical_type

    name = logical_type(kind)
    quoted = lambda s: F.to_json(F.struct(s.alias("value")))
    typed = lambda payload: F.concat(F.lit(f'{{"type":"{name}",'), payload, F.lit("}"))
    if name == "bool":
        text = typed(F.concat(F.lit('"value":'), c.cast("string")))
    elif name == "string":
        text = F.concat(F.lit('{"type":"string",'), F.substring(quoted(c), 2, 2**31 - 1))
    elif name == "float64":
        text = typed(F.concat(F.lit('"value":"'), F.when(F.isnan(c), F.lit("nan")).otherwise(F.regexp_replace(c.cast("double").cast("string"), "Infinity", "inf")), F.lit('"')))
    elif name == "timestamp":
        text = typed(F.concat(F.lit('"microseconds":"'), F.unix_micros(c.cast("timestamp")).cast("string"), F.lit('"')))
    elif name == "date":
        text = typed(F.concat(F.lit('"days":"'), F.datediff(c, F.lit("1970-01-01").cast("date")).cast("string"), F.lit('"')))
    elif name == "binary":
        text = typed(F.concat(F.lit('"subtype":0,"hex":"'), F.lower(F.hex(c)), F.lit('"')))
    elif name == "array":
        text = typed(F.concat(F.lit('"values":['), F.array_join(F.transform(c, lambda x: _tag(x, kind.elementType)), ","), F.lit("]")))
    elif name == "object":
        text = typed(F.concat(F.lit('"fields":['), F.concat_ws(",", *(_named(f, c.getField(f.name), None if path is None else f"{path}.{f.name}") for f in kind)), F.lit("]")))
    else:
        text = typed(F.concat(F.lit('"value":"'), c.cast("string"), F.lit('"')))
    return F.when(c.isNull(), F.lit('{"type":"null"}')).otherwise(text)


def _named(field: T.StructField, c: Column, path: str | None, name: str | None = None) -> Column:
    """A field's text; null, which concat_ws leaves out, in rows that lack the field."""
    from .. import paths

    text = F.concat(F.lit(f'{{"name":{json.dumps(name or field.name, ensure_ascii=False)},"value":'), _tag(c, field.dataType, path), F.lit("}"))
    there = None if path is None else paths.marked(field, path)
    return text if there is None else F.when(there, text)


#: Tasks for each core that read documents.
DEALT = 4


def dealt(rows: DataFrame) -> DataFrame:
    """rows in equal parts over all cores, for what reads documents: it works far longer for a byte than a scan, whose parts are cut by bytes."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism)


def export_documents(df: DataFrame, id: str) -> DataFrame:
    """(doc): each row as tagged JSON, with its id first as _id. Built-in functions only; a NULL is an explicit null, but in a row that lacks the field."""
    from .. import paths

    fields = [_named(df.schema[id], F.col(f"`{id}`"), id, "_id")]
    fields += [_named(f, F.col(f"`{f.name}`"), f.name) for f in df.schema if f.name not in (id, paths.SEEN)]
    return df.select(F.concat(F.lit('{"type":"object","fields":['), F.concat_ws(",", *fields), F.lit("]}")).alias("doc"))


def import_documents(df: DataFrame, column: str = "doc") -> DataFrame:
    """df with key (the order key of _id), doc (canonical) and error (a code, else null), validated in Arrow batches."""

    def run(parts):
        for part in parts:
            keys, docs, errors = [], [], []
            for text in part[column]:
                try:
                    v = loads(text) if isinstance(text, str) else fail("PAR_INVALID_JSON")
                    keys.append(V.order_key(v.value["_id"]))
                    docs.append(dumps(v))
                    errors.append(None)
                except EngineError as e:
                    keys.append(None)
                    docs.append(None)
                    errors.append(e.code)
            yield pd.DataFrame({"key": keys, "doc": docs, "error": errors})

    return df.select(column).mapInPandas(run, "key binary, doc string, error string")


def candidates(v: V.Value, parts: list[str]) -> list[V.Value]:
    """All values that a path reaches in a document, in order."""
    from ..paths import INDEX

    now = [v]
    for p in parts:
        found: list[V.Value] = []
        for x in now:
            if x.type == "object":
                found += [x.value[p]] if p in x.value else []
            elif x.type == "array" and INDEX.fullmatch(p):
                found += list(x.value[int(p) : int(p) + 1])
            elif x.type == "array":
                found += [y.value[p] for y in x.value if y.type == "object" and p in y.value]
        limits.check("path.candidates", len(found))
        now = found
    return now


#: State of a sidecar value.
MISSING, NULL, TYPED, OTHER = 0, 1, 2, 3
_SIDECAR = {"int64": ("bigint", ("int32", "int64")), "float64": ("double", ("float64",)), "string": ("string", ("string",)), "bool": ("boolean", ("bool",)), "timestamp": ("timestamp", ("timestamp",)), "decimal128": ("decimal(38,18)", ("decimal128",))}


def with_sidecar(docs: DataFrame, path: str, kind: str, name: str | None = None) -> DataFrame:
    return with_sidecars(docs, {path: (kind, name or path.replace(".", "_"))})


def with_sidecars(docs: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """docs (with doc) and, for each path -> (type, name), name__st (missing, null, typed or other), name__v and name__key, so that missing and null stay apart.

    Each document is parsed once, whatever the number of paths. Filters on the
    pair compile to plain comparisons that Parquet can push.
    """
    from ..paths import parse

    plan = []
    for path, (kind, name) in wanted.items():
        sql, types = _SIDECAR.get(kind) or fail("CAP_UNSUPPORTED_FEATURE", kind)
        plan.append((parse(path), kind, sql, types, name))

    def side(root: V.Value, parts: list[str], kind: str, types: tuple) -> tuple:
        found = candidates(root, parts)
        if len(found) != 1:
            return (MISSING if not found else OTHER, None, None)
        v = found[0]
        typed = v.type in types
        x = pd.Timestamp(v.value, unit="us") if typed and kind == "timestamp" else Decimal(v.value) if typed and kind == "decimal128" else v.value
        return (NULL if v.type == "null" else TYPED if typed else OTHER, x if typed else None, V.order_key(v))

    @F.pandas_udf("struct<" + ",".join(f"st{k}:tinyint,v{k}:{sql},key{k}:binary" for k, (_, _, sql, _, _) in enumerate(plan)) + ">")
    def resolve(texts: pd.Series) -> pd.DataFrame:
        roots = [V.tagged(json.loads(t)) for t in texts]
        out = {}
        for k, (parts, kind, _, types, _) in enumerate(plan):
            rows = [side(r, parts, kind, types) for r in roots]
            for j, column in enumerate(("st", "v", "key")):
                values = pd.Series([r[j] for r in rows], dtype=object)
                out[f"{column}{k}"] = values.astype("Int64") if kind == "int64" and column == "v" else values
        return pd.DataFrame(out)

    names = {f"{name}__{part}": F.col(f"__s.{part}{k}") for k, (*_, name) in enumerate(plan) for part in ("st", "v", "key")}
    return docs.withColumn("__s", resolve("doc")).withColumns(names).drop("__s")
