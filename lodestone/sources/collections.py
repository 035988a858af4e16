"""Collections as immutable Parquet parts that manifests list; a command reads one manifest and publishes the next.

A manifest names parts (rows) and tombstones (ids), each with the version that
wrote it; a tombstone hides its ids in all older parts. So a command writes in
proportion to the rows it changes, and parts are merged now and then.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits, paths
from ..errors import fail
from ..inputs import Inputs
from ..operators import find as finding
from ..operators import pipeline, updates
from ..operators.filters import compile_filter
from . import folders
from .cache import COMMANDS as CACHE
from .cache import Cache

WRITES = ("insertOne", "insertMany", "replaceOne", "updateOne", "updateMany", "deleteOne", "deleteMany")
READS = ("find", "count", "aggregate", "explain")


def uuid7(now: float | None = None) -> str:
    """A time-ordered UUID."""
    clock = Inputs().clock if now is None else lambda: dt.datetime.fromtimestamp(now, dt.UTC)
    return Inputs(clock).uuid7()


#: The column that keeps which fields a row lacks.
SEEN_FIELDS = paths.SEEN
#: Parts and tombstones of a manifest beyond which the next write merges them.
MOST_DELTAS = 16
SEQ = "__seq"


@dataclass
class Manifest:
    """What one version holds. parts, gone and marks list (folder, version that wrote it); base is the version that last wrote all
    rows anew; result is the keyed result that the version's command gave."""

    version: int
    id: str
    ttl: str | None
    schema: T.StructType
    parts: list[tuple[str, int]]
    gone: list[tuple[str, int]] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    result: tuple[str, str, dict] | None = None
    base: int = 0

    def encode(self) -> str:
        return json.dumps(vars(self) | {"schema": self.schema.jsonValue()}, default=str)

    @staticmethod
    def decode(text: str) -> Manifest:
        raw = json.loads(text)
        pairs = {k: [tuple(x) for x in raw[k]] for k in ("parts", "gone")}
        return Manifest(**(raw | pairs | {"schema": T.StructType.fromJson(raw["schema"]), "result": tuple(raw["result"]) if raw["result"] else None}))


def _holds(new: T.DataType, old: T.DataType) -> bool:
    """Whether files of the old type can be read as the new one: the same, or objects with more fields."""
    if isinstance(new, T.StructType) and isinstance(old, T.StructType):
        return all(f.name in new.names and _holds(new[f.name].dataType, f.dataType) for f in old)
    return new.simpleString() == old.simpleString()


def _with_signs(schema: T.StructType, signs: dict[str, str], path: str = "") -> T.StructType:
    """schema with the fields of these paths marked as ones that rows may lack."""
    out = []
    for f in schema:
        at = path + f.name
        kind = _with_signs(f.dataType, signs, at + ".") if isinstance(f.dataType, T.StructType) else f.dataType
        metadata = dict(f.metadata or {}) | ({paths.PRESENCE: signs[at]} if at in signs else {})
        out.append(T.StructField(f.name, kind, f.nullable, metadata))
    return T.StructType(out)


def _signs(schema: T.StructType, path: str = "") -> dict[str, str]:
    out = {}
    for f in schema:
        if (f.metadata or {}).get(paths.PRESENCE):
            out[path + f.name] = f.metadata[paths.PRESENCE]
        if isinstance(f.dataType, T.StructType):
            out |= _signs(f.dataType, f"{path}{f.name}.")
    return out


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """The fields of both, new ones last, marked where either is."""
    names = [*(f.name for f in old if f.name != SEEN_FIELDS), *(f.name for f in new if f.name not in old.names and f.name != SEEN_FIELDS)]
    names += [SEEN_FIELDS] if SEEN_FIELDS in old.names or SEEN_FIELDS in new.names else []
    fields = [(new if n in new.names and (n not in old.names or _holds(new[n].dataType, old[n].dataType)) else old)[n] for n in names]
    return _with_signs(T.StructType(fields), _signs(old) | _signs(new))


def _differs(new: Column, kind: T.DataType, old: Column, was: T.DataType) -> Column:
    """Whether an update changed a field; a field that it created counts unless it is null."""
    if kind.simpleString() == was.simpleString():
        return ~new.eqNullSafe(old)
    if not (isinstance(kind, T.StructType) and isinstance(was, T.StructType)):
        return F.lit(True)
    each = [_differs(new.getField(f.name), f.dataType, old.getField(f.name), was[f.name].dataType) if f.name in was.names else new.getField(f.name).isNotNull() for f in kind]
    return reduce(lambda a, b: a | b, each, new.isNull() != old.isNull())


@dataclass
class Database:
    """Named collections: Parquet tables to read, and snapshot folders to write."""

    spark: SparkSession
    tables: dict[str, finding.Source] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)
    manifests: dict[str, Manifest] = field(default_factory=dict)
    indexes: dict[str, list[dict]] = field(default_factory=dict)
    results: dict[str, tuple[str, dict]] = field(default_factory=dict)
    keyed: tuple[str, str] | None = None
    inputs: Inputs = field(default_factory=Inputs)
    cache: Cache = field(default_factory=Cache)

    def __post_init__(self) -> None:
        self.cache.clock = lambda: self.inputs.now("cache expiry")

    def register(self, name: str, df: DataFrame, id: tuple[str, ...] | str = "_id", ttl: str | None = None, now: dt.datetime | None = None) -> None:
        self.tables[name] = finding.Source(df, (id,) if isinstance(id, str) else id, ttl, now)

    def create(self, name: str, folder: str, df: DataFrame, id: str = "_id", ttl: str | None = None, now: dt.datetime | None = None) -> None:
        """A collection that can be written, with df as its first snapshot."""
        self.folders[name] = folder
        self.tables[name] = finding.Source(df, (id,), ttl, now)
        self._commit(name, df)

    def open(self, name: str, folder: str, version: int | None = None, now: dt.datetime | None = None) -> int:
        """A published collection, at its newest version or at an older one; returns the version."""
        self.folders[name] = folder
        at = self.version(name) if version is None else version
        manifest = self._read_manifest(name, at) or fail("VAL_RESOURCE_NOT_FOUND", f"version {at} of {folder}")
        self.tables[name] = finding.Source(self._rows(manifest), (manifest.id,), manifest.ttl, now)
        self.manifests[name], self.indexes[name] = manifest, list(manifest.indexes)
        return at

    def source(self, name: object) -> finding.Source:
        return self.tables[name] if name in self.tables else fail("VAL_RESOURCE_NOT_FOUND", str(name))

    # -- snapshots -------------------------------------------------------------

    def _text(self, folder: str, name: str) -> str | None:
        return folders.read_text(self.spark, f"{folder}/{name}")

    def _write_text(self, folder: str, name: str, text: str) -> bool:
        return folders.create_text(self.spark, f"{folder}/{name}", text)

    def version(self, name: str) -> int:
        """The snapshot that readers see: the highest published one."""
        return max(map(int, folders.names(self.spark, f"{self.folders[name]}/published")), default=0)

    def _read_manifest(self, name: str, version: int) -> Manifest | None:
        text = self._text(self.folders[name], f"published/{version:08d}")
        return Manifest.decode(text) if text else None

    def _rows(self, m: Manifest) -> DataFrame:
        """The rows of a manifest: its parts, less what later tombstones hide."""
        read = lambda paths: self.spark.read.schema(m.schema).parquet(*paths)
        if not m.gone:
            return read([p for p, _ in m.parts])
        fixed = [p for p, at in m.parts if all(at >= g for _, g in m.gone)]
        hidden = [(p, at) for p, at in m.parts if p not in fixed]
        if not hidden:
            return read(fixed)
        key = T.StructType([m.schema[m.id]])
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema(key).parquet(p).withColumn(SEQ, F.lit(at)) for p, at in m.gone])
        rows = reduce(DataFrame.unionByName, [read([p]).withColumn(SEQ, F.lit(at)) for p, at in hidden])
        left = rows.alias("r").join(gone.alias("g"), F.col(f"r.`{m.id}`").eqNullSafe(F.col(f"g.`{m.id}`")) & (F.col(f"r.{SEQ}") < F.col(f"g.{SEQ}")), "left_anti").drop(SEQ)
        return left.unionByName(read(fixed)) if fixed else left

    def _write(self, name: str, kind: str, df: DataFrame, options: dict[str, str] | None = None) -> str:
        data = f"{self.folders[name]}/{kind}-{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(data)
        return data

    def _publish(self, name: str, manifest: Manifest) -> None:
        """Make a manifest the next version by creating its file, which only one writer can."""
        self._settle(name)
        if not self._write_text(self.folders[name], f"published/{manifest.version:08d}", manifest.encode()):
            fail("CON_WRITE_CONFLICT", f"version {manifest.version} of {name} exists")
        self.manifests[name] = manifest
        old = self.tables[name]
        self.tables[name] = finding.Source(self._rows(manifest), old.id, old.ttl, old.now)

    def _commit(self, name: str, df: DataFrame, base: int | None = None, options: dict[str, str] | None = None, result: dict | None = None) -> None:
        """A version of one part: the rows of df."""
        source = self.tables[name]
        at = (self._at(name) if base is None else base) + 1
        marks = self.manifests[name].marks if name in self.manifests else []
        part = (self._write(name, "part", df, options), at)
        self._publish(name, Manifest(at, source.id[0], source.ttl, df.schema, [part], [], marks, self.indexes.get(name, []), self._own(result), at))

    def _at(self, name: str) -> int:
        return self.manifests[name].version if name in self.manifests else 0

    def _own(self, result: dict | None) -> tuple[str, str, dict] | None:
        return (*self.keyed, result) if self.keyed and result is not None else None

    def _append(self, name: str, part: str | None, gone: str | None, schema: T.StructType | None = None, marks: list[str] | None = None, result: dict | None = None) -> None:
        """A version with one more part, one more tombstone, or both. Too many are merged into one part."""
        m = self.manifests[name]
        at = m.version + 1
        nxt = Manifest(
            at, m.id, self.tables[name].ttl, _merged(m.schema, schema) if schema else m.schema, m.parts + ([(part, at)] if part else []), m.gone + ([(gone, at)] if gone else []),
            m.marks if marks is None else marks, self.indexes.get(name, []), self._own(result), m.base,
        )
        if len(nxt.parts) + len(nxt.gone) > MOST_DELTAS:
            nxt.parts, nxt.gone = [(self._write(name, "part", self._arranged(name, self._rows(nxt))), at)], []
            nxt.base = at
        self._publish(name, nxt)

    # -- keyed results ---------------------------------------------------------

    def _result_file(self, key: str) -> str:
        return f"results/{hashlib.sha256(key.encode()).hexdigest()}"

    def _settle(self, name: str) -> None:
        """Give the newest manifest's keyed result a file of its own before a newer manifest hides it."""
        newest = self.manifests.get(name)
        if newest and newest.result:
            self._write_text(self.folders[name], self._result_file(newest.result[0]), json.dumps(newest.result[1:], default=str))

    def _stored_result(self, name: str, key: str) -> tuple[str, dict] | None:
        """What a command with this key gave, in this session or another."""
        if key in self.results:
            return self.results[key]
        text = self._text(self.folders[name], self._result_file(key))
        if text:
            return tuple(json.loads(text))
        newest = self.manifests[name].result
        return newest[1:] if newest and newest[0] == key else None

    # -- commands --------------------------------------------------------------

    def run(self, command: dict, idempotency_key: str | None = None) -> DataFrame | dict:
        """Reads return a DataFrame, writes their counts. A key with the same command returns the stored result."""
        limits.check_tree(command)
        if not isinstance(command, dict) or not command:
            fail("VAL_INVALID_SHAPE", "a command is an object")
        name = next(iter(command))
        if name == "createIndex":
            return self._create_index(command)
        if name in CACHE:
            return self.cache.run(command)
        command = finding.without_collation(command)
        if name not in WRITES + READS:
            fail("VAL_UNKNOWN_COMMAND", name)
        if name == "explain":
            from ..plans.explain import explain

            return explain(self, command["explain"])
        source = self.source(command[name])
        if source.ttl is not None and source.now is None:  # the cutoff is taken once for a command
            source = finding.Source(source.df, source.id, source.ttl, self.inputs.now("expiry cutoff"))
        if name in READS:
            return {"find": finding.find, "count": finding.count, "aggregate": pipeline.aggregate}[name](source, command)
        if command[name] not in self.folders:
            fail("CAP_UNSUPPORTED_FEATURE", "the collection is read only")
        digest = hashlib.sha256(json.dumps(command, sort_keys=True, default=str).encode()).hexdigest()
        if idempotency_key is not None and (held := self._stored_result(command[name], idempotency_key)):
            return held[1] if held[0] == digest else fail("CON_IDEMPOTENCY_MISMATCH")
        self.keyed = (idempotency_key, digest) if idempotency_key is not None else None
        try:
            result = getattr(self, f"_{name}")(command[name], source, command)
        finally:
            self.keyed = None
        if idempotency_key is not None:
            self.results[idempotency_key] = (digest, result)
            self._write_text(self.folders[command[name]], self._result_file(idempotency_key), json.dumps((digest, result), default=str))
        return result

    def _only(self, command: dict, *allowed: str) -> None:
        for key in list(command)[1:]:
            if key not in allowed:
                fail("VAL_UNKNOWN_OPTION", key)

    def _insertOne(self, name: str, source: finding.Source, command: dict) -> dict:
        self._only(command, "document")
        return self._insert(name, source, [command.get("document")], lambda ids: {"acknowledged": True, "insertedCount": 1, "insertedId": ids[0]})

    def _insertMany(self, name: str, source: finding.Source, command: dict) -> dict:
        self._only(command, "documents")
        docs = command.get("documents")
        if not isinstance(docs, list) or not docs:
            fail("VAL_INVALID_SHAPE", "documents")
        limits.check("batch.items", len(docs))
        return self._insert(name, source, docs, lambda ids: {"acknowledged": True, "insertedCount": len(ids), "insertedIds": dict(enumerate(ids))})

    def _insert(self, name: str, source: finding.Source, docs: list, result) -> dict:
        """All or nothing; ids that exist or repeat are an error. Only the new rows are written."""
        (key,) = source.id
        rows = []
        for d in docs:
            if not isinstance(d, dict):
                fail("VAL_INVALID_SHAPE", "a document is an object")
            rows.append({key: self.inputs.uuid7()} | d if key not in d else d)
            unknown = set(d) - set(source.shown().columns)
            if unknown:
                fail("VAL_SCHEMA_MISMATCH", f"the typed collection has no {sorted(unknown)[0]}")
            if rows[-1][key] is None:
                fail("TYPE_MISMATCH", "an id is never null")
        ids = [r[key] for r in rows]
        if len(set(ids)) < len(ids):
            fail("UNQ_PRIMARY_DUPLICATE")
        self._insert_rows(name, source, self._documents(source, rows), ids, result(ids))
        return result(ids)

    def _insert_rows(self, name: str, source: finding.Source, new: DataFrame, ids: list, result: dict) -> None:
        if not source.df.where(F.col(f"`{source.id[0]}`").isin(ids)).isEmpty():
            fail("UNQ_PRIMARY_DUPLICATE")
        self._unique(name, source.df.unionByName(new, allowMissingColumns=True))
        self._append(name, self._write(name, "part", new.coalesce(1)), None, new.schema, result=result)

    def _documents(self, source: finding.Source, rows: list[dict]) -> DataFrame:
        """Documents as rows; fields that some lack, at any depth of objects, are marked so."""
        schema = T.StructType([f for f in source.df.schema if f.name != SEEN_FIELDS])
        signs: dict[str, str] = {}

        def marks(given: dict, kind: T.StructType, path: str) -> list[str]:
            out = []
            for f in kind:
                at, sign = path + f.name, f.metadata.get(paths.PRESENCE)
                if f.name in given:
                    out += ["+" + at] if sign == "+" else []
                    if isinstance(f.dataType, T.StructType) and isinstance(given[f.name], dict):
                        out += marks(given[f.name], f.dataType, at + ".")
                elif sign != "+":
                    signs[at] = "-"
                    out.append("-" + at)
            return out

        listed = [marks(r, schema, "") for r in rows]
        held = [tuple(r.get(c) for c in schema.names) for r in rows]
        if SEEN_FIELDS not in source.df.columns and not any(listed):
            return self.spark.createDataFrame(held, schema)
        schema = _with_signs(schema, signs).add(SEEN_FIELDS, T.ArrayType(T.StringType()))
        return self.spark.createDataFrame([(*h, m) for h, m in zip(held, listed, strict=True)], schema)

    def _unique(self, name: str, df: DataFrame) -> None:
        for index in self.indexes.get(name, []):
            if index.get("unique"):
                keys = [F.col(f"`{k}`") for k in index["keys"]]
                if not df.groupBy(*keys).count().where("count > 1").isEmpty():
                    fail("UNQ_SECONDARY_DUPLICATE", ",".join(index["keys"]))

    def _targets(self, source: finding.Source, command: dict, one: bool) -> tuple[Column, object]:
        """The condition that marks the visible target rows of the pinned snapshot, and the id (one target only)."""
        condition = F.coalesce(compile_filter(command.get("filter", {}), source.context(), False), F.lit(False))
        if not one:
            return condition & ~source.expired(), None
        order = command.get("sort")
        found = finding.find(source, {"find": "", "filter": command.get("filter", {}), "limit": 1} | ({"sort": order} if order else {})).select(*source.id).collect()
        if not found:
            return F.lit(False), None
        (key,) = source.id
        return F.col(f"`{key}`").eqNullSafe(F.lit(found[0][0])), found[0][0]

    def _update(self, name: str, source: finding.Source, command: dict, one: bool) -> dict:
        """Targets are fixed by their pre-images, so an update may change what its own filter asks for."""
        self._only(command, "filter", "update", "upsert", *(["sort"] if one else []))
        updates.validate(command.get("update"), source.id)
        target, _ = self._targets(source, command, one)
        matched = source.df.where(target).count()
        if not matched and command.get("upsert"):
            return self._upsert(name, source, command)
        outcome = lambda n: {"acknowledged": True, "matchedCount": matched, "modifiedCount": n, "upsertedCount": 0}
        if not matched:
            return outcome(0)
        columns = source.shown().columns
        before = F.struct(*(F.col(f"`{c}`") for c in source.df.columns)).alias("__before")
        after = updates.post_image(source.df.where(target).select("*", before), command["update"], F.lit(True), source.id)
        fields = [c for c in after.columns if c not in ("__before", SEEN_FIELDS)]
        kinds = source.df.schema
        listed = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<string>")))
        was = F.col("__before").getField(SEEN_FIELDS) if SEEN_FIELDS in source.df.columns else F.lit(None).cast("array<string>")
        tests = [~listed(F.col(SEEN_FIELDS)).eqNullSafe(listed(was))] if SEEN_FIELDS in after.columns else []
        tests += [_differs(F.col(f"`{c}`"), after.schema[c].dataType, F.col("__before").getField(c), kinds[c].dataType) if c in columns else F.col(f"`{c}`").isNotNull() for c in fields]
        changed = after.where(reduce(lambda a, b: a | b, tests)).drop("__before")
        part = self._write(name, "part", changed)
        changed = self.spark.read.schema(changed.schema).parquet(part)
        modified = changed.count()
        if not modified:
            return outcome(0)
        (key,) = source.id
        if any(i.get("unique") for i in self.indexes.get(name, [])):
            self._unique(name, source.df.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True))
        schema = changed.schema
        if all(c in schema.names and _holds(schema[c].dataType, source.df.schema[c].dataType) for c in columns):
            self._append(name, part, self._write(name, "gone", changed.select(key)), schema, result=outcome(modified))
        else:  # a column's type changes: files of the old type can't be read as the new one
            self._commit(name, updates.post_image(source.df, command["update"], target, source.id), result=outcome(modified))
        return outcome(modified)

    def _updateOne(self, name: str, source: finding.Source, command: dict) -> dict:
        return self._update(name, source, command, True)

    def _updateMany(self, name: str, source: finding.Source, command: dict) -> dict:
        return self._update(name, source, command, False)

    def _upsert(self, name: str, source: finding.Source, command: dict) -> dict:
        """A document from the filter's equalities, then the update with its insert branch."""
        seed = {p: (x["$eq"] if isinstance(x, dict) and set(x) == {"$eq"} else x) for p, x in command.get("filter", {}).items() if not p.startswith("$") and "." not in p and (not isinstance(x, dict) or set(x) == {"$eq"})}
        (key,) = source.id
        seed.setdefault(key, self.inputs.uuid7())
        after = updates.post_image(self._documents(source, [seed]), command["update"], F.lit(True), source.id, inserting=True)
        kinds = {f.name: f.dataType for f in source.df.schema}
        after = after.select(*(F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name, metadata=f.metadata) if f.name in kinds and not _holds(f.dataType, kinds[f.name]) else F.col(f"`{f.name}`") for f in after.schema))
        result = {"acknowledged": True, "matchedCount": 0, "modifiedCount": 0, "upsertedCount": 1, "upsertedId": seed[key]}
        self._insert_rows(name, source, after, [seed[key]], result)
        return result

    def _replaceOne(self, name: str, source: finding.Source, command: dict) -> dict:
        self._only(command, "filter", "replacement", "sort", "upsert")
        new = command.get("replacement")
        if not isinstance(new, dict) or any(k.startswith("$") for k in new):
            fail("VAL_INVALID_SHAPE", "a replacement is a document")
        (key,) = source.id
        target, found = self._targets(source, command, True)
        outcome = lambda n, m, **more: {"acknowledged": True, "matchedCount": n, "modifiedCount": m, "upsertedCount": 0} | more
        if found is None:
            if command.get("upsert"):
                return self._insert(name, source, [new], lambda ids: outcome(0, 0, upsertedCount=1, upsertedId=ids[0]))
            return outcome(0, 0)
        if new.get(key, found) != found:
            fail("VAL_PROTECTED_FIELD", key)
        unknown = set(new) - set(source.shown().columns)
        if unknown:
            fail("VAL_SCHEMA_MISMATCH", f"the typed collection has no {sorted(unknown)[0]}")
        row = self._documents(source, [{key: found} | new])
        held = source.df if SEEN_FIELDS in source.df.columns or SEEN_FIELDS not in row.columns else source.df.withColumn(SEEN_FIELDS, F.lit(None).cast("array<string>"))
        listed = lambda df: df.withColumn(SEEN_FIELDS, F.array_sort(F.coalesce(SEEN_FIELDS, F.array().cast("array<string>")))) if SEEN_FIELDS in df.columns else df
        if listed(held.where(target)).exceptAll(listed(row)).isEmpty():
            return outcome(1, 0)
        self._unique(name, source.df.where(~target).unionByName(row, allowMissingColumns=True))
        self._append(name, self._write(name, "part", row.coalesce(1)), self._write(name, "gone", row.select(key).coalesce(1)), row.schema, result=outcome(1, 1))
        return outcome(1, 1)

    def _delete(self, name: str, source: finding.Source, command: dict, one: bool) -> dict:
        self._only(command, "filter", *(["sort"] if one else []))
        target, _ = self._targets(source, command, one)
        (key,) = source.id
        gone = self._write(name, "gone", source.df.where(target).select(key))
        n = self.spark.read.schema(T.StructType([source.df.schema[key]])).parquet(gone).count()
        if n:
            self._append(name, None, gone, result={"acknowledged": True, "deletedCount": n})
        return {"acknowledged": True, "deletedCount": n}

    def _deleteOne(self, name: str, source: finding.Source, command: dict) -> dict:
        return self._delete(name, source, command, True)

    def _deleteMany(self, name: str, source: finding.Source, command: dict) -> dict:
        return self._delete(name, source, command, False)

    def _create_index(self, command: dict) -> dict:
        """Index metadata: scalar, compound and unique keys, expiry, columnar paths, vectors."""
        name = command["createIndex"]
        source = self.source(name)
        self._only(command, "keys", "unique", "ttl", "type", "paths", "path", "metric", "dimensions")
        entry = {k: v for k, v in command.items() if k != "createIndex"}
        self.indexes.setdefault(name, []).append(entry)
        if entry.get("unique"):
            try:
                self._unique(name, source.df)
            except Exception:
                self.indexes[name].pop()
                raise
        if entry.get("ttl"):
            path = entry["ttl"] if isinstance(entry["ttl"], str) else next(iter(entry["keys"]))
            self.tables[name] = finding.Source(source.df, source.id, path, source.now)
        if name in self.folders:
            self._append(name, None, None)
        return {"acknowledged": True, "index": entry}

    def _keys(self, name: str) -> list[str]:
        """The first scalar index's keys that are columns."""
        columns = self.tables[name].df.columns
        return next((keys for i in self.indexes.get(name, []) if "type" not in i and (keys := [k for k in i.get("keys", {}) if k in columns])), [])

    def _arranged(self, name: str, df: DataFrame) -> DataFrame:
        """df in the order of the first index, so that row groups' bounds prune scans; as it is without one."""
        keys = [F.col(f"`{k}`") for k in self._keys(name)]
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df

    def cluster(self, name: str, *keys: str, bloom: bool = True) -> None:
        """A new snapshot in the order of keys, so that row groups' bounds, and Bloom filters for equality, prune scans of them."""
        source = self.source(name)
        df = source.df.repartitionByRange(*(F.col(f"`{k}`") for k in keys)).sortWithinPartitions(*(F.col(f"`{k}`") for k in keys))
        self._commit(name, df, options={f"parquet.bloom.filter.enabled#{k}": "true" for k in keys} if bloom else {})

    def backup(self, name: str, folder: str, since: int | None = None) -> int:
        """A copy of the pinned version in a folder, or of what came after version `since`; returns the version.

        A whole copy is a collection by itself; restore() puts one and the
        increments after it together. An older version of a collection that
        still has its parts is opened by its number.
        """
        m = self.manifests[name]
        key = T.StructType([m.schema[m.id]])
        if since is None:
            copied = Manifest(m.version, m.id, m.ttl, m.schema, [(self._copy(self._rows(m), folder, "part"), m.version)], indexes=m.indexes, base=m.version)
        else:
            newer = lambda held, schema, kind: [(self._copy(self.spark.read.schema(schema).parquet(p), folder, kind), at) for p, at in held if at > since]
            copied = Manifest(m.version, m.id, m.ttl, m.schema, newer(m.parts, m.schema, "part"), newer(m.gone, key, "gone"), indexes=m.indexes, base=m.base)
        if not folders.create_text(self.spark, f"{folder}/published/{m.version:08d}", copied.encode()):
            fail("DUR_BACKUP_INVALID", f"{folder} has version {m.version}")
        return m.version

    def _copy(self, df: DataFrame, folder: str, kind: str) -> str:
        data = f"{folder}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(data)
        return data

    def restore(self, name: str, folder: str, whole: str, *increments: str) -> int:
        """A collection in a new folder from a whole backup and the increments after it, in order; returns the last one's version."""
        found: list[Manifest] = []
        for source in (whole, *increments):
            version = max(map(int, folders.names(self.spark, f"{source}/published")), default=0)
            text = folders.read_text(self.spark, f"{source}/published/{version:08d}")
            m = Manifest.decode(text) if text else fail("DUR_RESTORE_INVALID", f"{source} is no backup")
            if found and (m.id != found[0].id or m.version < found[-1].version) or not found and m.base != m.version:
                fail("DUR_RESTORE_INVALID", f"{source} doesn't follow")
            found.append(m)
        last = found[-1]
        # A part that was merged later than a backup holds what that one has.
        kept = lambda held: [x for m in found for x in held(m) if x[1] >= last.base]
        rows = self._rows(Manifest(last.version, last.id, last.ttl, last.schema, kept(lambda m: m.parts), kept(lambda m: m.gone)))
        self.folders[name], self.indexes[name] = folder, list(last.indexes)
        self.tables[name] = finding.Source(rows, (last.id,), last.ttl)
        self.manifests.pop(name, None)
        self._commit(name, rows)
        return last.version

    def export(self, name: str, folder: str) -> None:
        """The pinned snapshot as typed JSON text, a document a line."""
        from ..functions.tagged import export_documents

        source = self.source(name)
        export_documents(source.visible(), source.id[0]).write.text(folder)

    def cursor(self, command: dict, batch: int = 1000) -> Iterator[list[Row]]:
        """find's rows in batches of a pinned snapshot; they add up to the one-shot result."""
        limits.check("batch.items", batch)
        held: list[Row] = []
        for row in finding.find(self.source(command.get("find")), command).toLocalIterator():
            held.append(row)
            if len(held) == batch:
                yield held
                held = []
        if held:
            yield held

    def page(self, command: dict, batch: int = 1000, token: dict | None = None) -> tuple[list[Row], dict | None]:
        """One batch of find's rows and a token for the next, or None at the end. A token names the snapshot and the
        position in its total order, so another session that opens the collection goes on where this one stopped."""
        limits.check("batch.items", batch)
        name = command.get("find")
        digest = hashlib.sha256(json.dumps(command, sort_keys=True, default=str).encode()).hexdigest()
        source = self.source(name)
        token = token or {"command": digest, "version": self._at(name) if name in self.folders else 0, "position": 0}
        if token["command"] != digest:
            fail("VAL_INVALID_SHAPE", "the token belongs to another command")
        if name in self.folders and token["version"] != self._at(name):
            manifest = self._read_manifest(name, token["version"]) or fail("VAL_RESOURCE_NOT_FOUND", f"version {token['version']}")
            source = finding.Source(self._rows(manifest), source.id, source.ttl, source.now)
        left = finding.position(command["limit"], "limit") - token["position"] if "limit" in command else batch + 1
        rows = finding.find(source, command | {"skip": command.get("skip", 0) + token["position"], "limit": max(0, min(batch + 1, left))}).collect()
        more = len(rows) > batch
        return rows[:batch], token | {"position": token["position"] + batch} if more else None
