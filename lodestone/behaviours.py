"""Registered queries of what commands refuse, keep and repeat, each with the SQL that gives the same rows."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsonio
from .errors import EngineError
from .functions import convert, operations, tagged
from .functions import values as V
from .operators import find as finding
from .operators import pipeline, updates
from .operators.filters import Context, compile_filter
from .queries import IDS, _mixed, _opened, _stages, mixed, query
from .sources.collections import Database
from .sources.folders import scratch
from .streaming import changes

#: What is wrong, the call and the code that it has to give.
_MATCH = lambda f: lambda src: compile_filter(f, Context(src.df.schema))
_PIPE = lambda *s: lambda src: pipeline.aggregate(src, {"aggregate": "m", "pipeline": list(s)})
_FIND = lambda **c: lambda src: finding.find(src, {"find": "m"} | c)
_UPDATE = lambda u: lambda src: updates.post_image(src.df, u, F.lit(True))
REFUSALS = {
    "a branch that another decides is validated": (_MATCH({"$or": [{"n": {"$gt": 0}}, {"n": {"$bad": 1}}]}), "VAL_UNKNOWN_OPERATOR"),
    "an unknown logical operator": (_MATCH({"$xor": []}), "VAL_UNKNOWN_OPERATOR"),
    "missing is no type name": (_MATCH({"n": {"$type": "missing"}}), "VAL_INVALID_SHAPE"),
    "exists takes a Boolean": (_MATCH({"n": {"$exists": 1}}), "VAL_INVALID_SHAPE"),
    "operators and fields together": (_MATCH({"o": {"$gt": 1, "a": 2}}), "VAL_INVALID_SHAPE"),
    "a backreference": (_MATCH({"s": {"$regex": "(a)\\1"}}), "CAP_UNSUPPORTED_FEATURE"),
    "an empty path segment": (_MATCH({"o..a": 1}), "VAL_INVALID_PATH"),
    "an index beyond arrays": (_MATCH({"tags.99999999999": 1}), "VAL_INVALID_PATH"),
    "more literals than a list may have": (_MATCH({"n": {"$in": list(range(10_001))}}), "QUOTA_LIMIT_EXCEEDED"),
    "a schema keyword that isn't known": (_MATCH({"$jsonSchema": {"format": "date"}}), "VAL_UNKNOWN_OPERATOR"),
    "top-k below a logical operator": (_MATCH({"$or": [{"x": {"$vectorTopK": {}}}]}), "VAL_UNSUPPORTED_COMBINATION"),
    "an int32 out of range": (_MATCH({"n": {"$value": {"type": "int32", "value": "3000000000"}}}), "VAL_INVALID_LITERAL"),
    "expiry without a path": (_MATCH({"$ttl": "active"}), "VAL_UNSUPPORTED_COMBINATION"),
    "a sort by several values": (_FIND(sort={"items.q": 1}), "VAL_UNSUPPORTED_COMBINATION"),
    "a sort by 2": (_FIND(sort={"n": 2}), "VAL_INVALID_SHAPE"),
    "an unknown option": (_FIND(hint=1), "VAL_UNKNOWN_OPTION"),
    "a path and its ancestor": (_FIND(projection={"o": 1, "o.a": 1}), "VAL_CONFLICTING_PATHS"),
    "inclusion and exclusion": (_FIND(projection={"n": 1, "s": 0}), "VAL_UNSUPPORTED_COMBINATION"),
    "a negative limit": (_FIND(limit=-1), "VAL_INVALID_SHAPE"),
    "a put-off stage": (_PIPE({"$lookup": {}}), "CAP_UNSUPPORTED_FEATURE"),
    "an unknown stage": (_PIPE({"$bad": {}}), "VAL_UNKNOWN_OPERATOR"),
    "two keys in a stage": (_PIPE({"$skip": 1, "$limit": 1}), "VAL_INVALID_SHAPE"),
    "an accumulator that isn't there": (_PIPE({"$group": {"_id": 1, "x": {"$push": "$n"}}}), "VAL_UNKNOWN_OPERATOR"),
    "a sum of texts": (_PIPE({"$group": {"_id": 1, "x": {"$sum": "$s"}}}), "TYPE_MISMATCH"),
    "an average of texts": (_PIPE({"$group": {"_id": 1, "x": {"$avg": "$s"}}}), "TYPE_MISMATCH"),
    "an unwound text": (_PIPE({"$unwind": "$s"}), "TYPE_MISMATCH"),
    "an index name that is taken": (_PIPE({"$unwind": {"path": "$tags", "includeArrayIndex": "n"}}), "VAL_CONFLICTING_PATHS"),
    "a protected count": (_PIPE({"$count": "_id"}), "VAL_PROTECTED_FIELD"),
    "an array with a missing child": (_PIPE({"$project": {"x": ["$n", "$gone"]}}), "TYPE_EXPRESSION_MISSING"),
    "an unknown expression": (_PIPE({"$project": {"x": {"$add": [1, 2]}}}), "VAL_UNKNOWN_OPERATOR"),
    "an id that changes": (_UPDATE({"$set": {"_id": 1}}), "VAL_PROTECTED_FIELD"),
    "equal paths": (_UPDATE({"$set": {"n": 1}, "$inc": {"n": 1}}), "VAL_CONFLICTING_PATHS"),
    "nested paths": (_UPDATE({"$set": {"o": 1, "o.a": 2}}), "VAL_CONFLICTING_PATHS"),
    "a rename": (_UPDATE({"$rename": {"n": "m"}}), "CAP_UNSUPPORTED_FEATURE"),
    "a positional path": (_UPDATE({"$set": {"tags.$": 1}}), "CAP_UNSUPPORTED_FEATURE"),
    "an unknown update": (_UPDATE({"$foo": {"n": 1}}), "VAL_UNKNOWN_OPERATOR"),
    "a text plus one": (_UPDATE({"$inc": {"s": 1}}), "TYPE_MISMATCH"),
    "a pushed text among numbers": (_UPDATE({"$push": {"tags": "x"}}), "TYPE_MISMATCH"),
    "a path through a number": (_UPDATE({"$set": {"n.a": 1}}), "TYPE_MISMATCH"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, '{code}')" for k, (_, code) in REFUSALS.items()) + ") AS t(what, code)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid commands and the codes of their errors; none reaches a row."""
    src, out = mixed(spark), []
    for what, (call, _) in REFUSALS.items():
        try:
            call(src)
            out.append((what, "accepted"))
        except EngineError as e:
            out.append((what, e.code))
    return spark.createDataFrame(out, "what string, code string")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0.5 AND c_custkey <> 9007199254740993 ORDER BY c_custkey LIMIT 40")
def raw_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command as compressed bytes, its numbers typed by their tokens."""
    raw = gzip.compress(b'{"find": "customer", "filter": {"c_acctbal": {"$gt": 0.5}, "c_custkey": {"$ne": 9007199254740993}}, "limit": 40, "projection": {"c_acctbal": 1}}')
    db = Database(spark)
    db.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    return db.run(jsonio.parse(raw, "gzip"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250 OFFSET 10")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 100, each resumed by its token, add up to the whole answer."""
    db = Database(spark)
    db.register("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    command = {"find": "orders", "sort": {"o_totalprice": -1}, "skip": 10, "limit": 250, "projection": {"o_totalprice": 1}}
    rows, token = db.page(command, 100)
    while token:
        more, token = db.page(command, 100, token)
        rows += more
    return spark.createDataFrame(rows, db.run(command).schema)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 70, 'once'")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed insert that comes twice, the second time from another session, is one."""
    folder = f"{scratch(spark)}/collection-{uuid.uuid4().hex}"
    db = Database(spark)
    db.create("region", folder, spark.read.parquet(f"{sf_dir}/region.parquet"), "r_regionkey")
    command = {"insertOne": "region", "document": {"r_regionkey": 70, "r_name": "once"}}
    db.run(command, "key")
    other = Database(spark)
    other.open("region", folder)
    other.run(command, "key")
    return other.run({"find": "region", "projection": {"r_name": 1}})


@query("SELECT n_nationkey, n_name FROM nation")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that a unique index refuses leaves nothing behind."""
    db, _ = _opened(spark, sf_dir, "nation", {"createIndex": "nation", "keys": {"n_name": 1}, "unique": True})
    taken = db.source("nation").df.orderBy("n_nationkey").first()["n_name"]
    for command in ({"insertOne": "nation", "document": {"n_nationkey": 900, "n_name": taken}}, {"updateMany": "nation", "filter": {}, "update": {"$set": {"n_name": "SAME"}}}):
        try:
            db.run(command)
        except EngineError as e:
            if e.code != "UNQ_SECONDARY_DUPLICATE":
                raise
    return db.run({"find": "nation", "projection": {"n_name": 1}})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'late loses' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 500, 'new'")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of changes that come out of order and twice: the highest seq of each id counts, deletes included."""
    db, _ = _opened(spark, sf_dir, "nation")
    columns = db.source("nation").df.columns
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    change = lambda df, op, seq, **new: df.withColumns({k: F.lit(v) for k, v in new.items()} | {"op": F.lit(op), "seq": F.lit(seq)}).select(*columns, "op", "seq")
    newest = change(nation.where("n_nationkey % 3 = 0"), "delete", 9).unionByName(change(nation.where("n_nationkey % 3 = 1"), "upsert", 9, n_name="late loses"))
    stale = change(nation, "upsert", 4, n_name="stale").where("n_nationkey % 3 <> 2").unionByName(change(nation.limit(1), "upsert", 1, n_nationkey=500, n_name="new"))
    for batch in (newest, stale, newest):
        changes.apply_batch(db, "nation", batch)
    return db.source("nation").df.select(F.col("n_nationkey").cast(nation.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 60, 'after'")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole backup and an increment, restored as a new collection."""
    db, _ = _opened(spark, sf_dir, "region")
    base = f"{scratch(spark)}/backup-{uuid.uuid4().hex}"
    at = db.backup("region", f"{base}/whole")
    db.run({"deleteOne": "region", "filter": {"r_regionkey": 1}})
    db.run({"insertOne": "region", "document": {"r_regionkey": 60, "r_name": "after"}})
    db.backup("region", f"{base}/more", at)
    db.restore("again", f"{base}/again", f"{base}/whole", f"{base}/more")
    return db.run({"find": "again", "projection": {"r_name": 1}})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 100")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's export, read again as documents."""
    db, _ = _opened(spark, sf_dir, "customer", {"deleteMany": "customer", "filter": {"c_acctbal": {"$gte": 100}}})
    folder = f"{scratch(spark)}/export-{uuid.uuid4().hex}"
    db.export("customer", folder)
    docs = tagged.import_documents(tagged.dealt(spark.read.text(folder).withColumnRenamed("value", "doc"))).where("error is null")
    keyed = tagged.with_sidecars(docs, {"_id": ("int64", "id"), "c_name": ("string", "name"), "c_acctbal": ("float64", "bal")})
    return keyed.select(F.col("id__v").alias("c_custkey"), F.col("name__v").alias("c_name"), F.col("bal__v").alias("c_acctbal"))


_mixed("agg_root_reference", lambda src: _stages({"$project": {"all": "$$ROOT"}})(src).select("_id", "all.n", F.size("all.tags").cast("long").alias("tags")), "SELECT _id, n, len(tags) AS tags FROM MIXED")
_mixed("agg_if_null_missing", lambda src: _stages({"$project": {"a": {"$ifNull": ["$o.a", -1]}, "b": {"$ifNull": ["$gone", "$s"]}}})(src), "SELECT _id, coalesce(o.a, -1) AS a, s AS b FROM MIXED")
_mixed("agg_fanout_reference", lambda src: _stages({"$project": {"q": "$items.q"}})(src).select("_id", F.array_join(F.transform("q", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("q")), "SELECT _id, nullif(array_to_string(list_transform(list_filter(items, lambda i: i IS NOT NULL), lambda i: coalesce(i.q::VARCHAR, '-')), ','), '') AS q FROM MIXED")
_mixed("agg_zero_keys", lambda src: _stages({"$match": {"x": {"$lt": 1}}}, {"$group": {"_id": "$x", "n": {"$count": {}}}})(src), "SELECT x AS _id, count(*) AS n FROM MIXED WHERE x < 1 GROUP BY x")
_mixed("agg_max_of_nulls", lambda src: _stages({"$group": {"_id": "$o.b", "hi": {"$max": "$n"}, "lo": {"$min": "$n"}}})(src), "SELECT o.b AS _id, max(n) AS hi, CASE WHEN bool_or(n IS NULL) THEN NULL ELSE min(n) END AS lo FROM MIXED GROUP BY o IS NULL, o.b")
_mixed("agg_sum_decimal_digits", lambda src: _stages({"$project": {"big": {"$literal": {"$value": {"type": "decimal128", "value": "1234567890123456789012345678901234"}}}}}, {"$group": {"_id": None, "t": {"$sum": "$big"}}}, {"$project": {"_id": 0, "t": 1}})(src).select(F.col("t").cast("string").alias("t")), "SELECT '9876543120987654312098765431209872' AS t FROM MIXED LIMIT 1")
_mixed("update_missing_parts", lambda src: updates.post_image(src.df, {"$set": {"o.b": "set"}, "$push": {"tags": {"$each": [9], "$position": 0}}}, F.col("tags").isNotNull() & F.col("o").isNotNull()).select("_id", "o.b", F.col("tags")[0].alias("first")), "SELECT _id, CASE WHEN tags IS NOT NULL AND o IS NOT NULL THEN 'set' ELSE o.b END AS b, CASE WHEN tags IS NOT NULL AND o IS NOT NULL THEN 9 ELSE tags[1] END AS first FROM MIXED")
_mixed("update_set_semantic", lambda src: updates.post_image(src.df, {"$addToSet": {"tags": {"$each": [2.0, 7]}}}, F.col("tags").isNotNull()).select("_id", F.size("tags").cast("long").alias("n")), "SELECT _id, CASE WHEN tags IS NULL THEN -1 ELSE len(tags) + CASE WHEN list_contains(tags, 2) THEN 1 ELSE 2 END END AS n FROM MIXED WHERE tags IS NOT NULL UNION ALL SELECT _id, NULL FROM MIXED WHERE tags IS NULL")
_mixed("vector_eligibility", lambda src: finding.find(finding.Source(src.df.select("_id", F.when(F.col("_id") % 4 == 0, F.lit(None)).when(F.col("_id") % 4 == 1, F.array(F.lit(1.0))).otherwise(F.array(F.col("_id").cast("double"), F.lit(0.0))).alias("v"))), {"find": "m", "filter": {"v": {"$vectorTopK": {"vector": [1.0, 0.0], "metric": "l2", "k": 3}}}, "projection": {"_id": 1}}), "SELECT _id FROM MIXED WHERE _id % 4 IN (2, 3) ORDER BY _id LIMIT 3")
_mixed("conversion_decimal", lambda src: src.df.where("d is not null").select("_id", convert.convert(F.col("d"), T.DecimalType(10, 2), "int64", "round").alias("whole"), convert.convert(F.col("n"), T.LongType(), "string").alias("text")), "SELECT _id, round_even(d, 0)::BIGINT AS whole, n::VARCHAR AS text FROM MIXED WHERE d IS NOT NULL")
_mixed("half_precision", lambda src: src.df.select("_id", convert.to_f16(F.array((F.col("_id") / 8).cast("float"), F.lit(0.1).cast("float"))).alias("h")).select("_id", F.col("h")[0].alias("exact"), F.round(F.col("h")[1].cast("double"), 10).alias("rounded")), "SELECT _id, (_id / 8.0)::FLOAT AS exact, 0.0999755859::DOUBLE AS rounded FROM MIXED")


@query("SELECT 'same' AS order_of_fields, 'other' AS type, 'other' AS place")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a typed content hash sees: types and places in arrays, not the order of an object's fields."""
    doc = V.literal({"a": 1, "b": {"c": [1, 2], "d": None}})
    say = lambda x: "same" if operations.content_hash(V.literal(x)) == operations.content_hash(doc) else "other"
    row = (say({"b": {"d": None, "c": [1, 2]}, "a": 1}), say({"a": 1.0, "b": {"c": [1, 2], "d": None}}), say({"a": 1, "b": {"c": [2, 1], "d": None}}))
    return spark.createDataFrame([row], "order_of_fields string, type string, place string")


@query("SELECT 'orders' AS \"table\", true AS pushed, true AS topk, 2::BIGINT AS columns")
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explain says of a filtered, sorted and limited find of two columns."""
    db = Database(spark)
    db.register("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"), IDS["orders"])
    out = db.run({"explain": {"find": "orders", "filter": {"o_totalprice": {"$gte": 1000}}, "sort": {"o_totalprice": -1}, "limit": 5, "projection": {"o_totalprice": 1}}})
    read = out["read_schema"][0].count(":")
    return spark.createDataFrame([("orders", "FILTER_PUSHED" in out["reasons"], "TOP_K" in out["reasons"], read)], "table string, pushed boolean, topk boolean, columns long")


@query("SELECT 'k' AS key, true AS found, 5::BIGINT AS counted")
def cache_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.run({"cacheSet": "k", "value": {"a": 1}, "ttlSeconds": 600})
    db.run({"cacheIncr": "n", "by": 2})
    total = db.run({"cacheIncr": "n", "by": 3})["value"].value
    return spark.createDataFrame([("k", db.run({"cacheGet": "k"})["found"], total)], "key string, found boolean, counted long")

