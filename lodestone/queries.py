"""Registered queries of the document engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import paths
from .functions import columns, decimals
from .operators import find as finding
from .operators import pipeline, updates, vectors
from .operators.filters import compile_filter
from .sources.collections import Database

#: The ids of the tables; a table without a unique column is ordered by all it has.
IDS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
NOW = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)
#: 64 numbers for vector queries.
PROBE = [round(((k * 37) % 64 - 31.5) / 32, 6) for k in range(64)]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str, *names: str, ttl: str | None = None) -> Database:
    """The named tables, or all, as collections."""
    db = Database(spark)
    for name in names or (*IDS, "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        db.register(name, df, IDS.get(name, tuple(df.columns)), ttl, NOW)
    return db


def command(name: str, spec: dict, sql: str, shape=None) -> None:
    """Register a read: `spec` run on the tables, `shape` a last select for names, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = database(spark, sf_dir, next(iter(spec.values()))).run(spec)
        return shape(out) if shape else out

    _QUERIES[name], _SQL[name] = run, sql


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import behaviours  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import behaviours  # noqa: F401

    return dict(_SQL)


# -- find, count, projection ----------------------------------------------------

FLAGSHIP = {
    "find": "orders",
    "filter": {"o_totalprice": {"$gte": 250000}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}},
    "sort": {"o_totalprice": -1},
    "limit": 20,
    "projection": {"o_custkey": 1, "o_totalprice": 1, "o_orderpriority": 1},
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders").run(FLAGSHIP)


command("find_flagship", FLAGSHIP, "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
command("find_default_order_limit", {"find": "orders", "skip": 5, "limit": 50}, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 5")
command("find_sort_skip_limit", {"find": "orders", "sort": {"o_orderpriority": 1, "o_totalprice": -1}, "skip": 10, "limit": 100}, "SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10")
command("find_limit_zero", {"find": "nation", "limit": 0}, "SELECT * FROM nation LIMIT 0")
command("count_filter", {"count": "lineitem", "filter": {"l_quantity": {"$gt": 25}}}, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
command("count_skip_limit", {"count": "orders", "filter": {"o_totalprice": {"$lt": 100000}}, "skip": 10, "limit": 200}, "SELECT least(greatest(count(*) - 10, 0), 200)::BIGINT AS n FROM orders WHERE o_totalprice < 100000")
command("project_inclusion", {"find": "customer", "projection": {"c_name": 1, "c_acctbal": True}}, "SELECT c_custkey, c_name, c_acctbal FROM customer")
command("project_inclusion_without_id", {"find": "customer", "projection": {"c_custkey": 0, "c_name": 1}}, "SELECT c_name FROM customer")
command("project_exclusion", {"find": "nation", "projection": {"n_name": 0}}, "SELECT * EXCLUDE (n_name) FROM nation")

# -- comparisons and logic ------------------------------------------------------

FILTERS = {
    "filter_eq": ("orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "filter_ne": ("customer", {"c_mktsegment": {"$ne": "BUILDING"}}, "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "filter_range": ("orders", {"o_totalprice": {"$gte": 1000, "$lt": 50000.5}}, "o_totalprice >= 1000 AND o_totalprice < 50000.5"),
    "filter_in": ("nation", {"n_nationkey": {"$in": [1, 3, 5, 7.0, "x"]}}, "n_nationkey IN (1, 3, 5, 7)"),
    "filter_nin": ("nation", {"n_nationkey": {"$nin": [1, 3, None]}}, "n_nationkey NOT IN (1, 3)"),
    "filter_and_or": ("part", {"$and": [{"p_size": {"$gt": 10}}, {"$or": [{"p_size": {"$lt": 20}}, {"p_retailprice": {"$gt": 1500}}]}]}, "p_size > 10 AND (p_size < 20 OR p_retailprice > 1500)"),
    "filter_nor": ("part", {"$nor": [{"p_size": {"$lt": 25}}, {"p_retailprice": {"$lt": 1200}}]}, "NOT (p_size < 25 OR p_retailprice < 1200)"),
    "filter_not_field": ("part", {"p_size": {"$not": {"$gte": 25}}}, "NOT (p_size >= 25)"),
    "filter_not_top": ("part", {"$not": {"p_size": 7}}, "p_size IS DISTINCT FROM 7"),
    "filter_prefix": ("part", {"p_name": {"$prefix": "b"}}, "starts_with(p_name, 'b')"),
    "filter_contains": ("customer", {"c_name": {"$contains": "00001"}}, "contains(c_name, '00001')"),
    "filter_regex": ("customer", {"c_name": {"$regex": "0[13579]$"}}, "regexp_matches(c_name, '0[13579]$')"),
    "filter_size": ("embeddings", {"embedding": {"$size": 64}}, "len(embedding) = 64"),
    "filter_elem_match": ("embeddings", {"embedding": {"$elemMatch": {"$gt": 0.4, "$lt": 0.6}}}, "len(list_filter(embedding, lambda x: x::DOUBLE > 0.4 AND x::DOUBLE < 0.6)) > 0"),
    "filter_json_schema": ("customer", {"$jsonSchema": {"required": ["c_name"], "properties": {"c_acctbal": {"type": "number", "minimum": 0}, "c_name": {"type": "string", "minLength": 10, "maxLength": 30}}}}, "c_acctbal >= 0 AND length(c_name) BETWEEN 10 AND 30"),
    "numeric_exact_compare": ("orders", {"o_orderkey": {"$gt": 100.5, "$lt": {"$value": {"type": "decimal128", "value": "2000.25"}}}}, "o_orderkey > 100 AND o_orderkey <= 2000"),
}
for _name, (_table, _filter, _where) in FILTERS.items():
    _kept = "*" if _table != "embeddings" else "vec_id, label"
    command(_name, {"find": _table, "filter": _filter} | ({"projection": {"label": 1}} if _table == "embeddings" else {}), f"SELECT {_kept} FROM {_table} WHERE {_where}")


def _expiring(name: str, spec: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = database(spark, sf_dir, "events").source("events")
        bound = finding.Source(src.df, src.id, "ts", NOW)
        return src.df.where(compile_filter(spec, bound.context()))

    _QUERIES[name], _SQL[name] = run, f"SELECT * FROM events WHERE {where}"


_AT = "TIMESTAMP '2024-01-15 00:00:00'"
_expiring("filter_expires_before", {"$expiresBefore": "2024-01-10T00:00:00Z"}, "ts < TIMESTAMP '2024-01-10 00:00:00'")
_expiring("filter_expires_after", {"$expiresAfter": "2024-01-10T02:00:00+02:00"}, "ts > TIMESTAMP '2024-01-10 00:00:00'")
_expiring("filter_ttl_active", {"$ttl": "active"}, f"ts > {_AT}")
_expiring("filter_ttl_expired", {"$ttl": "expired"}, f"ts <= {_AT}")


@query(f"SELECT event_id, ts FROM events WHERE ts > {_AT}")
def ttl_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "events", ttl="ts").run({"find": "events", "projection": {"ts": 1}})


@query("WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, len(roles)::BIGINT AS n FROM g WHERE list_contains(roles, 'user') AND list_contains(roles, 'assistant')")
def filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    arrays = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    arrays = arrays.withColumn("roles", F.transform("turns", lambda t: t["role"]))
    out = finding.find(finding.Source(arrays, ("conv_id",)), {"find": "c", "filter": {"roles": {"$all": ["user", "assistant"]}}})
    return out.select("conv_id", F.size("roles").cast("long").alias("n"))


@query("WITH g AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id FROM g WHERE len(list_filter(turns, lambda t: t.role = 'assistant' AND t.turn >= 3)) > 0 AND len(list_filter(turns, lambda t: t.role = 'user')) > 0")
def filter_elem_match_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    arrays = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    spec = {"turns": {"$elemMatch": {"role": "assistant", "turn": {"$gte": 3}}}, "turns.role": "user"}
    return finding.find(finding.Source(arrays, ("conv_id",)), {"find": "c", "filter": spec, "projection": {"conv_id": 1}})


# -- nulls, missing paths and mixed values: rows that the query and its SQL both hold ---

_COLUMNS = "_id long, n long, x double, d decimal(10,2), s string, tags array<long>, o struct<a:long,b:string>, items array<struct<k:string,q:long>>, deep array<struct<h:array<struct<v:long>>>>, t timestamp_ntz"
_SQL_TYPES = ("BIGINT", "BIGINT", "DOUBLE", "DECIMAL(10,2)", "VARCHAR", "BIGINT[]", "STRUCT(a BIGINT, b VARCHAR)", "STRUCT(k VARCHAR, q BIGINT)[]", "STRUCT(h STRUCT(v BIGINT)[])[]", "TIMESTAMP")
_T = [dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 20, 5, 6, 7)]
MIXED = [
    (1, 1, 0.5, Decimal("1.50"), "abc", [1, 2], (1, "p"), [("u", 1), ("v", 3)], [([(1,), (5,)],)], _T[0]),
    (2, 2, 1.0, Decimal("2.00"), "abd", [], (None, "q"), [], [], _T[1]),
    (3, 3, 2.0, None, "", [2, None, 2], None, None, None, _T[2]),
    (4, None, None, Decimal("-7.24"), None, None, (2, None), [("u", None), None], [None, ([],)], None),
    (5, 2**53 + 1, float(2**53), Decimal("1.51"), "É", [1], (1, "q"), [None, ("w", 9)], [(None,), ([(None,), (7,)],)], _T[2]),
    (6, -4, float("inf"), None, "b", [None], (None, None), [("v", 2), ("u", 5)], [([(5,)],), ([(1,)],)], None),
    (7, 0, float("nan"), Decimal("0.00"), "x'y", [5, 4, 3, 2, 1], (0, ""), [(None, 1)], [([(6,), (8,)],)], _T[0]),
    (8, 2, -0.0, Decimal("2.00"), "abc", [2, 1], None, [("u", 2)], None, _T[1]),
]


def _spelt(x: object) -> str:
    """A Python value as a DuckDB literal; tuples are rows of structs by place."""
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, float):
        return f"'{x}'::DOUBLE"
    if isinstance(x, dt.datetime):
        return f"TIMESTAMP '{x}'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_spelt, x)) + "]"
    return f"row({', '.join(map(_spelt, x))})" if isinstance(x, tuple) else str(x)


_MIXED_SQL = "(SELECT {} FROM (VALUES {}) AS m({}))".format(
    ", ".join(f"{c.split()[0]}::{t} AS {c.split()[0]}" for c, t in zip(_COLUMNS.replace("struct<a:long,b:string>", "S").replace("struct<k:string,q:long>", "S").replace("struct<h:array<struct<v:long>>>", "S").split(", "), (x.replace(", ", ",") for x in _SQL_TYPES), strict=True)),
    ", ".join("(" + ", ".join(map(_spelt, r)) + ")" for r in MIXED),
    ", ".join(c.split()[0] for c in _COLUMNS.replace("struct<a:long,b:string>", "S").replace("struct<k:string,q:long>", "S").replace("struct<h:array<struct<v:long>>>", "S").split(", ")),
)


def mixed(spark: SparkSession, ttl: str | None = None) -> finding.Source:
    return finding.Source(spark.createDataFrame(MIXED, _COLUMNS), ("_id",), ttl, NOW)


_ANY = "coalesce(len(list_filter({}, lambda i: coalesce({}, false))) > 0, false)"
MIXED_FILTERS = {
    "filter_exists_true": ({"o.a": {"$exists": True}}, "o IS NOT NULL"),
    "filter_exists_false": ({"o.a": {"$exists": False}}, "o IS NULL"),
    "filter_exists_index": ({"tags.1": {"$exists": True}}, "len(tags) > 1"),
    "filter_exists_fanout": ({"items.k": {"$exists": False}}, "NOT " + _ANY.format("items", "i IS NOT NULL")),
    "filter_type": ({"n": {"$type": ["null", "string"]}}, "n IS NULL"),
    "filter_type_fanout": ({"items.k": {"$type": "string"}}, _ANY.format("items", "i.k IS NOT NULL")),
    "filter_type_not": ({"o.a": {"$not": {"$type": "integer"}}}, "o IS NULL OR o.a IS NULL"),
    "filter_cross_type": ({"$or": [{"s": {"$gt": 5}}, {"n": {"$lt": "a"}}, {"x": {"$gte": True}}, {"n": 2.0}]}, "n = 2"),
    "filter_in_empty": ({"$or": [{"n": {"$in": []}}, {"s": {"$nin": []}, "n": 1}]}, "n = 1"),
    "filter_in_null": ({"n": {"$in": [1, None, "x", 2.5]}}, "n = 1 OR n IS NULL"),
    "filter_nin_missing": ({"o.a": {"$nin": [1, None]}}, "o IS NULL OR (o.a IS NOT NULL AND o.a <> 1)"),
    "filter_empty_logic": ({"$or": [{"$and": [], "n": 1}, {"$or": []}, {"$nor": [], "x": 2}]}, "n = 1 OR x = 2"),
    "filter_null_eq": ({"s": None}, "s IS NULL"),
    "filter_null_ne": ({"o.a": {"$ne": None}}, "o IS NULL OR o.a IS NOT NULL"),
    "filter_null_range": ({"$or": [{"n": {"$gte": None}}, {"n": {"$lte": None}}, {"n": {"$gt": None}}, {"n": {"$lt": None}}, {"n": 3}]}, "n = 3"),
    "filter_null_not_range": ({"n": {"$not": {"$gt": 1}}}, "NOT coalesce(n > 1, false)"),
    "filter_nor_null": ({"$nor": [{"n": {"$gt": 1}}, {"s": {"$prefix": "a"}}]}, "NOT (coalesce(n > 1, false) OR coalesce(starts_with(s, 'a'), false))"),
    "filter_fanout_range": ({"items.q": {"$gt": 2}}, _ANY.format("items", "i.q > 2")),
    "filter_fanout_ne": ({"items.q": {"$ne": 1}}, "NOT " + _ANY.format("items", "i.q = 1")),
    "filter_fanout_two": ({"items.q": {"$gt": 2, "$lt": 3}}, _ANY.format("items", "i.q > 2") + " AND " + _ANY.format("items", "i.q < 3")),
    "filter_size_null": ({"tags": {"$size": 1}}, "len(tags) = 1"),
    "filter_all_null": ({"tags": {"$all": [2, None]}}, "list_contains(tags, 2) AND " + _ANY.format("tags", "i IS NULL")),
    "filter_all_empty": ({"tags": {"$all": []}}, "tags IS NOT NULL"),
    "filter_array_eq": ({"tags": [2, None, 2.0]}, "_id = 3"),
    "filter_elem_match_null": ({"tags": {"$elemMatch": {"$not": {"$gt": 1}}}}, _ANY.format("tags", "NOT coalesce(i > 1, false)")),
    "filter_elem_match_nested": ({"deep": {"$elemMatch": {"h": {"$elemMatch": {"v": {"$gt": 4, "$lt": 7}}}}}}, _ANY.format("deep", "len(list_filter(i.h, lambda j: coalesce(j.v > 4 AND j.v < 7, false))) > 0")),
    "filter_prefix_empty": ({"s": {"$prefix": ""}}, "s IS NOT NULL"),
    "filter_regex_unicode": ({"s": {"$regex": "^.$"}}, "length(s) = 1"),
    "numeric_exact_wide": ({"$or": [{"x": 2**53 + 1}, {"n": {"$gt": float(2**53)}}, {"d": 0.1}]}, "n = 9007199254740993"),
    "numeric_exact_decimal": ({"d": {"$gt": 1.505, "$lte": 2}}, "d > 1.505 AND d <= 2"),
    "numeric_nan": ({"x": {"$gt": float("inf")}}, "isnan(x)"),
    "numeric_zeros": ({"x": 0}, "x = 0"),
    "schema_nullable": ({"$jsonSchema": {"properties": {"n": {"type": ["int64", "null"], "minimum": 1}, "o": {"required": ["a"]}}}}, "(n IS NULL OR n >= 1)"),
}
for _name, (_filter, _where) in MIXED_FILTERS.items():
    _QUERIES[_name] = lambda spark, sf_dir, f=_filter: finding.find(mixed(spark), {"find": "m", "filter": f, "projection": {"_id": 1}})
    _SQL[_name] = f"SELECT _id FROM {_MIXED_SQL} WHERE {_where}"


def _mixed(name: str, run: Callable[[finding.Source], DataFrame], sql: str, ttl: str | None = None) -> None:
    _QUERIES[name], _SQL[name] = lambda spark, sf_dir: run(mixed(spark, ttl)), sql.replace("MIXED", _MIXED_SQL)


def _stages(*stages: dict):
    return lambda src: pipeline.aggregate(src, {"aggregate": "m", "pipeline": list(stages)})


_mixed("filter_ttl_unbounded", lambda src: src.df.where(compile_filter({"$ttl": "unbounded"}, src.context())).select("_id"), "SELECT _id FROM MIXED WHERE t IS NULL", "t")
_mixed("ttl_visibility_null", lambda src: finding.count(src, {"count": "m"}), "SELECT count(*) AS n FROM MIXED WHERE t IS NULL OR t > TIMESTAMP '2024-01-15 00:00:00'", "t")
_mixed("sort_missing_null", lambda src: finding.find(src, {"find": "m", "sort": {"o.a": 1, "s": -1}, "limit": 5, "projection": {"_id": 1}}), "SELECT _id FROM MIXED ORDER BY o IS NOT NULL, o.a NULLS FIRST, s DESC NULLS LAST, _id LIMIT 5")
_mixed("agg_group_null_key", lambda src: _stages({"$group": {"_id": "$o.a", "n": {"$count": {}}, "lo": {"$min": "$s"}, "t": {"$sum": "$d"}}})(src), "SELECT o.a AS _id, count(*) AS n, CASE WHEN bool_or(s IS NULL) THEN NULL ELSE min(s) END AS lo, coalesce(sum(d), 0)::DECIMAL(38,2) AS t FROM MIXED GROUP BY o IS NULL, o.a")
_mixed("agg_avg_decimal", lambda src: _stages({"$group": {"_id": None, "mean": {"$avg": "$d"}}})(src).select(decimals.text(F.col("mean")).alias("mean")), "SELECT '-0.0' || '38' || repeat('3', 32) AS mean FROM (SELECT sum(d) AS t, count(d) AS n FROM MIXED) WHERE t = -0.23 AND n = 6")
_mixed("agg_sum_overflow_inside", lambda src: _stages({"$project": {"v": {"$literal": 2**62}}}, {"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": {"_id": 0, "n": 1}})(src), "SELECT count(*) AS n FROM MIXED")
_mixed("agg_unwind_shapes", lambda src: _stages({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "k"}}, {"$project": {"tags": 1, "k": 1}})(src), "SELECT _id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL::BIGINT] END) AS tags, unnest(CASE WHEN len(tags) > 0 THEN range(len(tags)) ELSE [NULL::BIGINT] END) AS k FROM MIXED")
_mixed("agg_unwind_drop", lambda src: _stages({"$unwind": "$items"}, {"$project": {"k": "$items.k", "q": "$items.q"}})(src), "SELECT _id, i.k AS k, i.q AS q FROM (SELECT _id, unnest(items) AS i FROM MIXED)")
_mixed("agg_unwind_nested", lambda src: _stages({"$project": {"w": {"in": "$tags", "by": "$n"}}}, {"$unwind": "$w.in"}, {"$project": {"x": "$w.in", "by": "$w.by"}})(src), "SELECT _id, unnest(tags) AS x, n AS by FROM MIXED")
_mixed("project_nested_computed", lambda src: _stages({"$project": {"o.b": 1, "o.twice": "$o.a", "p.q": {"$ifNull": ["$s", "none"]}}})(src).select("_id", "o.b", "o.twice", "p.q"), "SELECT _id, o.b AS b, CASE WHEN o IS NOT NULL THEN o.a END AS twice, coalesce(s, 'none') AS q FROM MIXED")
_mixed("project_type_null", lambda src: _stages({"$project": {"a": {"$type": "$o.a"}, "s": {"$type": "$s"}}})(src), "SELECT _id, CASE WHEN o IS NULL THEN 'missing' WHEN o.a IS NULL THEN 'null' ELSE 'int64' END AS a, CASE WHEN s IS NULL THEN 'null' ELSE 'string' END AS s FROM MIXED")

# -- value operations on columns --------------------------------------------------


def _kinds(df: DataFrame):
    return lambda c: (F.col(c), df.schema[c].dataType)


@query("SELECT o_orderkey, (o_orderkey + o_custkey)::BIGINT AS whole, (-o_orderkey)::BIGINT AS negative, round(o_totalprice::DOUBLE + o_custkey, 4) AS wide FROM orders")
def value_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = _kinds(df)
    wide = columns.add(F.col("o_totalprice").cast("double"), T.DoubleType(), *at("o_custkey"))
    return df.select("o_orderkey", columns.add(*at("o_orderkey"), *at("o_custkey")).alias("whole"), columns.negate(*at("o_orderkey")).alias("negative"), F.round(wide, 4).alias("wide"))


def _equalities(src: finding.Source) -> DataFrame:
    at = _kinds(src.df)
    tests = {"nx": columns.equal(*at("n"), *at("x")), "dx": columns.equal(*at("d"), *at("x")), "nd": columns.equal(*at("n"), *at("d")), "ns": columns.equal(*at("n"), *at("s")), "own": columns.identical(*at("x"), *at("x")), "zero": columns.identical(*at("x"), F.lit(0.0), T.DoubleType())}
    return src.df.select("_id", *(c.alias(k) for k, c in tests.items()))


_mixed("value_equality", _equalities, "SELECT _id, CASE WHEN n IS NULL OR x IS NULL THEN n IS NULL AND x IS NULL WHEN isfinite(x) THEN n::HUGEINT = trunc(x)::HUGEINT AND x = trunc(x) ELSE false END AS nx, CASE WHEN d IS NULL OR x IS NULL THEN d IS NULL AND x IS NULL WHEN isfinite(x) THEN d::DECIMAL(30,6) = x::DECIMAL(30,6) ELSE false END AS dx, CASE WHEN d IS NULL OR n IS NULL THEN d IS NULL AND n IS NULL ELSE n::DECIMAL(30,6) = d::DECIMAL(30,6) END AS nd, n IS NULL AND s IS NULL AS ns, true AS own, false AS zero FROM MIXED")
_mixed("path_resolve_fanout", lambda src: src.df.select("_id", F.array_join(F.transform(columns.path_resolve("items.q", src.df.schema, True), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("q"), columns.path_resolve("tags.0", src.df.schema).alias("first"), columns.path_exists("o.b", src.df.schema).alias("has")), "SELECT _id, coalesce(array_to_string(list_transform(list_filter(items, lambda i: i IS NOT NULL), lambda i: coalesce(i.q::VARCHAR, '-')), ','), '') AS q, tags[1] AS first, o IS NOT NULL AS has FROM MIXED")
_mixed("path_positions", lambda src: src.df.select("_id", F.array_join(F.transform(columns.path_positions("items.k", src.df.schema), lambda x: F.array_join(x.cast("array<string>"), ".")), ",").alias("at")), "SELECT _id, coalesce(array_to_string(list_filter(list_transform(items, lambda i, k: CASE WHEN i IS NOT NULL THEN (k - 1)::VARCHAR END), lambda x: x IS NOT NULL), ','), '') AS at FROM MIXED")
_mixed("array_operations", lambda src: src.df.where("tags is not null").select("_id", columns.array_size(F.col("tags"), src.df.schema["tags"].dataType).alias("n"), columns.array_all(F.col("tags"), src.df.schema["tags"].dataType, [2, 1.0]).alias("both"), columns.array_elem_match(F.col("tags"), src.df.schema["tags"].dataType, None).alias("hole")), "SELECT _id, len(tags) AS n, coalesce(list_contains(tags, 1) AND list_contains(tags, 2), false) AS both, " + _ANY.format("tags", "i IS NULL") + " AS hole FROM MIXED WHERE tags IS NOT NULL")


@query("SELECT p_partkey, contains(p_name, left(p_name, 2)) AS own, contains(p_name, 'zz') AS other FROM part")
def string_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.col("p_name")
    return df.select("p_partkey", columns.string_contains(name, T.StringType(), F.substring(name, 1, 2)).alias("own"), columns.string_contains(name, T.StringType(), F.lit("zz")).alias("other"))


@query("SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    pairs = df.join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", *(F.round(columns.vector_distance(F.col("embedding"), F.col("other"), m), 6).alias(m) for m in ("l2", "cosine")))


# -- vectors --------------------------------------------------------------------

_Q = f"{PROBE}::DOUBLE[]"
_D = "embedding::DOUBLE[]"
_DOT = f"list_dot_product({_D}, {_Q})"
_L2 = f"list_distance({_D}, {_Q})"
_COS = f"(1 - list_cosine_similarity({_D}, {_Q}))"
for _metric, _expr, _bound, _op in (("l2", _L2, ("maxDistance", 4.7), "<="), ("cosine", _COS, ("maxDistance", 0.9), "<="), ("dot", _DOT, ("minScore", 0.3), ">=")):
    command(f"vector_near_{_metric}", {"find": "embeddings", "filter": {"embedding": {"$vectorNear": {"vector": PROBE, "metric": _metric, _bound[0]: _bound[1]}}}, "projection": {"label": 1}}, f"SELECT vec_id, label FROM embeddings WHERE {_expr} {_op} {_bound[1]}")
    command(f"vector_topk_{_metric}", {"find": "embeddings", "filter": {"label": {"$ne": 3}, "embedding": {"$vectorTopK": {"vector": PROBE, "metric": _metric, "k": 25}}}, "projection": {"label": 1}}, f"SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3 ORDER BY {_expr} {'DESC' if _metric == 'dot' else ''}, vec_id LIMIT 25")


@query(f"SELECT vec_id, round({_L2}, 6) AS l2, round({_COS}, 6) AS cosine, round({_DOT}, 6) AS dot FROM embeddings")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", *(F.round(vectors.score(F.col("embedding"), tuple(PROBE), m), 6).alias(m) for m in vectors.METRICS))


@query("SELECT vec_id, round((embedding[1]::DOUBLE / norm)::FLOAT::DOUBLE, 5) AS first, round((embedding[64]::DOUBLE / norm)::FLOAT::DOUBLE, 5) AS last FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalise(F.col("embedding"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", unit.alias("unit"))
    return df.select("vec_id", *(F.round(F.get("unit", F.lit(k)).cast("double"), 5).alias(n) for k, n in ((0, "first"), (63, "last"))))


# -- aggregation ----------------------------------------------------------------


def aggregate(name: str, table: str, stages: list, sql: str, shape=None) -> None:
    command(name, {"aggregate": table, "pipeline": stages}, sql, shape)


aggregate("agg_identity", "region", [], "SELECT * FROM region")
aggregate("agg_match_group_sum_int", "lineitem", [{"$match": {"l_quantity": {"$gte": 10}}}, {"$group": {"_id": "$l_returnflag", "lines": {"$sum": "$l_linenumber"}, "n": {"$count": {}}}}], "SELECT l_returnflag AS _id, sum(l_linenumber)::BIGINT AS lines, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
aggregate("agg_group_count", "events", [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1")
aggregate("agg_group_composite_key", "orders", [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$count": {}}}}], "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2", lambda df: df.select("_id.s", "_id.p", "n"))
aggregate("agg_group_min_max", "orders", [{"$group": {"_id": "$o_orderstatus", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "first": {"$min": "$o_orderdate"}}}], "SELECT o_orderstatus AS _id, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first FROM orders GROUP BY 1")
#: total / n to 34 digits, half even, in whole numbers: enough for quotients of 1 to 99,999.
_AVG = """SELECT _id, rtrim(rtrim(left(q::VARCHAR, d) || '.' || right(q::VARCHAR, 34 - d), '0'), '.') AS mean FROM (
    SELECT _id, d, (t * p) // n + (CASE WHEN 2 * ((t * p) % n) > n OR (2 * ((t * p) % n) = n AND ((t * p) // n) % 2 = 1) THEN 1 ELSE 0 END) AS q FROM (
        SELECT *, length((t // n)::VARCHAR) AS d, (CASE length((t // n)::VARCHAR) WHEN 1 THEN '1000000000000000000000000000000000' WHEN 2 THEN '100000000000000000000000000000000' WHEN 3 THEN '10000000000000000000000000000000' WHEN 4 THEN '1000000000000000000000000000000' ELSE '100000000000000000000000000000' END)::HUGEINT AS p
        FROM ({}) ))"""
aggregate("agg_group_avg", "customer", [{"$group": {"_id": "$c_mktsegment", "mean": {"$avg": "$c_nationkey"}}}], _AVG.format("SELECT c_mktsegment AS _id, sum(c_nationkey)::HUGEINT AS t, count(*)::HUGEINT AS n FROM customer GROUP BY 1"), lambda df: df.select("_id", decimals.text(F.col("mean")).alias("mean")))
aggregate("agg_avg_then_match", "customer", [{"$group": {"_id": "$c_nationkey", "mean": {"$avg": "$c_custkey"}}}, {"$match": {"mean": {"$gte": 700.5}}}, {"$sort": {"mean": -1}}, {"$project": {"_id": 1}}], "SELECT c_nationkey AS _id FROM customer GROUP BY 1 HAVING 2 * sum(c_custkey) >= 1401 * count(*)")
aggregate("agg_sum_float_tree", "events", [{"$group": {"_id": "$event_type", "total": {"$sum": "$value"}, "mean": {"$avg": "$value"}}}], "SELECT event_type AS _id, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1", lambda df: df.select("_id", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean")))
aggregate("agg_group_all", "events", [{"$group": {"_id": None, "n": {"$count": {}}, "top": {"$max": "$user_id"}}}, {"$project": {"_id": 0, "n": 1, "top": 1}}], "SELECT count(*) AS n, max(user_id) AS top FROM events")
aggregate("agg_count", "orders", [{"$match": {"o_orderstatus": "O"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
aggregate("agg_count_empty", "orders", [{"$match": {"o_orderkey": -1}}, {"$count": "n"}], "SELECT 0::BIGINT AS n")
aggregate("agg_sort_limit", "orders", [{"$sort": {"o_totalprice": -1}}, {"$limit": 30}], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
aggregate("agg_skip", "orders", [{"$sort": {"o_custkey": 1}}, {"$skip": 100}, {"$limit": 40}], "SELECT * FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 100")
aggregate("agg_limit_then_match", "orders", [{"$limit": 500}, {"$match": {"o_orderstatus": "F"}}], "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus = 'F'")
aggregate("agg_two_groups", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$group": {"_id": "$n", "customers": {"$count": {}}}}, {"$sort": {"_id": -1}}], "SELECT n AS _id, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
aggregate("agg_unwind", "embeddings", [{"$unwind": "$embedding"}, {"$project": {"vec_id": 1, "embedding": 1}}], "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
aggregate("agg_unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "k", "preserveNullAndEmptyArrays": True}}, {"$project": {"vec_id": 1, "k": 1}}], "SELECT vec_id, unnest(range(len(embedding))) AS k FROM embeddings")
aggregate("agg_unwind_group", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "k"}}, {"$match": {"embedding": {"$gt": 0}}}, {"$group": {"_id": "$k", "n": {"$count": {}}}}], "SELECT k AS _id, count(*) AS n FROM (SELECT unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings) WHERE x > 0 GROUP BY 1")
aggregate("project_computed", "customer", [{"$project": {"c_custkey": 1, "name": "$c_name", "tag": {"$literal": "$x"}, "pair": {"a": "$c_nationkey", "b": "$gone"}}}], "SELECT c_custkey, c_name AS name, '$x' AS tag, c_nationkey AS a FROM customer", lambda df: df.select("c_custkey", "name", "tag", "pair.a"))
aggregate("project_if_null", "events", [{"$project": {"event_id": 1, "v": {"$ifNull": ["$gone", "$user_id"]}}}], "SELECT event_id, user_id AS v FROM events")
aggregate("project_type_size", "embeddings", [{"$project": {"vec_id": 1, "t": {"$type": "$embedding"}, "u": {"$type": "$gone"}, "n": {"$size": "$embedding"}}}], "SELECT vec_id, 'array' AS t, 'missing' AS u, len(embedding) AS n FROM embeddings")
aggregate("agg_project_exclusion", "customer", [{"$project": {"c_name": 0, "c_acctbal": False}}], "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")

# -- updates as post-images ------------------------------------------------------


def update(name: str, table: str, target: dict, spec: dict, sql: str, prepare=None, shape=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = database(spark, sf_dir, table).source(table)
        df = prepare(src.df) if prepare else src.df
        bound = finding.Source(df, src.id)
        out = updates.post_image(df, spec, F.coalesce(compile_filter(target, bound.context(), False), F.lit(False)), src.id)
        out = out.drop(paths.SEEN)
        return shape(out) if shape else out

    _QUERIES[name], _SQL[name] = run, sql


_TAGS = lambda df: df.select("n_nationkey", F.array(F.col("n_regionkey"), F.lit(7).cast("long"), F.col("n_regionkey")).alias("tags"))
_JOIN = lambda df: df.select("n_nationkey", F.array_join(F.transform("tags", lambda x: x.cast("string")), ",").alias("tags"))
_R = "n_regionkey::VARCHAR"
update("update_set", "customer", {"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "DEBT", "flag": "owes"}}, "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment), CASE WHEN c_acctbal < 0 THEN 'owes' END AS flag FROM customer")
update("update_unset", "customer", {"c_custkey": {"$lte": 10}}, {"$unset": {"c_name": True}}, "SELECT * REPLACE (CASE WHEN c_custkey <= 10 THEN NULL ELSE c_name END AS c_name) FROM customer")
update("update_inc", "nation", {"n_nationkey": {"$gt": 3}}, {"$inc": {"n_regionkey": 5}}, "SELECT n_nationkey, (CASE WHEN n_nationkey > 3 THEN n_regionkey + 5 ELSE n_regionkey END)::BIGINT AS n_regionkey FROM nation", shape=lambda df: df.select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey")))
update("update_push", "nation", {}, {"$push": {"tags": {"$each": [9], "$position": 1}}}, f"SELECT n_nationkey, {_R} || ',9,7,' || {_R} AS tags FROM nation", _TAGS, _JOIN)
update("update_add_to_set", "nation", {}, {"$addToSet": {"tags": {"$each": [7, 8]}}}, f"SELECT n_nationkey, {_R} || ',7,' || {_R} || ',8' AS tags FROM nation", _TAGS, _JOIN)
update("update_pop", "nation", {}, {"$pop": {"tags": -1}}, f"SELECT n_nationkey, '7,' || {_R} AS tags FROM nation", _TAGS, _JOIN)
update("update_pull", "nation", {}, {"$pull": {"tags": 7}}, f"SELECT n_nationkey, {_R} || ',' || {_R} AS tags FROM nation", _TAGS, _JOIN)


def _opened(spark: SparkSession, sf_dir: str, table: str, *commands: dict, ttl: str | None = None) -> tuple[Database, list[dict]]:
    """A snapshot collection of the table after commands, as another session finds it, and what the commands gave."""
    import uuid

    from .sources.folders import scratch

    (key,) = IDS[table]
    folder = f"{scratch(spark)}/collection-{uuid.uuid4().hex}"
    db = Database(spark)
    db.create(table, folder, spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, ttl, NOW)
    results = [db.run(c) for c in commands]
    other = Database(spark)
    other.open(table, folder, now=NOW)
    return other, results


def _written(spark: SparkSession, sf_dir: str, table: str, *commands: dict, ttl: str | None = None) -> DataFrame:
    return _opened(spark, sf_dir, table, *commands, ttl=ttl)[0].source(table).shown()


@query("SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
def update_many_own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update changes the very field that its filter asks for."""
    return _written(spark, sf_dir, "customer", {"updateMany": "customer", "filter": {"c_mktsegment": "BUILDING"}, "update": {"$set": {"c_mktsegment": "MOVED"}}})


@query("SELECT * REPLACE (CASE WHEN c_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) THEN 'LEAST' ELSE c_name END AS c_name) FROM customer")
def update_one_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "customer", {"updateOne": "customer", "filter": {}, "sort": {"c_acctbal": 1}, "update": {"$set": {"c_name": "LEAST"}}})


@query("SELECT * FROM (SELECT 0 AS step, count(*) AS matched, 0::BIGINT AS modified FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 1, count(*), count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, 0, 0)")
def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and modified documents: a no-op, a change of the filter's own field, and no target."""
    steps = ({"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "BUILDING"}}), ({"c_acctbal": {"$lt": 0}}, {"$set": {"c_acctbal": 0.0}}), ({"c_custkey": -1}, {"$set": {"c_name": "x"}})
    _, results = _opened(spark, sf_dir, "customer", *({"updateMany": "customer", "filter": f, "update": u} for f, u in steps))
    return spark.createDataFrame([(k, r["matchedCount"], r["modifiedCount"]) for k, r in enumerate(results)], "step int, matched long, modified long")


@query(f"SELECT event_id, CASE WHEN event_type = 'click' AND ts > {_AT} THEN 'seen' ELSE event_type END AS event_type FROM events WHERE NOT (event_type = 'view' AND ts > {_AT})")
def write_skips_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and deletes leave expired rows alone, as reads don't see them."""
    out = _written(spark, sf_dir, "events", {"updateMany": "events", "filter": {"event_type": "click"}, "update": {"$set": {"event_type": "seen"}}}, {"deleteMany": "events", "filter": {"event_type": "view"}}, ttl="ts")
    return out.select("event_id", "event_type")


@query("SELECT r_regionkey, CASE r_regionkey WHEN 2 THEN 'TWICE' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 50, 'NEW' UNION ALL SELECT 0, 'BACK'")
def write_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates, deletes and an id that comes back, as parts and tombstones."""
    set_name = lambda k, x: {"updateOne": "region", "filter": {"r_regionkey": k}, "update": {"$set": {"r_name": x}}}
    insert = lambda k, x: {"insertOne": "region", "document": {"r_regionkey": k, "r_name": x}}
    steps = (insert(50, "OLD"), set_name(2, "ONCE"), {"deleteMany": "region", "filter": {"r_regionkey": {"$in": [0, 50]}}}, insert(50, "NEW"), set_name(2, "TWICE"), insert(0, "BACK"))
    return _written(spark, sf_dir, "region", *steps).select("r_regionkey", "r_name")


@query("SELECT * FROM customer WHERE NOT c_acctbal < 0")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "customer", {"deleteMany": "customer", "filter": {"c_acctbal": {"$lt": 0}}})


@query("SELECT * FROM nation WHERE n_nationkey <> (SELECT max(n_nationkey) FROM nation)")
def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "nation", {"deleteOne": "nation", "filter": {}, "sort": {"n_nationkey": -1}})


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS r_name FROM region")
def replace_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "region", {"replaceOne": "region", "filter": {"r_regionkey": 1}, "replacement": {"r_name": "NEW"}}).select("r_regionkey", "r_name")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'ADDED'")
def upsert_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "region", {"updateOne": "region", "filter": {"r_regionkey": 77}, "update": {"$setOnInsert": {"r_name": "ADDED"}}, "upsert": True}).select("r_regionkey", "r_name")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'a'), (91, 'b')) t")
def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "region", {"insertMany": "region", "documents": [{"r_regionkey": 90, "r_name": "a"}, {"r_regionkey": 91, "r_name": "b"}]}).select("r_regionkey", "r_name")


@query("""WITH t AS (SELECT *, CASE WHEN c_nationkey < 8 THEN 0 WHEN c_nationkey < 16 THEN 1 ELSE 2 END AS third FROM customer)
SELECT 'unset' AS what, count(*) FILTER (third = 0) AS n FROM t UNION ALL SELECT 'null', count(*) FILTER (third = 1) FROM t UNION ALL SELECT 'created', count(*) FILTER (third = 2) FROM t UNION ALL SELECT 'not inserted', 1
UNION ALL SELECT 'type', count(*) FILTER (third = 1) FROM t UNION ALL SELECT 'ne', count(*) FILTER (third <> 2) + 1 FROM t UNION ALL SELECT 'sorted', min(c_custkey) FILTER (third = 0) FROM t""")
def missing_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After an unset, a set to null, a created field and an insert without fields, missing and null stay apart, also in another session."""
    thirds = ({"c_nationkey": {"$lt": 8}}, {"c_nationkey": {"$gte": 8, "$lt": 16}}, {"c_nationkey": {"$gte": 16}})
    update = lambda k, u: {"updateMany": "customer", "filter": thirds[k], "update": u}
    db, _ = _opened(spark, sf_dir, "customer", update(0, {"$unset": {"c_name": True}}), update(1, {"$set": {"c_name": None}}), update(2, {"$set": {"extra.x": 1}}), {"insertOne": "customer", "document": {"c_custkey": -1, "c_name": "z"}})
    count = lambda f: db.run({"count": "customer", "filter": f}).first()["n"]
    rows = [
        ("unset", count({"c_name": {"$exists": False}})), ("null", count({"c_name": None})), ("created", count({"extra.x": {"$exists": True}})), ("not inserted", count({"c_acctbal": {"$exists": False}})),
        ("type", count({"c_name": {"$type": "null"}})), ("ne", count({"extra.x": {"$ne": 1}})), ("sorted", db.run({"find": "customer", "sort": {"c_name": 1}, "limit": 1}).first()["c_custkey"]),
    ]
    return spark.createDataFrame(rows, "what string, n long")


# -- documents -------------------------------------------------------------------


@query("SELECT 2::TINYINT AS name_st, c_name AS name_v, 0::TINYINT AS gone_st FROM customer")
def document_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import tagged

    docs = tagged.import_documents(tagged.export_documents(tagged.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet")), "c_custkey"))
    out = tagged.with_sidecars(docs, {"c_name": ("string", "name"), "gone": ("int64", "gone")})
    return out.select(F.col("name__st").alias("name_st"), F.col("name__v").alias("name_v"), F.col("gone__st").alias("gone_st"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS at FROM customer")
def value_order_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a nation in the order of the binary keys of a field's dynamic values."""
    from pyspark.sql import Window as W

    from .functions import tagged

    docs = tagged.export_documents(tagged.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet")), "c_custkey")
    keyed = tagged.with_sidecars(docs, {"_id": ("int64", "id"), "c_acctbal": ("float64", "bal"), "c_nationkey": ("int64", "nation")})
    at = F.row_number().over(W.partitionBy("nation__v").orderBy("bal__key", "id__key")).cast("long")
    return keyed.select(F.col("id__v").alias("c_custkey"), at.alias("at"))


@query("SELECT c_custkey, c_name, c_acctbal, true AS same FROM customer")
def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in the binary form and read back, with their values and the hash of their typed content."""
    from .functions import binary, tagged

    docs = tagged.export_documents(tagged.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet")), "c_custkey")
    back = binary.from_binary(binary.to_binary(docs))
    again = back.withColumn("hash", F.col("content_hash"))
    keyed = tagged.with_sidecars(again, {"_id": ("int64", "id"), "c_name": ("string", "name"), "c_acctbal": ("float64", "bal")})
    return keyed.select(F.col("id__v").alias("c_custkey"), F.col("name__v").alias("c_name"), F.col("bal__v").alias("c_acctbal"), (F.col("error").isNull() & (F.length("hash") == 64)).alias("same"))


@query("SELECT row_number() OVER (ORDER BY r_regionkey)::INTEGER AS step, r_regionkey::INTEGER AS id FROM region WHERE r_regionkey > 0")
def path_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a published path dictionary gives the paths of a schema, as another session recovers them."""
    import uuid

    from .sources.folders import scratch
    from .sources.registry import PathRegistry

    folder = f"{scratch(spark)}/registry-{uuid.uuid4().hex}"
    PathRegistry(spark, folder).register(["p1", "p2"])
    other = PathRegistry(spark, folder)
    other.recover()
    other.register(["p2", "p3"])
    kept = PathRegistry(spark, folder).recover()
    return spark.createDataFrame([(k, kept.id(f"p{k}") - 1) for k in range(1, 4)] + [(4, len(kept.paths))], "step int, id int")


# -- conversions -----------------------------------------------------------------


@query("SELECT event_id, ts AS at, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, NULL::TIMESTAMP AS bad FROM events")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import convert

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    at = convert.parse_timestamp(text)
    bad = convert.parse_timestamp(F.regexp_replace(text, "Z$", "-00:00"))
    return events.select("event_id", at.cast("timestamp_ntz").alias("at"), convert.to_date(F.col("ts")).cast("string").alias("day"), bad.cast("timestamp_ntz").alias("bad"))


@query("SELECT o_orderkey, o_orderkey::DOUBLE AS exact, CAST(round_even(o_totalprice, 0) AS BIGINT) AS rounded FROM orders")
def numeric_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import convert

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = lambda c: orders.schema[c].dataType
    exact = convert.convert(F.col("o_orderkey"), kind("o_orderkey"), "float64")
    return orders.select("o_orderkey", exact.alias("exact"), convert.convert(F.col("o_totalprice"), kind("o_totalprice"), "int64", "round").alias("rounded"))
