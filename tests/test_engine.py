"""Filters, find, pipelines, updates and collections on a small typed table, against a plain evaluator."""

import datetime as dt
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from lodestone import jsonio, limits, paths
from lodestone.errors import EngineError
from lodestone.functions import columns, decimals
from lodestone.functions import values as V
from lodestone.operators import find as finding
from lodestone.operators import pipeline, regex, updates
from lodestone.operators.filters import Context, compile_filter
from lodestone.sources.collections import Database, uuid7

SCHEMA = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("d", T.DecimalType(10, 2)), T.StructField("s", T.StringType()),
    T.StructField("tags", T.ArrayType(T.LongType())), T.StructField("o", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("q", T.LongType())]))),
])


def code(expected, f, *args, **kwargs):
    with pytest.raises(EngineError) as e:
        f(*args, **kwargs)
    assert e.value.code == expected, e.value


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    pick = lambda xs: rng.choice(xs)
    out = []
    for k in range(60):
        items = pick([None, [], [(pick(["u", "v", None]), pick([1, 2, 3, None])) for _ in range(rng.randrange(1, 4))], [None, ("w", 9)]])
        out.append((k, pick([None, 1, 2, 3, 2**53 + 1]), pick([None, 0.5, 1.0, 2.0, float(2**53), float("nan"), float("inf")]), pick([None, Decimal("1.50"), Decimal("2.00")]), pick([None, "", "abc", "abd", "b\n", "É"]), pick([None, [], [1], [1, 2], [2, None, 2]]), pick([None, (1, "p"), (None, "q"), (2, None)]), items))
    return out


@pytest.fixture(scope="module")
def source(spark, data):
    return finding.Source(spark.createDataFrame(data, SCHEMA).repartition(3))


def candidates(row, path):
    """The contract's candidates of a path in a row, as Python values."""
    def step(v, part):
        if isinstance(v, dict):
            return [v[part]] if part in v else []
        if isinstance(v, list):
            if part.isdigit():
                return [v[int(part)]] if int(part) < len(v) else []
            return [x[part] for x in v if isinstance(x, dict) and part in x]
        return []

    now = [row]
    for p in path.split("."):
        now = [y for x in now for y in step(x, p)]
    return now


def as_value(x):
    if isinstance(x, dict):
        return V.Value("object", {k: as_value(y) for k, y in x.items()})
    if isinstance(x, list):
        return V.Value("array", tuple(map(as_value, x)))
    return V.literal(x)


def matches(row, spec):
    def one(op, operand, cands):
        lit = as_value(operand) if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") else None
        vals = [as_value(c) for c in cands]
        same = lambda v: V.rank(v) == V.rank(lit)
        if op == "$eq":
            return any(V.equal(v, lit) for v in vals)
        if op == "$ne":
            return not any(V.equal(v, lit) for v in vals)
        if op in ("$gt", "$gte", "$lt", "$lte"):
            test = {"$gt": lambda c: c > 0, "$gte": lambda c: c >= 0, "$lt": lambda c: c < 0, "$lte": lambda c: c <= 0}[op]
            return lit.type != "null" and any(same(v) and test(V.compare(v, lit)) for v in vals)
        if op in ("$in", "$nin"):
            return any(V.equal(v, as_value(x)) for v in vals for x in operand) == (op == "$in")
        if op == "$exists":
            return bool(cands) == operand
        if op == "$size":
            return any(isinstance(c, list) and len(c) == operand for c in cands)
        if op == "$all":
            return any(isinstance(c, list) and all(any(V.equal(as_value(y), as_value(x)) for y in c) for x in operand) for c in cands)
        if op == "$elemMatch":
            hit = lambda y: all(one(o, v, [y]) for o, v in operand.items()) if next(iter(operand)).startswith("$") else isinstance(y, dict) and matches(y, operand)
            return any(isinstance(c, list) and any(hit(y) for y in c) for c in cands)
        if op == "$prefix":
            return any(isinstance(c, str) and c.startswith(operand) for c in cands)
        if op == "$contains":
            return any(isinstance(c, str) and operand in c for c in cands)
        if op == "$not":
            return not all(one(o, v, cands) for o, v in operand.items())
        if op == "$type":
            return any(as_value(c).type in ({"number": V.NUMERIC}.get(operand, (operand,))) for c in cands)
        raise AssertionError(op)

    for key, operand in spec.items():
        if key == "$and" and not all(matches(row, s) for s in operand) or key == "$or" and not any(matches(row, s) for s in operand):
            return False
        if key == "$nor" and any(matches(row, s) for s in operand) or key == "$not" and matches(row, operand):
            return False
        if not key.startswith("$"):
            ops = operand if isinstance(operand, dict) and operand and all(k.startswith("$") for k in operand) else {"$eq": operand}
            if not all(one(o, v, candidates(row, key)) for o, v in ops.items()):
                return False
    return True


FILTERS = [
    {}, {"n": 1}, {"n": None}, {"n": {"$ne": 2}}, {"n": {"$gt": 1}}, {"n": {"$gte": 1.5}}, {"n": {"$lt": 2.5}}, {"n": float(2**53)}, {"n": {"$gt": float(2**53)}}, {"x": 2**53}, {"x": 2**53 + 1}, {"x": {"$lt": 2**53 + 1}},
    {"x": float("nan")}, {"x": {"$gt": 1}}, {"x": {"$lte": float("inf")}}, {"x": {"$in": [0.5, float("nan")]}}, {"d": 1.5}, {"d": {"$gt": 1.505}}, {"d": {"$lte": 2}}, {"d": {"$in": [2, None]}}, {"s": {"$gt": 5}}, {"s": {"$gte": "abd"}}, {"s": ""},
    {"n": {"$in": []}}, {"n": {"$nin": []}}, {"n": {"$in": [1, None, "x"]}}, {"n": {"$nin": [1, None]}}, {"gone": None}, {"gone": {"$ne": 1}}, {"gone": {"$exists": False}}, {"o.a": {"$exists": True}}, {"o.a": None}, {"o.a": {"$ne": 1}}, {"o.zz": {"$exists": True}},
    {"tags": {"$size": 2}}, {"tags": {"$all": [2, None]}}, {"tags": {"$all": []}}, {"tags": {"$elemMatch": {"$gt": 1}}}, {"tags.0": 1}, {"tags.1": None}, {"tags.7": {"$exists": True}}, {"tags": [1, 2]}, {"items.k": "u"}, {"items.k": None}, {"items.q": {"$gt": 2}},
    {"items.q": {"$ne": 1}}, {"items.q": {"$not": {"$gt": 1}}}, {"items": {"$elemMatch": {"k": "u", "q": {"$gte": 2}}}}, {"items.0.q": {"$lt": 3}}, {"items.k": {"$exists": True}}, {"items.q": {"$in": [3, None]}}, {"items.q": {"$nin": [3, None]}},
    {"s": {"$prefix": "ab"}}, {"s": {"$contains": "b"}}, {"s": {"$prefix": ""}}, {"n": {"$prefix": "1"}}, {"$and": [{"n": 1}, {"s": "abc"}]}, {"$or": [{"n": 1}, {"o.b": "q"}]}, {"$nor": [{"n": 1}, {"x": {"$gt": 1}}]}, {"$not": {"n": {"$gt": 1}}}, {"$and": [], "$nor": []}, {"$or": []},
    {"n": {"$not": {"$gt": 1}}}, {"n": {"$type": "number"}}, {"x": {"$type": "null"}}, {"items.k": {"$type": "string"}}, {"o": {"a": 1, "b": "p"}}, {"o": {"b": "p", "a": 1}}, {"n": {"$gte": None}}, {"n": {"$gt": None}}, {"n": {"$lte": None}}, {"items.k": {"$gte": None}}, {"n": {"$not": {"$lte": None}}}, {"n": {"$gt": 1, "$lt": 3}}, {"$or": [{"n": {"$ne": 1}}, {"items.q": 9}]},
]


def test_filters_against_evaluator(source, data):
    """All in one job: a column for each filter."""
    ctx = Context(SCHEMA)
    got = source.df.select("_id", *(compile_filter(f, ctx, False).alias(f"f{k}") for k, f in enumerate(FILTERS))).collect()
    rows = {r[0]: Row(*SCHEMA.names)(*r) for r in data}

    def plain(x, kind):
        if x is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: plain(x[k], f.dataType) for k, f in enumerate(kind)}
        return [plain(y, kind.elementType) for y in x] if isinstance(kind, T.ArrayType) else x

    for r in got:
        row = plain(tuple(rows[r._id]), SCHEMA)
        for k, f in enumerate(FILTERS):
            assert r[f"f{k}"] == matches(row, f), (f, row)


def test_filters_as_filters(source, data):
    """The pushed form keeps the same rows as the two-valued one."""
    ctx = Context(SCHEMA)
    for f in FILTERS[1:60:7]:
        bare = {r._id for r in source.df.where(compile_filter(f, ctx)).collect()}
        full = {r._id for r in source.df.where(compile_filter(f, ctx, False)).collect()}
        assert bare == full, f


@pytest.mark.parametrize("spec, expected", [
    ({"n": {"$foo": 1}}, "VAL_UNKNOWN_OPERATOR"), ({"$foo": 1}, "VAL_UNKNOWN_OPERATOR"), ({"n": {"$in": 3}}, "VAL_INVALID_SHAPE"), ({"n": {"$exists": 1}}, "VAL_INVALID_SHAPE"), ({"n": {"$size": -1}}, "VAL_INVALID_SHAPE"),
    ({"a..b": 1}, "VAL_INVALID_PATH"), ({"n": {"$gt": 1, "b": 2}}, "VAL_INVALID_SHAPE"), ({"$or": [{"n": 1}, {"n": {"$bad": 1}}]}, "VAL_UNKNOWN_OPERATOR"), ({"s": {"$regex": "(a)\\1"}}, "CAP_UNSUPPORTED_FEATURE"),
    ({"s": {"$regex": "(?=a)"}}, "CAP_UNSUPPORTED_FEATURE"), ({"s": {"$regex": {"pattern": "a", "flags": "i"}}}, "CAP_UNSUPPORTED_FEATURE"), ({"s": {"$regex": "("}}, "VAL_INVALID_LITERAL"), ({"n": {"$type": "missing"}}, "VAL_INVALID_SHAPE"),
    ({"n": {"$in": list(range(10_001))}}, "QUOTA_LIMIT_EXCEEDED"), ({"n": {"$value": {"type": "int32", "value": "3000000000"}}}, "VAL_INVALID_LITERAL"), ({"$ttl": "active"}, "VAL_UNSUPPORTED_COMBINATION"), ({"$jsonSchema": {"format": 1}}, "VAL_UNKNOWN_OPERATOR"),
    ([], "VAL_INVALID_SHAPE"), ({"$or": [{"v": {"$vectorTopK": {}}}]}, "VAL_UNSUPPORTED_COMBINATION"), ({"tags.99999999999": 1}, "VAL_INVALID_PATH"),
])
def test_invalid_filters(spark, spec, expected):
    code(expected, compile_filter, spec, Context(SCHEMA))


def test_pushdown(spark, source, tmp_path):
    source.df.write.parquet(str(tmp_path / "t"))
    src = finding.Source(spark.read.parquet(str(tmp_path / "t")))
    plan = finding.find(src, {"find": "t", "filter": {"n": {"$gte": 2}, "s": "abc"}, "projection": {"n": 1}})._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,2)" in plan and "EqualNullSafe(s,abc)" in plan and "items" not in plan.split("ReadSchema")[-1]


def test_find_order_and_projection(source, data):
    ids = lambda c: [r._id for r in finding.find(source, {"find": "t"} | c).collect()]
    assert ids({}) == list(range(60)) and ids({"skip": 3, "limit": 4}) == [3, 4, 5, 6] and ids({"limit": 0}) == []
    by_n = sorted(range(60), key=lambda k: (data[k][1] is not None, data[k][1] or 0))
    assert ids({"sort": {"n": 1}}) == by_n
    assert ids({"sort": {"n": -1, "_id": -1}}) == by_n[::-1]
    keep = finding.find(source, {"find": "t", "projection": {"s": 1, "o.b": True}})
    assert keep.columns == ["_id", "s", "o"] and keep.schema["o"].dataType.names == ["b"]
    assert finding.find(source, {"find": "t", "projection": {"s": 0, "o.b": 0}}).schema["o"].dataType.names == ["a"]
    assert finding.find(source, {"find": "t", "projection": {"_id": 1}}).columns == ["_id"]
    assert finding.find(source, {"find": "t", "projection": {"_id": 0, "s": 1}}).columns == ["s"]
    code("VAL_UNKNOWN_OPTION", finding.find, source, {"find": "t", "hint": 1})
    code("VAL_CONFLICTING_PATHS", finding.find, source, {"find": "t", "projection": {"o": 1, "o.a": 1}})
    code("VAL_UNSUPPORTED_COMBINATION", finding.find, source, {"find": "t", "projection": {"s": 1, "n": 0}})
    code("VAL_UNSUPPORTED_COMBINATION", finding.find, source, {"find": "t", "sort": {"items.q": 1}})
    code("VAL_INVALID_SHAPE", finding.find, source, {"find": "t", "sort": {"n": 2}})
    assert finding.count(source, {"count": "t", "skip": 50, "limit": 100}).first().n == 10


def test_positions(spark, source, data, monkeypatch):
    """$skip and $limit as one range of positions, in the few best rows or in rows stored in order; no task gets all rows."""
    by_n = sorted(range(60), key=lambda k: (-(data[k][1] or 0) if data[k][1] is not None else 1, k))
    run = lambda *stages: pipeline.aggregate(source, {"aggregate": "t", "pipeline": [{"$sort": {"n": -1}}, *stages]})
    cases = [
        ([("$skip", 7)], 7, 60), ([("$skip", 2), ("$limit", 9)], 2, 11), ([("$limit", 9), ("$skip", 2)], 2, 9), ([("$skip", 3), ("$skip", 4), ("$limit", 30), ("$limit", 12)], 7, 19),
        ([("$limit", 4), ("$skip", 9)], 0, 0), ([("$skip", 60)], 60, 60), ([("$skip", 59), ("$limit", 2**40)], 59, 60), ([("$limit", 0)], 0, 0), ([("$skip", 0)], 0, 60), ([("$limit", 55)], 0, 55),
    ]
    for most in (finding.MOST_KEPT, 5):
        monkeypatch.setattr(finding, "MOST_KEPT", most)
        for stages, begin, end in cases:
            assert [r._id for r in run(*({k: n} for k, n in stages)).collect()] == by_n[begin:end], (most, stages)
        for skip, limit in ((7, None), (58, 9), (3, 50)):
            command = {"find": "t", "sort": {"n": -1}, "skip": skip} | ({} if limit is None else {"limit": limit})
            assert [r._id for r in finding.find(source, command).collect()] == by_n[skip : 60 if limit is None else skip + limit]
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (run({"$skip": 7}), run({"$skip": 2}, {"$limit": 9}), finding.find(source, {"find": "t", "skip": 7})):
        assert "GlobalLimit" not in shown(df) and "SinglePartition" not in shown(df)


def test_pipeline(source, data):
    run = lambda *stages: pipeline.aggregate(source, {"aggregate": "t", "pipeline": list(stages)})
    groups = run({"$group": {"_id": "$n", "c": {"$count": {}}, "m": {"$min": "$s"}, "t": {"$sum": "$n"}, "a": {"$avg": "$d"}}})
    groups = groups.withColumn("a", decimals.text(groups.a)).collect()
    keys = [g._id for g in groups]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    for g in groups:
        mine = [r for r in data if r[1] == g._id]
        ds = [r[3] for r in mine if r[3] is not None]
        assert g.c == len(mine) and g.t == sum(r[1] or 0 for r in mine)
        assert (g.a is None) == (not ds) and (not ds or Decimal(g.a) == V.DECIMAL.divide(sum(ds), Decimal(len(ds))))
        assert g.m == min((r[4] for r in mine), key=lambda s: (s is not None, s or ""))
    out = run({"$unwind": {"path": "$tags", "includeArrayIndex": "k"}}, {"$project": {"tags": 1, "k": 1}}).collect()
    assert [(r._id, r.tags, r.k) for r in out] == [(d[0], t, k) for d in data for k, t in enumerate(d[5] or [])]
    assert len(run({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}).collect()) == sum(max(1, len(d[5] or [])) for d in data)
    assert [r._id for r in run({"$sort": {"n": -1}}, {"$skip": 2}, {"$limit": 5}, {"$match": {"_id": {"$gte": 0}}}).collect()] == sorted(range(60), key=lambda k: (-(data[k][1] or 0), k))[2:7]
    assert run({"$match": {"_id": -1}}, {"$count": "n"}).collect() == [Row(n=0)]
    assert run({"$match": {"_id": -1}}, {"$group": {"_id": None, "n": {"$count": {}}}}).collect() == []
    made = run({"$project": {"_id": 0, "t": {"$type": "$gone"}, "u": {"$type": "$n"}, "f": {"$ifNull": ["$s", "none"]}, "o": {"z": "$n", "gone": "$gone"}}}).first()
    assert made.t == "missing" and made.u in ("int64", "null") and made.o.asDict().keys() == {"z"}
    for stage, expected in (({"$lookup": {}}, "CAP_UNSUPPORTED_FEATURE"), ({"$bad": 1}, "VAL_UNKNOWN_OPERATOR"), ({"$limit": -1}, "VAL_INVALID_SHAPE"), ({"$group": {"_id": 1, "x": {"$push": "$n"}}}, "VAL_UNKNOWN_OPERATOR"), ({"$group": {"_id": 1, "x": {"$sum": "$s"}}}, "TYPE_MISMATCH"), ({"$unwind": "$s"}, "TYPE_MISMATCH"), ({"$count": "_id"}, "VAL_PROTECTED_FIELD")):
        code(expected, run, stage)


def test_averages_have_34_digits(spark):
    """Long division on the JVM against the decimal context, ties and carries included; the struct's order is the numbers' order."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    pairs = [(4, 3), (0, 5), (1, 3), (2, 3), (-1, 7), (10**18 - 1, 10**18), (1, 2**62), (2**63 - 1, 1), (-(2**63), 3), (5, 0), (1, 8), (-(10**18) + 1, 10**18)]
    pairs += [(rng.randrange(-(10 ** rng.randrange(1, 19)), 10 ** rng.randrange(1, 19)), rng.randrange(1, 10 ** rng.randrange(1, 19))) for _ in range(300)]
    df = spark.createDataFrame([(k, Decimal(a), b) for k, (a, b) in enumerate(pairs)], "k int, t decimal(38,0), n long")
    df = df.withColumn("q", decimals.divide(F.col("t"), 0, F.col("n"))).withColumn("s", decimals.divide(F.col("t").cast("decimal(38,3)"), 3, F.col("n")))
    got = df.select("k", "q", decimals.text(F.col("q")).alias("x"), decimals.text(F.col("s")).alias("y")).collect()
    want = {k: None if not b else V.DECIMAL.divide(Decimal(a), Decimal(b)) for k, (a, b) in enumerate(pairs)}
    for r in got:
        assert (r.x is None) == (want[r.k] is None)
        assert r.x is None or Decimal(r.x) == Decimal(r.y) == want[r.k], pairs[r.k]
    order = [r.k for r in df.where("q is not null").orderBy("q", "k").collect()]
    assert order == sorted((k for k in want if want[k] is not None), key=lambda k: (want[k], k))
    for r in got:
        if r.q is not None:
            assert decimals.parts(Fraction(want[r.k])) == (r.q.rank, int(r.q.coefficient), True)
    src = finding.Source(spark.createDataFrame([(k, k % 3, k) for k in range(10)], "_id long, g long, v long"))
    run = lambda f: [r["_id"] for r in pipeline.aggregate(src, {"aggregate": "t", "pipeline": [{"$group": {"_id": "$g", "a": {"$avg": "$v"}}}, {"$match": {"a": f}}]}).collect()]
    assert run({"$gt": 4.25}) == [0, 2] and run({"$lte": 4}) == [1] and run({"$in": [4, 4.5]}) == [0, 1] and run({"$lt": Decimal("4.5")}) == [1]


def test_long_decimal_literals_are_exact(spark):
    """Literals of more than 28 digits, which Python's own context would round."""
    x = Decimal("1234567890123456789012345678901234.25")
    df = spark.createDataFrame([(1, x), (2, x + 1), (3, None)], "_id long, d decimal(38,2)")
    src = finding.Source(df)
    spelt = {"$value": {"type": "decimal128", "value": "1234567890123456789012345678901234"}}
    ids = lambda f: [r._id for r in finding.find(src, {"find": "t", "filter": {"d": f}}).collect()]
    assert ids({"$gt": spelt}) == [1, 2] and ids({"$in": [spelt]}) == [] and ids({"$lt": spelt}) == []
    made = pipeline.aggregate(src, {"aggregate": "t", "pipeline": [{"$project": {"v": {"$literal": spelt}}}]}).first().v
    assert made == Decimal(spelt["$value"]["value"])


def test_decimal_sums_round_to_34_digits(spark):
    from pyspark.sql import functions as F

    given = [Decimal("12345678901234567890123456789012345.5"), Decimal("0.5"), Decimal("-99999999999999999999999999999999999.7"), Decimal("1234567890123456789012345678901234565.0")]
    df = spark.createDataFrame([(x,) for x in given], "x decimal(38,1)")
    assert [r[0] for r in df.select(decimals.to_34_digits(F.col("x"), 1)).collect()] == [V.DECIMAL.plus(x) for x in given]


def test_value_operations_on_columns(spark):
    """Against the operations on single values."""
    values = [2**63 - 1, -(2**63), 2**53 + 1, 2**53, -5, 0, 1, 3]
    floats = [0.5, -0.0, 1.0, float(2**53), 2.5, float("nan"), float("inf"), 3.0, 0.1]
    rows = [(k, a, b, Decimal("0.10") if k % 2 else Decimal("3.00")) for k, (a, b) in enumerate((a, b) for a in values for b in floats)]
    df = spark.createDataFrame(rows, "k int, n long, x double, d decimal(10,2)")
    at = lambda c: (df[c], df.schema[c].dataType)
    for r in df.select("k", columns.equal(*at("n"), *at("x")).alias("nx"), columns.equal(*at("x"), *at("d")).alias("xd"), columns.equal(*at("d"), *at("n")).alias("dn")).collect():
        _, a, b, d = rows[r.k]
        n, x, d = V.Value("int64", a), V.literal(b), V.literal(d)
        assert (r.nx, r.xd, r.dn) == (V.equal(n, x), V.equal(x, d), V.equal(d, n)), rows[r.k]
    safe = df.where("n between -5 and 5")
    assert all(r[0] == r.n + r.x or r[0] != r[0] for r in safe.select(columns.add(*at("n"), *at("x")), "n", "x").collect())
    assert {r[0] for r in safe.select(columns.negate(*at("n"))).collect()} == {5, 0, -1, -3}
    for c in (columns.add(*at("n"), *at("n")), columns.negate(*at("n")), columns.add(*at("n"), *at("x"))):
        with pytest.raises(Exception, match="TYPE_"):
            df.select(c).collect()
    code("TYPE_MISMATCH", columns.add, *at("x"), *at("d"))


def test_unwind_and_project_below_objects(spark):
    src = finding.Source(spark.createDataFrame([(1, ([5, 6], "p")), (2, ([], "q")), (3, (None, "r")), (4, None)], "_id long, o struct<a:array<long>,b:string>"))
    run = lambda *stages: [tuple(r) for r in pipeline.aggregate(src, {"aggregate": "t", "pipeline": list(stages)}).collect()]
    shown = {"$project": {"a": "$o.a", "b": "$o.b", "k": 1}}
    assert run({"$unwind": {"path": "$o.a", "includeArrayIndex": "k"}}, shown) == [(1, 0, 5, "p"), (1, 1, 6, "p")]
    assert run({"$unwind": {"path": "$o.a", "includeArrayIndex": "k", "preserveNullAndEmptyArrays": True}}, shown) == [(1, 0, 5, "p"), (1, 1, 6, "p"), (2, None, None, "q"), (3, None, None, "r"), (4, None, None, None)]
    assert run({"$project": {"o.b": 1, "o.n": {"$literal": 7}, "x.y": "$o.b", "x.z": "$gone"}})[:2] == [(1, ("p", 7), ("p",)), (2, ("q", 7), ("q",))]
    code("VAL_CONFLICTING_PATHS", run, {"$project": {"o": 1, "o.n": {"$literal": 7}}})


def test_float_sum_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.uniform(-1e12, 1e12) * 10 ** rng.randrange(-6, 6)) for k in range(5000)]
    df = spark.createDataFrame(rows, "_id long, g string, v double")
    spec = {"aggregate": "t", "pipeline": [{"$group": {"_id": "$g", "s": {"$sum": "$v"}}}]}
    a, b = ([(r._id, r.s) for r in pipeline.aggregate(finding.Source(df.repartition(n)), spec).collect()] for n in (1, 7))
    assert a == b
    for g, s in a:
        xs = [v for _, h, v in rows if h == g]
        chunks = []
        for k in range(0, len(xs), pipeline.CHUNK):
            chunks.append(V._left_sum(xs[k : k + pipeline.CHUNK]))
        while len(chunks) > 1:
            chunks = [sum(chunks[k : k + 2]) for k in range(0, len(chunks), 2)]
        assert s == chunks[0]


def test_updates(spark, source, data):
    from pyspark.sql import functions as F

    spec = {"$set": {"s": "new", "o.c": 5}, "$inc": {"_x": 2}, "$push": {"tags": {"$each": [7, 8], "$position": 1}}, "$unset": {"o.b": True}}
    out = {r._id: r for r in updates.post_image(source.df, spec, F.col("_id") < 30).collect()}
    for d in data:
        r = out[d[0]]
        if d[0] < 30:
            assert r.s == "new" and r["_x"] == 2 and r.tags == (None if d[5] is None else d[5][:1] + [7, 8] + d[5][1:])
        else:
            assert r.s == d[4] and r.tags == d[5]
    for op, want in (({"$addToSet": {"tags": {"$each": [2, 9]}}}, lambda t: t + [x for x in (2, 9) if x not in t]), ({"$pop": {"tags": 1}}, lambda t: t[:-1]), ({"$pop": {"tags": -1}}, lambda t: t[1:]), ({"$pull": {"tags": 2}}, lambda t: [x for x in t if x != 2])):
        for r in updates.post_image(source.df, op, F.lit(True)).collect():
            t = data[r._id][5]
            assert r.tags == (None if t is None else want(t))
    for bad, expected in (({"$set": {"_id": 1}}, "VAL_PROTECTED_FIELD"), ({"$set": {"o": 1, "o.a": 2}}, "VAL_CONFLICTING_PATHS"), ({"$rename": {"a": "b"}}, "CAP_UNSUPPORTED_FEATURE"), ({"$foo": {"a": 1}}, "VAL_UNKNOWN_OPERATOR"), ({}, "VAL_INVALID_SHAPE")):
        code(expected, updates.validate, bad)
    code("TYPE_MISMATCH", updates.post_image, source.df, {"$inc": {"s": 1}}, F.lit(True))


def test_collection(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "_id long, s string"))
    rows = lambda: [tuple(r) for r in db.run({"find": "c"}).collect()]
    assert db.run({"insertOne": "c", "document": {"_id": 4, "s": "d"}}, "key")["insertedId"] == 4
    assert db.run({"insertOne": "c", "document": {"_id": 4, "s": "d"}}, "key")["insertedId"] == 4
    code("CON_IDEMPOTENCY_MISMATCH", db.run, {"insertOne": "c", "document": {"_id": 5}}, "key")
    code("UNQ_PRIMARY_DUPLICATE", db.run, {"insertMany": "c", "documents": [{"_id": 9}, {"_id": 1}]})
    assert db.run({"updateMany": "c", "filter": {"_id": {"$lt": 3}}, "update": {"$set": {"s": "a"}}}) == {"acknowledged": True, "matchedCount": 2, "modifiedCount": 1, "upsertedCount": 0}
    assert db.run({"updateOne": "c", "filter": {"s": "a"}, "sort": {"_id": -1}, "update": {"$set": {"s": "z"}}})["modifiedCount"] == 1
    assert rows() == [(1, "a"), (2, "z"), (3, None), (4, "d")]
    assert db.run({"replaceOne": "c", "filter": {"_id": 3}, "replacement": {"s": "r"}})["modifiedCount"] == 1
    assert db.run({"deleteOne": "c", "filter": {"s": {"$ne": "a"}}})["deletedCount"] == 1
    assert rows() == [(1, "a"), (3, "r"), (4, "d")]
    assert db.run({"updateOne": "c", "filter": {"_id": 8}, "update": {"$setOnInsert": {"s": "u"}}, "upsert": True})["upsertedId"] == 8
    code("UNQ_SECONDARY_DUPLICATE", lambda: (db.run({"createIndex": "c", "keys": {"s": 1}, "unique": True}), db.run({"insertOne": "c", "document": {"_id": 10, "s": "a"}})))
    assert [len(b) for b in db.cursor({"find": "c"}, 3)] == [3, 1]
    with pytest.raises(EngineError):
        db._commit("c", db.source("c").df, base=db.version("c") - 1)
    code("VAL_RESOURCE_NOT_FOUND", db.run, {"find": "nothing"})
    code("VAL_UNKNOWN_COMMAND", db.run, {"drop": "c"})
    assert db.run({"explain": {"find": "c", "filter": {"s": "a"}}})["reasons"][0] == "FILTER_PUSHED"
    assert uuid7(1) < uuid7(2)


def files(path):
    return sum(1 for _ in path.rglob("*.parquet"))


def test_writes_are_deltas(spark, tmp_path):
    """A command adds parts in proportion to what it changes; another session finds the same rows, keyed results and older versions."""
    db = Database(spark)
    df = spark.range(1000).selectExpr("id AS _id", "concat('s', id % 7) AS s", "struct(id AS a) AS o").repartition(4)
    db.create("c", str(tmp_path / "c"), df)
    before = {p: p.stat().st_size for p in (tmp_path / "c").rglob("*.parquet")}
    db.run({"insertOne": "c", "document": {"_id": 5000, "s": "new"}}, "once")
    db.run({"updateMany": "c", "filter": {"s": "s3"}, "update": {"$set": {"s": "s4", "o.b": 1, "extra": 2}}})
    db.run({"deleteMany": "c", "filter": {"_id": {"$lt": 10}}})
    assert all(p.exists() and p.stat().st_size == n for p, n in before.items())
    other = Database(spark)
    assert other.open("c", str(tmp_path / "c")) == 4
    rows = other.run({"find": "c"}).collect()
    want = [k for k in range(10, 1000)] + [5000]
    assert [r._id for r in rows] == want and rows == db.run({"find": "c"}).collect()
    assert {(r.s, r.o and r.o.b, r.extra) for r in rows if r._id % 7 == 3 and r._id < 5000} == {("s4", 1, 2)} and {r.extra for r in rows if r._id % 7 != 3} == {None}
    assert other.run({"insertOne": "c", "document": {"_id": 5000, "s": "new"}}, "once")["insertedId"] == 5000
    code("CON_IDEMPOTENCY_MISMATCH", other.run, {"insertOne": "c", "document": {"_id": 5001}}, "once")
    old = Database(spark)
    old.open("c", str(tmp_path / "c"), 1)
    assert old.run({"count": "c"}).first().n == 1000
    code("CON_WRITE_CONFLICT", old.run, {"insertOne": "c", "document": {"_id": 7777}})
    for k in range(20):  # parts are merged now and then
        other.run({"insertOne": "c", "document": {"_id": 6000 + k}})
    assert len(other.manifests["c"].parts) < 16 and [r._id for r in other.run({"find": "c", "filter": {"_id": {"$gte": 5000}}}).collect()] == [5000, *range(6000, 6020)]
    code("VAL_RESOURCE_NOT_FOUND", other.open, "d", str(tmp_path / "none"))


def test_update_of_its_own_filter_field(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "_id long, s string"))
    assert db.run({"updateMany": "c", "filter": {"s": "a"}, "update": {"$set": {"s": "b"}}}) == {"acknowledged": True, "matchedCount": 2, "modifiedCount": 2, "upsertedCount": 0}
    assert [tuple(r) for r in db.run({"find": "c"}).collect()] == [(1, "b"), (2, "b"), (3, None)]
    assert db.run({"updateMany": "c", "filter": {}, "update": {"$set": {"s": 5}}})["modifiedCount"] == 3  # another type: all rows are written anew
    assert [tuple(r) for r in db.run({"find": "c"}).collect()] == [(1, 5), (2, 5), (3, 5)]


def test_pages_resume_in_another_session(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.range(25).selectExpr("id AS _id", "id % 3 AS g"))
    command = {"find": "c", "sort": {"g": -1}, "skip": 2, "limit": 17}
    whole = [r._id for r in db.run(command).collect()]
    rows, token = db.page(command, 5)
    got = [r._id for r in rows]
    db.run({"deleteMany": "c", "filter": {"g": 1}})
    other = Database(spark)
    other.open("c", str(tmp_path / "c"))
    while token:
        rows, token = other.page(command, 5, token)
        got += [r._id for r in rows]
    assert got == whole
    code("VAL_INVALID_SHAPE", db.page, {"find": "c"}, 5, {"command": "x", "version": 1, "position": 0})


def test_missing_is_not_null(spark, tmp_path):
    """What an update unsets or hasn't made, and what an insert leaves out, is missing; what it sets to null is there."""
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.createDataFrame([(1, "a", (1, "p"), [1]), (2, None, (None, "q"), []), (3, "c", None, None)], "_id long, s string, o struct<a:long,b:string>, t array<long>"))
    ids = lambda f: [r._id for r in db.run({"find": "c", "filter": f}).collect()]
    run = lambda f, u: db.run({"updateMany": "c", "filter": f, "update": u})
    assert run({"_id": 1}, {"$unset": {"s": True, "o.a": True, "gone": True}})["modifiedCount"] == 1
    assert run({"_id": 1}, {"$unset": {"s": True}})["modifiedCount"] == 0
    assert ids({"s": {"$exists": False}}) == [1] and ids({"s": None}) == [2] and ids({"s": {"$ne": None}}) == [1, 3] and ids({"s": {"$type": "null"}}) == [2]
    assert ids({"o.a": {"$exists": True}}) == [2] and ids({"o.b": {"$exists": True}}) == [1, 2]
    assert run({"_id": 1}, {"$set": {"s": None}})["modifiedCount"] == 1 and ids({"s": None}) == [1, 2]
    run({"_id": 2}, {"$inc": {"n": 5}})
    run({}, {"$inc": {"n": 2}})
    assert [(r._id, r.n) for r in db.run({"find": "c"}).collect()] == [(1, 2), (2, 7), (3, 2)]
    run({"_id": 1}, {"$unset": {"t": True}})
    run({"_id": {"$lt": 3}}, {"$push": {"t": 9}})
    assert [r.t for r in db.run({"find": "c"}).collect()] == [[9], [9], None]
    run({"_id": 3}, {"$set": {"o.a": 7, "x.y.z": True}})
    assert ids({"o.a": 7}) == [3] and ids({"o.b": {"$exists": False}}) == [3] and ids({"x.y": {"$exists": True}}) == [3] and ids({"x": {"$exists": False}}) == [1, 2]
    db.run({"insertOne": "c", "document": {"_id": 4, "o": {"b": "r"}, "n": None}})
    assert ids({"s": {"$exists": False}}) == [4] and ids({"o.a": {"$exists": False}}) == [1, 4] and ids({"n": None}) == [4] and ids({"x": {"$exists": False}}) == [1, 2, 4]
    db.run({"replaceOne": "c", "filter": {"_id": 2}, "replacement": {"s": "only"}})
    assert ids({"o": {"$exists": False}}) == [2] and ids({"n": {"$exists": False}}) == [2] and ids({"t": {"$exists": True}}) == [1, 3]
    db.run({"updateOne": "c", "filter": {"_id": 9}, "update": {"$set": {"s": "up"}}, "upsert": True})
    assert ids({"s": "up", "o": {"$exists": False}, "t": {"$exists": False}}) == [9]
    other = Database(spark)
    other.open("c", str(tmp_path / "c"))
    count = lambda *stages: other.run({"aggregate": "c", "pipeline": list(stages)}).collect()
    assert [tuple(r) for r in count({"$group": {"_id": {"$type": "$s"}, "n": {"$count": {}}}})] == [("missing", 1), ("null", 1), ("string", 3)]
    assert [r._id for r in count({"$project": {"o": 1}}, {"$match": {"o.a": {"$exists": False}}})] == [1, 2, 4, 9]
    assert [r._id for r in other.run({"find": "c", "sort": {"s": 1}}).collect()][:2] == [4, 1] and "__seen" not in other.run({"find": "c"}).columns
    assert ids({"$jsonSchema": {"required": ["s", "n"], "properties": {"o": {"required": ["b"]}}}}) == [1]
    other.export("c", str(tmp_path / "out"))
    from lodestone.functions import tagged

    docs = [tagged.loads(r.value).value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {d["_id"].value: sorted(set(d) - {"_id"}) for d in docs} == {1: ["n", "o", "s", "t"], 2: ["s"], 3: ["n", "o", "s", "t", "x"], 4: ["n", "o"], 9: ["s"]}


def test_backups(spark, tmp_path):
    """A whole copy and two increments, the second after a merge, restored into a new folder; versions stay open by number."""
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.range(50).selectExpr("id AS _id", "id % 3 AS g"))
    at = db.backup("c", str(tmp_path / "full"))
    db.run({"deleteMany": "c", "filter": {"g": 1}})
    db.run({"insertOne": "c", "document": {"_id": 100, "g": 9}})
    one = db.backup("c", str(tmp_path / "one"), at)
    first = [tuple(r) for r in db.run({"find": "c"}).collect()]
    for k in range(18):
        db.run({"updateOne": "c", "filter": {"_id": 100}, "update": {"$set": {"g": k}}})
    db.backup("c", str(tmp_path / "two"), one)
    other = Database(spark)
    other.restore("r", str(tmp_path / "r1"), str(tmp_path / "full"), str(tmp_path / "one"))
    assert [tuple(r) for r in other.run({"find": "r"}).collect()] == first
    other.restore("s", str(tmp_path / "r2"), str(tmp_path / "full"), str(tmp_path / "one"), str(tmp_path / "two"))
    assert other.run({"find": "s"}).collect() == db.run({"find": "c"}).collect() and db.manifests["c"].base > one
    assert other.run({"insertOne": "s", "document": {"_id": 101, "g": 1}})["insertedCount"] == 1
    code("DUR_BACKUP_INVALID", db.backup, "c", str(tmp_path / "two"))
    code("DUR_RESTORE_INVALID", other.restore, "t", str(tmp_path / "r3"), str(tmp_path / "two"))
    other.open("old", str(tmp_path / "c"), 1)
    assert other.run({"count": "old"}).first().n == 50


def test_inputs_can_be_repeated(spark, tmp_path):
    from lodestone.inputs import Inputs

    clock = lambda: dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    ids = []
    for k in range(2):
        db = Database(spark, inputs=Inputs(clock, b"seed"))
        db.create("c", str(tmp_path / f"c{k}"), spark.createDataFrame([], "_id string, t timestamp_ntz"), ttl="t")
        ids.append(list(db.run({"insertMany": "c", "documents": [{"t": dt.datetime(2023, 1, 1)}, {}]})["insertedIds"].values()))
        assert db.run({"count": "c"}).first().n == 1  # one has expired by the clock that was given
    assert ids[0] == ids[1] and len(set(ids[0])) == 2
    assert [p for _, p in db.inputs.taken] == ["expiry cutoff", "document id", "document id", "document id", "document id", "expiry cutoff"]
    assert Inputs().random(4, "x") != Inputs().random(4, "x") and uuid7(1) < uuid7(2)


def test_index_order_survives_merges(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.range(2000).selectExpr("id AS _id", "pmod(hash(id), 1000) AS g").repartition(4))
    db.run({"createIndex": "c", "keys": {"g": 1}})
    for k in range(18):
        db.run({"insertOne": "c", "document": {"_id": 5000 + k, "g": k}})
    import pyarrow.parquet as pq

    (part,) = [p for p, at in db.manifests["c"].parts if at == db.manifests["c"].base]
    bounds = sorted((f.row_group(0).column(1).statistics.min, f.row_group(0).column(1).statistics.max) for f in (pq.ParquetFile(x).metadata for x in __import__("glob").glob(part + "/*.parquet")))
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_ttl_in_writes(spark, tmp_path):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a"), (2, dt.datetime(2024, 1, 3), "a"), (3, None, "a")], "_id long, t timestamp_ntz, s string")
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), df, ttl="t", now=now)
    assert db.run({"updateMany": "c", "filter": {"s": "a"}, "update": {"$set": {"s": "b"}}})["matchedCount"] == 2
    assert db.run({"deleteMany": "c", "filter": {}})["deletedCount"] == 2
    assert [(r._id, r.s) for r in db.source("c").df.collect()] == [(1, "a")]


def test_ttl(spark):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2)), (3, dt.datetime(2024, 1, 3)), (4, None)], "_id long, t timestamp_ntz")
    src = finding.Source(df, ttl="t", now=now)
    assert [r._id for r in finding.find(src, {"find": "c"}).collect()] == [3, 4]
    state = lambda s: [r._id for r in df.where(compile_filter({"$ttl": s}, src.context())).orderBy("_id").collect()]
    assert (state("active"), state("expired"), state("unbounded")) == ([3], [1, 2], [4])


NUMBERS = [V.literal(x) for x in (-(2**63), -1, 0, 1, 2**53, 2**53 + 1, 2**63 - 1, -0.0, 0.5, 0.1, 1e300, 5e-324, -1e-9, float("inf"), float("-inf"), float("nan"))] + [V.Value("decimal128", Decimal(s)) for s in ("0.1", "1.10", "1e6144", "-1e-6176", "NaN", "Infinity")]


def test_order_of_numbers():
    def slow(a, b):
        x, y = V.exact(a), V.exact(b)
        nan = (x != x, y != y)
        return (nan[0] > nan[1]) - (nan[0] < nan[1]) if any(nan) else (x > y) - (x < y)

    assert all(V.compare(a, b) == slow(a, b) for a in NUMBERS for b in NUMBERS)


def test_order_of_types_and_containers():
    ladder = [V.MISSING, None, False, True, float("-inf"), -3, 0, 0.1, 5, float("nan"), "", "a", "a\0", "aa", "é", {}, {"a": 1}, {"a": 1, "b": 0}, {"a": 2}, [], [None], [0], [0, 0], [1], dt.datetime(1969, 1, 1), dt.datetime(2024, 1, 1), dt.date(2024, 1, 1)]
    vals = [x if isinstance(x, V.Value) else V.literal(x) for x in ladder]
    keys = [V.order_key(v) for v in vals]
    order = sorted(range(len(vals)), key=lambda k: keys[k])
    assert order == list(range(len(vals)))
    assert V.equal(V.literal({"a": 1, "b": 2}), V.literal({"b": 2.0, "a": 1})) and not V.identical(V.literal({"a": 1, "b": 2}), V.literal({"b": 2, "a": 1}))
    assert V.equal(V.literal(0.0), V.literal(-0.0)) and not V.identical(V.literal(0.0), V.literal(-0.0))


def test_arithmetic():
    assert V.add(V.literal(2**31 - 1), V.literal(1)) == V.Value("int64", 2**31)
    code("TYPE_NUMERIC_OVERFLOW", V.add, V.Value("int64", 2**63 - 1), V.literal(1))
    code("TYPE_COERCION_LOSS", V.add, V.literal(2**53 + 1), V.literal(0.5))
    code("TYPE_MISMATCH", V.add, V.literal(0.5), V.literal(Decimal("1")))
    assert V.add(V.literal(Decimal("0.1")), V.literal(2)).value == Decimal("2.1")
    assert V.negate(V.Value("int32", -(2**31))) == V.Value("int64", 2**31)
    code("TYPE_NUMERIC_OVERFLOW", V.negate, V.Value("int64", -(2**63)))


@pytest.mark.parametrize("text, want", [("1970-01-01T00:00:00Z", 0), ("2024-02-29T12:00:00.5+02:00", 1709200800500000), ("1969-12-31T23:59:59.999999Z", -1)])
def test_timestamps(text, want):
    assert V.parse_timestamp(text).value == want


@pytest.mark.parametrize("text", ["2024-01-01", "2024-01-01T00:00:00", "2024-01-01T00:00:00-00:00", "2024-01-01T00:00:60Z", "2024-01-01T00:00:00.1234567Z", "2024-02-30T00:00:00Z", "2024-01-01T00:00:00+14:01", "2024-01-01T00:00:00 Europe/Paris"])
def test_bad_timestamps(text):
    code("VAL_INVALID_LITERAL", V.parse_timestamp, text)


def test_json_and_limits():
    assert jsonio.parse('{"a": 1, "b": 1.0}') == {"a": 1, "b": 1.0} and isinstance(jsonio.parse("1.0"), float)
    for raw, expected in ((b'{"a": 1, "a": 2}', "VAL_DUPLICATE_FIELD"), (b"\xff", "PAR_INVALID_UTF8"), (b"{", "PAR_TRUNCATED_INPUT"), (b"[1,]", "PAR_INVALID_JSON"), (b"NaN", "PAR_INVALID_JSON"), (b"\xef\xbb\xbf{}", "PAR_INVALID_JSON"), (b"9223372036854775808", "VAL_INVALID_LITERAL")):
        code(expected, jsonio.parse, raw)
    code("PAR_COMPRESSION_FAILED", jsonio.parse, b"x", "gzip")
    deep = "[" * 64 + "]" * 64
    assert jsonio.parse(deep)
    code("QUOTA_LIMIT_EXCEEDED", jsonio.parse, "[" + deep + "]")
    limits.check("sort.keys", 64)
    code("QUOTA_LIMIT_EXCEEDED", limits.check, "sort.keys", 65)
    assert paths.parse("a.0.b") == ["a", "0", "b"]
    code("QUOTA_LIMIT_EXCEEDED", paths.parse, ".".join("a" * 101))


def test_regex_end(spark):
    df = spark.createDataFrame([("a\n",), ("a",), ("b\na",)], "s string")
    assert [r.s for r in df.where(df.s.rlike(regex.java_pattern("a$"))).collect()] == ["a", "b\na"]
    assert len(df.where(df.s.rlike(regex.java_pattern({"pattern": "^a$", "flags": "m"}))).collect()) == 3


def test_vectors():
    a, b = V.vector((3.0, 4.0)), V.vector((0.0, 1.0))
    assert V.distance(a, b, "l2") == 18**0.5 and V.distance(a, b, "dot") == 4 and abs(V.distance(a, b, "cosine") - 0.2) < 1e-15
    code("TYPE_VECTOR_ZERO_NORM", V.distance, a, V.vector((0.0, 0.0)), "cosine")
    code("TYPE_VECTOR_DIMENSION", V.distance, a, V.vector((1.0,)), "l2")
    code("TYPE_INVALID_SPECIAL", V.vector, (float("nan"),))
