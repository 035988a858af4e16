"""Typed JSON documents, sidecars, the path dictionary and the change log."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import dictionary, tagged
from lodestone.functions import values as V
from lodestone.sources.collections import Database
from lodestone.streaming import changes


def test_round_trip():
    v = V.Value("object", {"_id": V.literal(1), "z": V.Value("float64", -0.0), "a": V.Value("int64", 5), "d": V.Value("decimal128", Decimal("1.10")), "b": V.Value("binary", (3, b"\0\xff")), "t": V.Value("timestamp", -1), "day": V.Value("date", 7), "u": V.Value("uuid", bytes(16)), "o": V.Value("objectId", bytes(12)), "v": V.vector((0.5, -1.0), "f16"), "arr": V.literal([None, {"x": "é\n"}, True])})
    assert V.identical(tagged.loads(tagged.dumps(v)), v)


@pytest.mark.parametrize("text, code", [("{", "PAR_INVALID_JSON"), ('{"type":"int32","value":"1"}', "VAL_INVALID_SHAPE"), ('{"type":"object","fields":[]}', "VAL_INVALID_SHAPE"), ('{"type":"object","fields":[{"name":"_id","value":{"type":"null"}}]}', "TYPE_MISMATCH"), ('{"type":"object","fields":[{"name":"_id","value":{"type":"int32","value":"1"}},{"name":"_id","value":{"type":"int32","value":"2"}}]}', "VAL_DUPLICATE_FIELD"), ('{"type":"x","type":"y"}', "VAL_DUPLICATE_FIELD")])
def test_strict(text, code):
    with pytest.raises(EngineError) as e:
        tagged.loads(text)
    assert e.value.code == code


def test_export_import_and_sidecars(spark):
    rows = [(2, 'say "hi"\\', 1.5, dt.datetime(2024, 1, 1), [1, None], ("p", None)), (1, None, float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, x double, t timestamp_ntz, a array<int>, o struct<b:string,c:int>")
    docs = tagged.import_documents(tagged.export_documents(df, "k"))
    got = docs.orderBy("key").collect()
    assert [r.error for r in got] == [None, None]
    first, second = (tagged.loads(r.doc) for r in got)
    assert first.value["_id"].value == 1 and first.value["s"] == V.NULL and V.is_nan(first.value["x"])
    assert second.value["s"].value == rows[0][1] and second.value["a"] == V.literal([1, None]) and list(second.value["o"].value) == ["b", "c"]
    side = tagged.with_sidecar(tagged.with_sidecar(docs, "o.b", "string"), "gone.x", "int64")
    assert [(r.o_b__st, r.o_b__v, r.gone_x__st) for r in side.orderBy("key").collect()] == [(tagged.MISSING, None, tagged.MISSING), (tagged.TYPED, "p", tagged.MISSING)]
    assert tagged.import_documents(spark.createDataFrame([("x",), (None,)], "doc string")).where(F.col("error") == "PAR_INVALID_JSON").count() == 2


def test_dictionary(spark):
    base = dictionary.Snapshot()
    schema = spark.createDataFrame([], "_id int, o struct<a:int,b:array<struct<c:int>>>").schema
    nxt = base.register(dictionary.schema_paths(schema))
    assert nxt.paths == ("_id", "o", "o.a", "o.b", "o.b.c") and nxt.follows(base) and nxt.id("o.b") == 4 and nxt.path(1) == "_id"
    assert dictionary.Snapshot.decode(nxt.encode()) == nxt and nxt.register(["o.a"]) is nxt
    registry = dictionary.Registry()
    registry.publish(base, nxt)
    for call in (lambda: registry.publish(base, nxt), lambda: dictionary.Snapshot.decode(b"[]")):
        with pytest.raises(EngineError):
            call()


def test_change_log(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.createDataFrame([(1, "a"), (2, "b")], "_id long, s string"))
    feed = spark.createDataFrame([(1, "upsert", 1, "x"), (2, "delete", 1, None), (3, "upsert", 1, "n"), (1, "upsert", 2, "y")], "_id long, op string, seq long, s string")
    feed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    query = changes.follow(db, "c", stream, str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in db.run({"find": "c"}).collect()] == [(1, "y"), (3, "n")]


def test_late_changes_lose(spark, tmp_path):
    """Batches in any order, and twice, give what the highest seq of each id says, deletes included."""
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.createDataFrame([(1, "a"), (2, "b")], "_id long, s string"))
    batch = lambda *rows: changes.apply_batch(db, "c", spark.createDataFrame(list(rows), "_id long, op string, seq long, s string"))
    batch((1, "upsert", 5, "new"), (2, "delete", 5, None))
    at = batch((1, "upsert", 3, "old"), (2, "upsert", 4, "back"), (3, "upsert", 1, "c"))
    assert batch((1, "upsert", 5, "new"), (3, "upsert", 1, "c")) == at
    assert [tuple(r) for r in db.run({"find": "c"}).collect()] == [(1, "new"), (3, "c")]
    other = Database(spark)
    other.open("c", str(tmp_path / "c"))
    changes.apply_batch(other, "c", spark.createDataFrame([(2, "upsert", 4, "late"), (2, "upsert", 6, "now")], "_id long, op string, seq long, s string"))
    assert [tuple(r) for r in other.run({"find": "c"}).collect()] == [(1, "new"), (2, "now"), (3, "c")]


def test_digests():
    """Published values of both algorithms."""
    from lodestone.functions.digests import blake3, crc32c

    assert crc32c([b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), b""]) == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0]
    counted = lambda n: bytes(k % 251 for k in range(n))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}
    assert [x.hex() for x in blake3([counted(n) for n in want])] == list(want.values())
    sizes = [3, 64, 65, 1023, 2048, 2049, 5000, 9000]
    assert blake3([counted(n) for n in sizes]) == [blake3([counted(n)])[0] for n in sizes]


def document(**more):
    base = {"_id": V.Value("uuid", bytes(16)), "z": V.literal([1, 2.5, None, {"b": 1, "a": [[], {}]}]), "s": V.literal("é"), "d": V.Value("decimal128", Decimal("-1.2E+6100")), "e": V.Value("decimal128", Decimal("1E+6144"))}
    base |= {"bin": V.Value("binary", (0, b"\0\xff")), "t": V.Value("timestamp", -1), "day": V.Value("date", 7), "o": V.Value("objectId", bytes(12)), "v": V.vector((0.5, -1.0), "f16"), "w": V.vector((1.5,)), "n": V.NULL, "f": V.Value("float64", -0.0), "i": V.Value("int64", 5), "yes": V.literal(True)}
    return V.Value("object", base | more)


def test_binary_form():
    """Round trips, the published checksums and hashes of a small document, and order that hashes don't see."""
    from lodestone.functions import binary

    v = document()
    assert V.identical(binary.decode(binary.encode(v)), v)
    shared = V.literal({"x": 1})
    assert V.identical(binary.decode(binary.encode(document(p=shared, q=shared))), document(p=shared, q=shared))
    small = {"s": V.literal(""), "_id": V.Value("uuid", bytes(16)), "n": V.NULL}
    a, b = (binary.encode(V.Value("object", {k: small[k] for k in order})) for order in (("s", "_id", "n"), ("_id", "n", "s")))
    assert len(a) == len(b) == 408 and (a[32:36].hex(), b[32:36].hex()) == ("126c66f2", "9798205f")
    hashed = [binary.negotiate(x).content_hash.hex() for x in (a, b)]
    assert hashed[0] == hashed[1] == "b3c73f825bbc1f2fecd295a9ee93bff822dae8ba50f9209e5b85fd31b928ba74"
    words = {"1": "01000000000000000000000000004030", "0": "00000000000000000000000000004030", "-0": "000000000000000000000000000040b0", "NaN": "0000000000000000000000000000007c", "1E+6144": "000000000a5bc138938d44c64d31fe5f"}
    assert all(binary.payload(V.Value("decimal128", Decimal(x))).hex() == raw for x, raw in words.items())
    assert binary.assess_migration(a).storage == "plain"
    with pytest.raises(EngineError, match="CAP_UNSUPPORTED_VERSION"):
        binary.assess_migration(a, (1, 1))


def test_binary_form_refuses_damage():
    """Any changed byte, with the checksum left or mended, any cut, and what isn't canonical."""
    from lodestone.functions import binary
    from lodestone.functions.digests import crc32c

    good = binary.encode(document())

    def outcome(data):
        (found,) = binary.decode_many([data])
        return found.code if isinstance(found, EngineError) else "accepted"

    mend = lambda d: d[:32] + crc32c([d[:32] + bytes(4) + d[36:]])[0].to_bytes(4, "little") + d[36:]
    broken = [good[:k] + bytes([good[k] ^ 1 << k % 8]) + good[k + 1 :] for k in range(len(good))]
    assert {outcome(d) for d in broken} <= {"DUR_CORRUPTION", "CAP_FORMAT_UNSUPPORTED", "CAP_UNSUPPORTED_VERSION"}
    mended = [outcome(mend(d)) for k, d in enumerate(broken) if not 32 <= k < 36]
    assert set(mended) <= {"DUR_CORRUPTION", "CAP_FORMAT_UNSUPPORTED", "CAP_UNSUPPORTED_VERSION"}
    assert {outcome(good[:k]) for k in range(0, len(good), 7)} <= {"DUR_CORRUPTION", "CAP_FORMAT_UNSUPPORTED"}
    assert outcome(good + b"\0") == "DUR_CORRUPTION" and outcome(None) == "CAP_FORMAT_UNSUPPORTED"


def test_compressed_binary_form():
    """A document with a compressed section, laid out by hand."""
    import struct

    import pyarrow as pa

    from lodestone.functions import binary
    from lodestone.functions.digests import crc32c

    plain = binary.encode(V.Value("object", {"_id": V.Value("uuid", bytes(16)), "pad": V.literal("A" * 40_000)}))
    directory = [struct.unpack_from(binary.ENTRY_FORM, plain, 64 + 32 * k) for k in range(4)]
    bodies = [plain[e[2] : e[2] + e[3]] for e in directory]
    codec, parts = pa.Codec("lz4_raw"), [bodies[2][k : k + 32768] for k in range(0, len(bodies[2]), 32768)]
    small = [codec.compress(p, asbytes=True) for p in parts]
    stream, at = struct.pack("<8sHHHBBIIII", binary.STREAM_MAGIC, 1, 32, 24, 15, 0, len(parts), len(bodies[2]), 32 + 24 * len(parts), 0), 32 + 24 * len(parts)
    for k, (p, c) in enumerate(zip(parts, small, strict=True)):
        stream += struct.pack("<IIIIHHI", k * 32768, len(p), at, len(c), 0, 0, 0)
        at += len(c)
    stored = [*bodies[:2], stream + b"".join(small), bodies[3]]
    cursor, entries, out = 192, b"", b""
    for k, (e, body) in enumerate(zip(directory, stored, strict=True)):
        begin = -(-cursor // 8) * 8
        out += bytes(begin - cursor) + body
        entries += struct.pack(binary.ENTRY_FORM, e[0], e[1] | (k == 2), begin, len(body), e[4], e[5], int(k == 2), int(k == 2), 1, 0, 0)
        cursor = begin + len(body)
    foot = -(-cursor // 8) * 8
    head = list(struct.unpack_from(binary.HEADER_FORM, plain))
    head[5], head[6], head[9], head[13], head[14] = 1, foot + 64, 0, foot, 1
    end = list(struct.unpack_from(binary.FOOTER_FORM, plain, len(plain) - 64))
    end[6] = foot + 64
    packed = struct.pack(binary.HEADER_FORM, *head) + entries + out + bytes(foot - cursor) + struct.pack(binary.FOOTER_FORM, *end)
    packed = packed[:32] + struct.pack("<I", crc32c([packed])[0]) + packed[36:]
    assert V.identical(binary.decode(packed), binary.decode(plain)) and binary.negotiate(packed).storage == "compressed" and len(packed) < len(plain) // 10
    with pytest.raises(EngineError, match="DUR_CORRUPTION"):
        binary.decode(packed[:400] + b"\x55" + packed[401:])


def test_binary_columns(spark):
    from lodestone.functions import binary

    rows = [(tagged.dumps(document(k=V.literal(k))),) for k in range(20)] + [("{",), (None,)]
    data = binary.to_binary(spark.createDataFrame(rows, "doc string"))
    back = binary.from_binary(data)
    assert sorted(r.doc for r in back.collect() if r.doc) == sorted(r[0] for r in rows[:20])
    assert sorted(str(r.error) for r in data.collect())[-2:] == ["PAR_INVALID_JSON", "PAR_INVALID_JSON"] or [r.error for r in data.collect()].count("PAR_INVALID_JSON") == 2
    assert [r.error for r in back.collect()].count("CAP_FORMAT_UNSUPPORTED") == 2


def test_path_registry(spark, tmp_path):
    from lodestone.sources.registry import PathRegistry

    one, two = (PathRegistry(spark, str(tmp_path)) for _ in range(2))
    assert one.register(["a", "a.b", "_id"]) == {"a": 2, "a.b": 3, "_id": 1} and one.register(["a"]) == {"a": 2}
    with pytest.raises(EngineError, match="CON_WRITE_CONFLICT"):
        two.register(["c"])
    pinned = two.recover()
    assert two.register(["c"]) == {"c": 4} and pinned.id("c") is None and two.pin(1) == pinned and one.recover() == two.current
    (tmp_path / "paths" / "00000003").write_text('{"version":3,"paths":["_id","b"]}')
    with pytest.raises(EngineError, match="DUR_CORRUPTION"):
        one.recover()


def test_cache(spark):
    now = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC)]
    db = Database(spark)
    db.cache.clock = lambda: now[0]
    assert db.run({"cacheSet": "k", "value": {"a": [1]}, "ttlSeconds": 10}) == {"acknowledged": True}
    assert db.run({"cacheGet": "k"}) == {"found": True, "value": V.literal({"a": [1]})}
    assert db.run({"cacheIncr": "n", "by": 2, "ttlSeconds": 5})["value"] == V.literal(2) and db.run({"cacheIncr": "n"})["value"] == V.literal(3)
    now[0] += dt.timedelta(seconds=5)
    assert db.run({"cacheGet": "n"}) == {"found": False} and db.run({"cacheGet": "k"})["found"]
    now[0] += dt.timedelta(seconds=5)
    assert not db.run({"cacheGet": "k"})["found"]
    for bad, code in (({"cacheSet": "k"}, "VAL_INVALID_SHAPE"), ({"cacheGet": "k", "x": 1}, "VAL_UNKNOWN_OPTION"), ({"cacheIncr": "k", "by": "a"}, "TYPE_MISMATCH"), ({"cacheSet": "k", "value": 1, "ttlSeconds": 0}, "VAL_INVALID_SHAPE")):
        with pytest.raises(EngineError, match=code):
            db.run(bad)


def test_collation(spark):
    db = Database(spark)
    db.register("c", spark.createDataFrame([(1, "b"), (2, "É"), (3, "a")], "_id long, s string"))
    assert [r._id for r in db.run({"find": "c", "sort": {"s": 1}, "collation": "binary_utf8_v1"}).collect()] == [3, 1, 2]
    with pytest.raises(EngineError, match="CAP_UNSUPPORTED_FEATURE"):
        db.run({"find": "c", "collation": {"locale": "fr"}})


def test_operations():
    from lodestone.functions import operations as O

    doc = V.literal({"a": [{"b": 1}, {"b": 2}, 5, [{"b": 9}]], "n": None})
    path = V.literal
    assert O.run("path.resolve", doc, path("a.b"), fanout=True) == V.literal([1, 2])
    assert O.run("path.resolve", doc, path("a.0.b")) == V.literal(1) and O.run("path.resolve", doc, path("z")) == V.MISSING
    assert O.run("path.exists", doc, path("n")) and not O.run("path.exists", doc, path("n.x"))
    assert O.run("array.all", V.literal([1, 2.0, None]), V.literal([2, None])) and O.run("array.size", V.literal([1])) == 1
    assert O.run("string.contains", V.literal("héllo"), V.literal("él")) and O.run("value.compare", V.literal(1), V.literal("a")) == -1
    assert O.run("vector.distance", V.vector((1.0, 0.0)), V.vector((0.0, 1.0)), metric="l2") == 2**0.5
    assert O.content_hash(V.literal({"a": 1, "b": {"c": 2, "d": 3}})) == O.content_hash(V.literal({"b": {"d": 3, "c": 2}, "a": 1})) != O.content_hash(V.literal({"a": 1.0, "b": {"c": 2, "d": 3}}))
    for args in (("path.resolve", doc, path("a.b")), ("nope",), ("array.size",), ("array.size", V.literal(1))):
        with pytest.raises(EngineError):
            O.run(*args)


def test_conversions(spark):
    from lodestone.functions import convert as C

    df = spark.createDataFrame([(1, 2.5, "2024-01-01T00:30:00+01:00"), (2**53 + 2, 3.5, "2024-01-01T00:00:00-00:00"), (None, None, None)], "n long, x double, t string")
    t = df.schema
    got = df.select(C.convert(df.n, t["n"].dataType, "float64").alias("f"), C.convert(df.x, t["x"].dataType, "int32", "round").alias("i"), C.parse_timestamp(df.t).cast("long").alias("t")).collect()
    assert [tuple(r) for r in got] == [(1.0, 2, 1704065400), (float(2**53 + 2), 4, None), (None, None, None)]
    for c, kind, to, mode in ((F.lit(2**53 + 1), "n", "float64", "exact"), (F.lit(2.5), "x", "int64", "exact"), (F.lit(1e30), "x", "int64", "round"), (F.lit(2**40), "n", "int32", "exact")):
        with pytest.raises(Exception, match="TYPE_"):
            df.select(C.convert(c, t[kind].dataType, to, mode)).collect()
    vectors = spark.createDataFrame([([0.1, 2.0],), (None,)], "v array<float>")
    assert vectors.select(C.to_f16("v").alias("h")).first().h == [pytest.approx(0.0999755859375), 2.0]


def test_cluster_and_export(spark, tmp_path):
    db = Database(spark)
    db.create("c", str(tmp_path / "c"), spark.range(100).selectExpr("id AS _id", "id % 7 AS g"))
    db.cluster("c", "g")
    assert db.version("c") == 2 and db.run({"count": "c", "filter": {"g": 3}}).first().n == 14
    db.export("c", str(tmp_path / "out"))
    docs = tagged.import_documents(spark.read.text(str(tmp_path / "out")).withColumnRenamed("value", "doc"))
    assert docs.where("error is null").count() == 100


def test_row_errors_become_engine_errors(spark):
    from lodestone.errors import CATEGORY, from_spark

    df = spark.range(1).select(F.raise_error(F.lit("TYPE_MISMATCH")).cast("long").alias("x"))
    with pytest.raises(Exception) as e:
        df.collect()
    assert from_spark(e.value).code == "TYPE_MISMATCH" and CATEGORY["DUR_IO"] == "durability"
    assert from_spark(ValueError("x")).args == ("x",)


def test_documents_are_dealt(spark, tmp_path):
    """A table that is read as one part is worked on by all cores, and names and hashes take time in proportion to a batch."""
    from lodestone import queries

    spark.range(0, 4000, 1, 1).selectExpr("id c_custkey", "concat('n', id) c_name", "1 c_nationkey", "id / 4D c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("binary_round_trip", "document_sidecar", "value_order_key"):
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert f"RoundRobinPartitioning({tagged.DEALT * spark.sparkContext.defaultParallelism})" in plan, name
    out = queries.queries()["binary_round_trip"](spark, str(tmp_path)).collect()
    assert sorted((r.c_custkey, r.c_name, r.c_acctbal, r.same) for r in out) == [(k, f"n{k}", k / 4, True) for k in range(4000)]
