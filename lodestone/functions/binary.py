"""The binary document form, version 1.0: a writer of its plain profile and a validating reader of both profiles.

A document is a header, a directory of four sections (fields, names, values,
containers), the sections, and a footer with a hash of the typed content.
Offsets inside sections count as if no section were compressed. The reader
rebuilds a document from its values and asks for the same bytes, so whatever
isn't canonical is corruption; only the choice of compressed blocks is taken
as it comes, as long as they decode to the exact lengths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..errors import EngineError, fail
from . import tagged
from . import values as V
from .digests import blake3, crc32c

#: Fixed values of the format.
MAGIC, END_MAGIC, STREAM_MAGIC = bytes.fromhex("48444f430d0a1a0a"), bytes.fromhex("48444f43454e440a"), bytes.fromhex("48434d500d0a1a0a")
HASH_DOMAIN = bytes.fromhex("48444f432d54595045442d434f4e54454e542d484153482d563100")
VERSION = (1, 0)
HEADER, ENTRY, FOOTER = 64, 32, 64
FIELD, NAME, ARRAY_ENTRY, CONTAINER = 24, 8, 12, 32
SECTIONS = (1, 2, 3, 4)
COMPRESSED, BASE_FLAGS, NO_PARENT = 0x0001, 0x0006, 0xFFFFFFFF
COMPRESSED_BIT = 1
BLOCK_BYTES = 32_768
LEAST_BYTES = 288
TAGS = {
    "null": 0x01, "bool": 0x02, "int32": 0x03, "int64": 0x04, "float64": 0x05, "decimal128": 0x06, "string": 0x07, "binary": 0x08,
    "object": 0x09, "array": 0x0A, "timestamp": 0x0B, "date": 0x0C, "uuid": 0x0D, "objectId": 0x0E, "vector_f32": 0x0F, "vector_f16": 0x10,
}
TYPES = {tag: name for name, tag in TAGS.items()}
ALIGNMENT = {"int32": 4, "int64": 8, "float64": 8, "decimal128": 8, "timestamp": 8, "date": 4, "vector_f32": 4, "vector_f16": 4}
#: Microseconds and days from the first instant of year 1 to the last of 9999.
TIMES, DAYS = (-62_135_596_800_000_000, 253_402_300_799_999_999), (-719_162, 2_932_896)
DECIMAL_SPECIALS = {"NaN": 0x7C << 120, "Infinity": 0x78 << 120, "-Infinity": 0xF8 << 120}
HEADER_FORM, ENTRY_FORM, FOOTER_FORM = "<8sHHHHIIIIIHHIIQQ", "<HHIIIIHHHHI", "<8sHHHHIIII32s"


def _align(x: int, to: int = 8) -> int:
    return -(-x // to) * to


def _corrupt(what: str):
    return fail("DUR_CORRUPTION", what)


# -- payloads --------------------------------------------------------------------


def _decimal_word(x: Decimal) -> int:
    if x.is_nan():
        return DECIMAL_SPECIALS["NaN"]
    if x.is_infinite():
        return DECIMAL_SPECIALS["Infinity" if x > 0 else "-Infinity"]
    sign, digits, exponent = x.as_tuple()
    coefficient = int("".join(map(str, digits)))
    if not coefficient:
        exponent = 0
    while coefficient and coefficient % 10 == 0:
        coefficient, exponent = coefficient // 10, exponent + 1
    if coefficient >= 10**34 or exponent < -6176 or coefficient and len(str(coefficient)) + exponent - 1 > 6144:
        fail("TYPE_NUMERIC_OVERFLOW", "a decimal beyond 34 digits or its exponents")
    over = max(0, exponent - 6111)  # the stored exponent ends there; the coefficient takes the rest
    return sign << 127 | (exponent - over + 6176) << 113 | coefficient * 10**over


def _decimal(word: int) -> Decimal:
    for name, special in DECIMAL_SPECIALS.items():
        if word == special:
            return Decimal(name)
    sign, exponent, coefficient = word >> 127, (word >> 113 & 0x3FFF) - 6176, word & (1 << 113) - 1
    if exponent > 6111 or coefficient >= 10**34:
        _corrupt("decimal")
    while coefficient and coefficient % 10 == 0:
        coefficient, exponent = coefficient // 10, exponent + 1
    out = Decimal((sign, tuple(map(int, str(coefficient))), exponent if coefficient else 0))
    return out if _decimal_word(out) == word else _corrupt("decimal cohort")


def payload(v: V.Value) -> bytes:
    """The bytes of a value that is no container."""
    x = v.value
    if v.type == "null":
        return b""
    if v.type == "bool":
        return bytes([x])
    if v.type in ("int32", "date"):
        if v.type == "date" and not DAYS[0] <= x <= DAYS[1]:
            fail("TYPE_TEMPORAL_RANGE")
        return struct.pack("<i", x)
    if v.type in ("int64", "timestamp"):
        if v.type == "timestamp" and not TIMES[0] <= x <= TIMES[1]:
            fail("TYPE_TEMPORAL_RANGE")
        return struct.pack("<q", x)
    if v.type == "float64":
        return struct.pack("<d", x)
    if v.type == "decimal128":
        return _decimal_word(x).to_bytes(16, "little")
    if v.type == "string":
        return x.encode()
    if v.type == "binary":
        if x[0]:
            fail("CAP_FORMAT_UNSUPPORTED", f"binary subtype {x[0]}")
        return bytes([x[0]]) + x[1]
    if v.type in ("uuid", "objectId"):
        return x
    if v.type.startswith("vector"):
        return struct.pack(f"<I{len(x)}{'f' if v.type.endswith('32') else 'e'}", len(x), *x)
    return fail("CAP_FORMAT_UNSUPPORTED", v.type)


def value(kind: str, raw: bytes) -> V.Value:
    """The value that a payload spells; anything but its one form is corruption."""
    sizes = {"null": 0, "bool": 1, "int32": 4, "int64": 8, "float64": 8, "decimal128": 16, "timestamp": 8, "date": 4, "uuid": 16, "objectId": 12}
    if kind in sizes and len(raw) != sizes[kind]:
        _corrupt(f"length of {kind}")
    if kind == "null":
        return V.NULL
    if kind == "bool":
        return V.Value(kind, raw == b"\1") if raw in (b"\0", b"\1") else _corrupt(kind)
    if kind in ("int32", "date", "int64", "timestamp"):
        n = int.from_bytes(raw, "little", signed=True)
        low, high = {"date": DAYS, "timestamp": TIMES}.get(kind, (n, n))
        return V.Value(kind, n) if low <= n <= high else _corrupt(kind)
    if kind == "float64":
        return V.Value(kind, struct.unpack("<d", raw)[0])
    if kind == "decimal128":
        return V.Value(kind, _decimal(int.from_bytes(raw, "little")))
    if kind == "string":
        try:
            return V.Value(kind, raw.decode())
        except UnicodeDecodeError:
            return _corrupt("UTF-8")
    if kind == "binary":
        return V.Value(kind, (0, raw[1:])) if raw[:1] == b"\0" else _corrupt("binary subtype")
    if kind in ("uuid", "objectId"):
        return V.Value(kind, raw)
    code, width = ("f", 4) if kind == "vector_f32" else ("e", 2)
    n = struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0
    if not 1 <= n <= limits.LIMITS["vector.dimension"] or len(raw) != 4 + n * width:
        _corrupt("vector")
    parts = struct.unpack_from(f"<{n}{code}", raw, 4)
    return V.Value(kind, parts) if all(abs(p) < float("inf") for p in parts) else _corrupt("vector element")


# -- typed content hash ----------------------------------------------------------


def _children(v: V.Value) -> list[V.Value]:
    return list(v.value.values()) if v.type == "object" else list(v.value) if v.type == "array" else []


def content_hashes(roots: list[V.Value]) -> list[bytes]:
    """A hash of each value's types and payloads that the order of objects' fields doesn't change. Nodes of all values are hashed
    together, by their height."""
    levels: list[list[V.Value]] = []
    height: dict[int, int] = {}
    stack = [(r, False) for r in roots]
    while stack:
        v, seen = stack.pop()
        if not seen:
            stack.append((v, True))
            stack += [(c, False) for c in _children(v)]
            continue
        h = 1 + max((height[id(c)] for c in _children(v)), default=-1)
        height[id(v)] = h
        while len(levels) <= h:
            levels.append([])
        levels[h].append(v)
    digest: dict[int, bytes] = {}

    def body(v: V.Value) -> bytes:
        if v.type == "object":
            named = sorted(((k.encode(), x) for k, x in v.value.items()), key=lambda i: i[0])
            return struct.pack("<I", len(named)) + b"".join(struct.pack("<I", len(k)) + k + digest[id(x)] for k, x in named)
        if v.type == "array":
            return struct.pack("<I", len(v.value)) + b"".join(struct.pack("<I", i) + digest[id(x)] for i, x in enumerate(v.value))
        return payload(v)

    for level in levels:
        bodies = [(TAGS[v.type], body(v)) for v in level]
        frames = [HASH_DOMAIN + struct.pack("<HBQ", 1, tag, len(b)) + b for tag, b in bodies]
        digest |= {id(v): d for v, d in zip(level, blake3(frames), strict=True)}
    return [digest[id(r)] for r in roots]


# -- writer ----------------------------------------------------------------------


def _containers(root: V.Value) -> tuple[list[tuple[V.Value, int, int, int]], list[list[str]], list[list[V.Value]]]:
    """(container, depth, parent, slot) in breadth-first order, and the names and members of each, objects' by name."""
    out, names, members = [(root, 1, NO_PARENT, NO_PARENT)], [], []
    for k, (v, depth, _, _) in enumerate(out):  # grows as it goes
        names.append(_sorted_names(v) if v.type == "object" else [])
        members.append([v.value[n] for n in names[k]] if v.type == "object" else list(v.value))
        for slot, x in enumerate(members[k]):
            if x.type in ("object", "array"):
                out.append((x, depth + 1, k, slot))
    return out, names, members


def _sorted_names(v: V.Value) -> list[str]:
    return sorted(v.value, key=str.encode)


def _sections(root: V.Value) -> tuple[list[bytes], list[int], int]:
    """(bodies, item counts, fields) of the four sections, with offsets as in the plain profile."""
    held, own, members = _containers(root)
    number = {(parent, slot): k for k, (_, _, parent, slot) in enumerate(held)}
    names = own[0] if len(held) == 1 else sorted({n for each in own for n in each}, key=str.encode)
    ids = {n: k for k, n in enumerate(names)}
    raw = [n.encode() for n in names]
    fields = sum(len(v.value) for v, *_ in held if v.type == "object")
    entries = sum(len(v.value) for v, *_ in held if v.type == "array")
    limits.check("document.total_fields", fields)
    start_fields = HEADER + len(SECTIONS) * ENTRY
    start_names = _align(start_fields + fields * FIELD)
    at = start_names + len(names) * NAME
    places = []
    for b in raw:
        places.append(at)
        at += len(b)
    start_values = _align(at)
    area, n_values, refs = bytearray(), 0, {}
    for k in range(len(held)):
        for slot, x in enumerate(members[k]):
            if x.type in ("object", "array"):
                continue
            cursor = start_values + len(area)
            area += bytes(_align(cursor, ALIGNMENT.get(x.type, 1)) - cursor)
            body = payload(x)
            refs[k, slot] = (start_values + len(area), len(body))
            area += body
            n_values += 1
    start_containers = _align(start_values + len(area))

    def reference(k: int, slot: int, x: V.Value) -> tuple[int, int]:
        return (start_containers + number[k, slot] * CONTAINER, CONTAINER) if x.type in ("object", "array") else refs[k, slot]

    recursive = [len(v.value) if v.type == "object" else 0 for v, *_ in held]
    for k in range(len(held) - 1, 0, -1):
        recursive[held[k][2]] += recursive[k]
    field_table, descriptors, suffix = bytearray(), bytearray(), bytearray()
    for k, (v, depth, parent, slot_in_parent) in enumerate(held):
        if v.type == "object":
            first = start_fields + len(field_table)
            shown = {n: i for i, n in enumerate(v.value)}
            for slot, (n, x) in enumerate(zip(own[k], members[k], strict=True)):
                field_table += struct.pack("<IIHBBIII", ids[n], places[ids[n]], len(raw[ids[n]]), TAGS[x.type], 0, *reference(k, slot, x), shown[n])
        else:
            first = start_containers + len(held) * CONTAINER + len(suffix)
            for slot, x in enumerate(v.value):
                suffix += struct.pack("<BBHII", TAGS[x.type], 0, 0, *reference(k, slot, x))
        descriptors += struct.pack("<IBBHIIIIII", k, TAGS[v.type], 0, depth, first, len(v.value), recursive[k], parent, slot_in_parent, 0)
    records = b"".join(struct.pack("<IHH", p, len(b), len(n)) for p, b, n in zip(places, raw, names, strict=True))
    assert len(suffix) == entries * ARRAY_ENTRY
    return [bytes(field_table), records + b"".join(raw), bytes(area), bytes(descriptors + suffix)], [fields, len(names), n_values, len(held)], fields


def _assembled(root: V.Value, digest: bytes) -> bytes:
    """The document in the plain profile, its checksum still zero."""
    bodies, counts, fields = _sections(root)
    cursor, directory, out = HEADER + len(SECTIONS) * ENTRY, b"", b""
    for kind, body, count in zip(SECTIONS, bodies, counts, strict=True):
        begin = _align(cursor)
        out += bytes(begin - cursor) + body
        directory += struct.pack(ENTRY_FORM, kind, BASE_FLAGS, begin, len(body), len(body), count, 0, 0, 1, 0, 0)
        cursor = begin + len(body)
    footer_at = _align(cursor)
    total = footer_at + FOOTER
    limits.check("document.canonical_bytes", total)
    header = struct.pack(HEADER_FORM, MAGIC, *VERSION, HEADER + len(SECTIONS) * ENTRY, ENTRY, 0, total, total, fields, 0, len(SECTIONS), 0, HEADER, footer_at, 0, 0)
    return header + directory + out + bytes(footer_at - cursor) + struct.pack(FOOTER_FORM, END_MAGIC, FOOTER, 1, 1, 1, 32, total, total, fields, digest)


def _sealed(plain: list[bytes]) -> list[bytes]:
    return [p[:32] + struct.pack("<I", c) + p[36:] for p, c in zip(plain, crc32c(plain), strict=True)]


def encode_many(documents: list[V.Value]) -> list[bytes]:
    for v in documents:
        tagged.check_document(v)
    return _sealed([_assembled(v, d) for v, d in zip(documents, content_hashes(documents), strict=True)])


def encode(document: V.Value) -> bytes:
    """A document's bytes in the plain profile: equal documents with equal order of fields have equal bytes."""
    return encode_many([document])[0]


# -- reader ----------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """What a validated document uses."""

    version: tuple[int, int]
    flags: int
    required_features: int
    optional_features: int
    storage: str
    content_hash: bytes


def _expanded(stored: bytes, size: int) -> bytes:
    """A compressed section: its header and table are checked before anything is decoded, a block at a time."""
    form = "<8sHHHBBIIII"
    if len(stored) < struct.calcsize(form):
        _corrupt("compressed section")
    count = -(-size // BLOCK_BYTES)
    if struct.unpack_from(form, stored) != (STREAM_MAGIC, 1, 32, 24, 15, 0, count, size, 32 + 24 * count, 0) or len(stored) < 32 + 24 * count:
        _corrupt("compressed section's header")
    blocks, at = [], 32 + 24 * count
    for k in range(count):
        logical_at, logical, stored_at, length, flags, zero, more = struct.unpack_from("<IIIIHHI", stored, 32 + 24 * k)
        want = min(BLOCK_BYTES, size - k * BLOCK_BYTES)
        if (logical_at, logical, stored_at, zero, more) != (k * BLOCK_BYTES, want, at, 0, 0) or flags > 1 or not 1 <= length <= BLOCK_BYTES or (flags == 1) != (length == want):
            _corrupt("compressed section's table")
        blocks.append((at, length, want, flags))
        at += length
    if at != len(stored) or at >= size:
        _corrupt("compressed section's length")
    codec, out = pa.Codec("lz4_raw"), []
    for begin, length, want, raw in blocks:
        part = stored[begin : begin + length]
        try:
            out.append(part if raw else codec.decompress(part, want, asbytes=True))
        except (OSError, pa.ArrowInvalid):
            _corrupt("compressed block")
        if len(out[-1]) != want:
            _corrupt("compressed block's length")
    return b"".join(out)


def _opened(data: bytes) -> tuple[list[bytes], list[tuple[int, int]], Profile, int]:
    """(section bodies, (logical start, items) of each, profile, canonical length), with everything outside the sections validated but the checksum."""
    if len(data) < HEADER or data[:8] != MAGIC:
        fail("CAP_FORMAT_UNSUPPORTED", "no binary document")
    _, major, minor, header, stride, flags, total, canonical, fields, _, count, zero, directory, footer_at, required, optional = struct.unpack_from(HEADER_FORM, data)
    if (major, minor) != VERSION:
        fail("CAP_UNSUPPORTED_VERSION", f"{major}.{minor}")
    if required & ~COMPRESSED_BIT or optional or flags & ~COMPRESSED_BIT:
        fail("CAP_FORMAT_UNSUPPORTED", "features")
    if (header, stride, count, zero, directory, footer_at + FOOTER, len(data)) != (HEADER + len(SECTIONS) * ENTRY, ENTRY, len(SECTIONS), 0, HEADER, total, total) or flags != required:
        _corrupt("header")
    if not LEAST_BYTES <= total <= canonical <= limits.LIMITS["document.canonical_bytes"]:
        _corrupt("length")
    cursor = logical = header
    bodies, starts, packed = [], [], 0
    for k, kind in enumerate(SECTIONS):
        own, section_flags, at, stored, size, items, codec, profile, version, zero, more = struct.unpack_from(ENTRY_FORM, data, HEADER + k * ENTRY)
        if (codec, profile) not in ((0, 0), (1, 1)):
            fail("CAP_FORMAT_UNSUPPORTED", "codec")
        if (own, section_flags, at, version, zero, more) != (kind, BASE_FLAGS | codec, _align(cursor), 1, 0, 0) or at + stored > footer_at or any(data[cursor:at]) or not codec and stored != size:
            _corrupt("directory")
        starts.append((_align(logical), items))
        logical = starts[-1][0] + size
        cursor = at + stored
        if logical + FOOTER > limits.LIMITS["document.canonical_bytes"]:
            _corrupt("logical length")
        bodies.append((data[at:cursor], codec, size))
        packed |= codec
    if _align(cursor) != footer_at or any(data[cursor:footer_at]) or _align(logical) + FOOTER != canonical or packed != flags or bool(packed) != (total < canonical):
        _corrupt("placement")
    foot = struct.unpack_from(FOOTER_FORM, data, footer_at)
    if foot[:9] != (END_MAGIC, FOOTER, 1, 1, 1, 32, total, canonical, fields):
        _corrupt("footer")
    expanded = [_expanded(stored, size) if codec else stored for stored, codec, size in bodies]
    return expanded, starts, Profile(VERSION, flags, required, optional, "compressed" if flags else "plain", foot[9]), canonical


def _read(bodies: list[bytes], starts: list[tuple[int, int]]) -> V.Value:
    """The root that the sections describe. Offsets are followed only inside their sections; that everything else is canonical is
    seen when the result is written again."""
    (fields_at, n_fields), (names_at, n_names), (values_at, _), (containers_at, n_containers) = starts
    field_table, name_pool, area, tables = bodies
    if len(field_table) != n_fields * FIELD or len(name_pool) < n_names * NAME or not n_containers or len(tables) < n_containers * CONTAINER:
        _corrupt("section sizes")
    names = []
    for k in range(n_names):
        at, size, _ = struct.unpack_from("<IHH", name_pool, k * NAME)
        try:
            names.append(V.field_name(name_pool[at - names_at : at - names_at + size].decode()) if at >= names_at else _corrupt("name"))
        except (UnicodeDecodeError, EngineError):
            _corrupt("name")
    descriptors = [struct.unpack_from("<IBBHIIIIII", tables, k * CONTAINER) for k in range(n_containers)]
    built: dict[int, V.Value] = {}
    limit = limits.LIMITS["document.depth"]

    def child(tag: int, at: int, size: int, above: int) -> V.Value:
        if tag not in TYPES:
            _corrupt("type")
        if TYPES[tag] in ("object", "array"):
            k, off = divmod(at - containers_at, CONTAINER)
            # Children come after their parents, and each has one.
            if off or not above < k < n_containers or k not in built or descriptors[k][1] != tag or descriptors[k][7] != above:
                _corrupt("container")
            return built.pop(k)
        if at < values_at or at - values_at + size > len(area):
            _corrupt("value")
        return value(TYPES[tag], area[at - values_at : at - values_at + size])

    for k in range(n_containers - 1, -1, -1):
        _, tag, _, depth, first, count, *_ = descriptors[k]
        if depth > limit:
            _corrupt("depth")
        if TYPES.get(tag) == "object":
            begin = first - fields_at
            if begin < 0 or begin % FIELD or begin + count * FIELD > len(field_table):
                _corrupt("fields")
            entries = [struct.unpack_from("<IIHBBIII", field_table, begin + i * FIELD) for i in range(count)]
            if any(e[0] >= n_names for e in entries) or sorted(e[7] for e in entries) != list(range(count)):
                _corrupt("field")
            members = {e[7]: (names[e[0]], child(e[3], e[5], e[6], k)) for e in entries}
            built[k] = V.Value("object", dict(members[i] for i in range(count)))
            if len(built[k].value) != count:
                _corrupt("repeated name")
        elif TYPES.get(tag) == "array":
            begin = first - containers_at
            if begin < n_containers * CONTAINER or (begin - n_containers * CONTAINER) % ARRAY_ENTRY or begin + count * ARRAY_ENTRY > len(tables):
                _corrupt("elements")
            entries = [struct.unpack_from("<BBHII", tables, begin + i * ARRAY_ENTRY) for i in range(count)]
            built[k] = V.Value("array", tuple(child(e[0], e[3], e[4], k) for e in entries))
        else:
            _corrupt("container type")
    if set(built) != {0}:
        _corrupt("unreached container")
    return built[0]


def decode_many(items: list[bytes | None]) -> list[tuple[V.Value, Profile] | EngineError]:
    """(document, profile) of each item, or the error that it is. Checksums and hashes of all are computed together."""
    out: list = [None] * len(items)
    zeroed = [d[:32] + bytes(4) + d[36:] if isinstance(d, bytes) and len(d) >= HEADER else b"" for d in items]
    sums = crc32c(zeroed)
    ready = []
    for k, d in enumerate(items):
        try:
            if not isinstance(d, bytes) or len(d) < HEADER or d[:8] != MAGIC:
                fail("CAP_FORMAT_UNSUPPORTED", "no binary document")
            bounded = struct.unpack_from("<I", d, 20)[0] == len(d)
            if bounded and struct.unpack_from("<HH", d, 8) == VERSION and sums[k] != struct.unpack_from("<I", d, 32)[0]:
                _corrupt("checksum")
            bodies, starts, profile, canonical = _opened(d)
            root = _read(bodies, starts)
            try:
                tagged.check_document(root)
                again, counts, _ = _sections(root)
            except EngineError as e:
                _corrupt(e.code)
            if again != bodies or counts != [n for _, n in starts]:
                _corrupt("not canonical")
            ready.append((k, root, profile))
        except (EngineError, struct.error) as e:
            out[k] = e if isinstance(e, EngineError) else EngineError("DUR_CORRUPTION", "truncated")
    for (k, root, profile), digest in zip(ready, content_hashes([r for _, r, _ in ready]), strict=True):
        out[k] = (root, profile) if digest == profile.content_hash else EngineError("DUR_CORRUPTION", "typed content hash")
    return out


def decode(data: bytes) -> V.Value:
    """The document that bytes hold, once all of them are validated."""
    (found,) = decode_many([data])
    if isinstance(found, EngineError):
        raise found
    return found[0]


def negotiate(data: bytes) -> Profile:
    """The profile of a document that this reader accepts as a whole."""
    (found,) = decode_many([data])
    if isinstance(found, EngineError):
        raise found
    return found[1]


def assess_migration(data: bytes, target: tuple[int, int] = VERSION) -> Profile:
    """The profile of a document that needs no migration to the target, the one version there is; no other target is supported."""
    if target != VERSION:
        fail("CAP_UNSUPPORTED_VERSION", f"{target[0]}.{target[1]}")
    return negotiate(data)


# -- columns ---------------------------------------------------------------------


def to_binary(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(data, error): documents in tagged JSON as bytes, or the code of what is wrong with one. Arrow batches; errors stay in their rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            good, errors = [], [None] * batch.num_rows
            for k, text in enumerate(batch.column(0).to_pylist()):
                try:
                    good.append((k, tagged.loads(text) if text is not None else fail("PAR_INVALID_JSON")))
                except EngineError as e:
                    errors[k] = e.code
            data: list[bytes | None] = [None] * batch.num_rows
            for (k, _), raw in zip(good, encode_many([v for _, v in good]), strict=True):
                data[k] = raw
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["data", "error"])

    return docs.select(column).mapInArrow(run, "data binary, error string")


def from_binary(rows: DataFrame, column: str = "data") -> DataFrame:
    """(doc, content_hash, error): bytes as documents in tagged JSON, with the hash of their typed content."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = decode_many(batch.column(0).to_pylist())
            wrong = [isinstance(x, EngineError) for x in found]
            columns = [
                pa.array([None if w else tagged.dumps(x[0]) for x, w in zip(found, wrong, strict=True)], pa.string()),
                pa.array([None if w else x[1].content_hash.hex() for x, w in zip(found, wrong, strict=True)], pa.string()),
                pa.array([x.code if w else None for x, w in zip(found, wrong, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "content_hash", "error"])

    return rows.select(F.col(column)).mapInArrow(run, "doc string, content_hash string, error string")
