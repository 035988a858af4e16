"""Line dedup: two Bloom filters find suspects, an exact count confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, beside, cut, join_counted, stored

#: Bits of a filter for each hash, and of a segment: hashes are dealt to segments by their first bits, and each has filters of its own.
BITS_PER_KEY = 16
SEGMENT_BITS = 22
#: Segments whose filters are broadcast at most: 64 MB. Beyond them the lines' hashes go to their segments instead.
MOST_BROADCAST = 128
#: Characters of a key that may be broadcast, if it is one of the thousand commonest.
SHORT_KEY = 4096
#: Bytes of text that a task looks at together.
SLICE = 1 << 22
#: Groups that lines which need no filter are spread over.
SPREAD = 4096


# -- keys ------------------------------------------------------------------------


def long_keys(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, line in it, key) of the lines whose key has at least least_chars code points."""
    split = pc.split_pattern(texts.fill_null(""), "\n")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lines = split.flatten()
    wide = np.flatnonzero(pc.greater_equal(pc.binary_length(lines), least_chars).to_numpy(zero_copy_only=False))
    keys = pc.ascii_lower(pc.utf8_trim(lines.take(pa.array(wide)), characters=BLANK_CHARS))
    long = pc.greater_equal(pc.utf8_length(keys), least_chars)
    wide = wide[long.to_numpy(zero_copy_only=False)]
    stops = np.cumsum(sizes)
    text = np.searchsorted(stops, wide, side="right")
    return text, wide - (stops - sizes)[text], keys.filter(long)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE bytes of text, as lines and keys take several times that."""
    for batch in batches:
        stops = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            upto = max(k + 1, int(np.searchsorted(stops, (stops[k - 1] if k else 0) + SLICE, side="right")))
            yield batch.slice(k, upto - k)
            k = upto
    pa.default_memory_pool().release_unused()


def key_hashes(keys: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys.cast(pa.binary()).to_pylist()), np.uint64, len(keys))


# -- filters ---------------------------------------------------------------------


def _segment(u: np.ndarray, segments: int) -> np.ndarray:
    """Which segment a hash belongs to; segments is a power of two."""
    bits = segments.bit_length() - 1
    return (u >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(u), np.int32)


def _places(u: np.ndarray) -> np.ndarray:
    """Two bits of its segment for each hash."""
    mask = np.uint64((1 << SEGMENT_BITS) - 1)
    return np.concatenate([u & mask, (u >> np.uint64(SEGMENT_BITS)) & mask]).astype(np.int64)


def twice_seen(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): for each segment the filter of hashes seen twice or more, from rows (h long, many boolean).

    A segment's task holds a once-seen and a twice-seen filter of 2**SEGMENT_BITS
    bits and nothing else. A hash whose bits are set in the first one sets them
    in the second, so a repeated hash always has its bits set there; one that
    isn't repeated seldom has. many says that a task has seen the hash twice by itself.
    """
    size = 1 << SEGMENT_BITS

    def number(batches):
        for batch in batches:
            u = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(u, segments)), *batch.columns], ["segment", "h", "many"])

    def fill(batches: Iterator[pa.RecordBatch]):
        at, once, twice = None, np.zeros(size, np.bool_), np.zeros(size, np.bool_)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()])], ["segment", "bits"])
        for batch in batches:
            segment, h, many = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(segment).tolist():
                if s != at:
                    if at is not None:
                        yield done()
                    at = s
                    once[:] = twice[:] = False
                mine = segment == s
                u = h[mine].view(np.uint64)
                twice[_places(u[many[mine]])] = True
                place, n = np.unique(_places(u), return_counts=True)
                twice[place[(n > 1) | once[place]]] = True
                once[place] = True
        if at is not None:
            yield done()

    dealt = hashes.mapInArrow(number, "segment int, h bigint, many boolean").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(fill, "segment int, bits binary")


def _seen(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = _places(u)
    return ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).reshape(2, -1).all(axis=0)


def _suspects(docs: DataFrame, filters: DataFrame, segments: int, least_chars: int, most_broadcast: int) -> DataFrame:
    """(doc_id, tag, line, key) of the long lines whose hashes the filters may have seen twice; docs has doc_id, text and tag."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tag bigint, line int, key string"

    def rows(batch, text, line, keys, keep):
        keep = np.flatnonzero(keep)
        owner = pa.array(text[keep])
        return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(2).take(owner), pa.array(line[keep].astype(np.int32)), keys.take(pa.array(keep))], ["doc_id", "tag", "line", "key"])

    if segments <= most_broadcast:
        held = {r["segment"]: bytes(r["bits"]) for r in filters.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def test(batches):
            bits = {s: np.frombuffer(b, np.uint8) for s, b in shared.value.items()}
            for batch in slices(batches, 1):
                text, line, keys = long_keys(batch.column(1), least_chars)
                if not len(keys):
                    continue
                u = key_hashes(keys)
                segment, keep = _segment(u, segments), np.zeros(len(u), bool)
                for s in np.unique(segment).tolist():
                    mine = np.flatnonzero(segment == s)
                    keep[mine] = _seen(u[mine], bits[s])
                if keep.any():
                    yield rows(batch, text, line, keys, keep)

        return docs.select("doc_id", "text", "tag").mapInArrow(test, schema)

    # The filters together are too large for a task: hashes go to their segments, and what is suspected comes back to its text.
    # A line that its own task has seen twice needs no filter, so one of very many lines isn't dealt to one segment.

    def hashed(batches):
        for batch in slices(batches, 1):
            text, line, keys = long_keys(batch.column(1), least_chars)
            if len(keys):
                u, owner = key_hashes(keys), pa.array(text)
                _, inverse, count = np.unique(u, return_inverse=True, return_counts=True)
                spread = -1 - (text % SPREAD).astype(np.int32)
                segment = np.where(count[inverse] > 1, spread, _segment(u, segments)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(segment), pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64)), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(line.astype(np.int32))], names)

    def test_dealt(batches):
        held = None
        for batch in batches:
            segment = batch.column(0).to_numpy()
            filled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | filled[1:] | filled[:-1])) if len(segment) else []
            for begin, end in zip(list(edges), [*list(edges)[1:], batch.num_rows], strict=False):
                if filled[begin]:  # a segment's filter comes before its rows
                    held = np.frombuffer(batch.column(1)[int(begin)].as_buffer(), np.uint8)
                    continue
                part = batch.slice(int(begin), int(end - begin))
                keep = np.ones(part.num_rows, bool) if segment[begin] < 0 else _seen(part.column(2).to_numpy().view(np.uint64), held)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (3, 4, 5)], ["doc_id", "tag", "line"])

    names = ["segment", "bits", "h", "doc_id", "tag", "line"]
    lines = docs.select("doc_id", "text", "tag").mapInArrow(hashed, f"segment int, bits binary, h bigint, doc_id {kind}, tag bigint, line int")
    dealt = lines.unionByName(filters, allowMissingColumns=True).repartition("segment").sortWithinPartitions("segment", F.col("bits").isNull())
    found = dealt.mapInArrow(test_dealt, f"doc_id {kind}, tag bigint, line int").groupBy("doc_id", "tag").agg(F.collect_set("line").alias("lines"))
    texts = docs.select("doc_id", "tag", "text").dropDuplicates(["doc_id", "tag"])
    back = found.alias("f").join(texts.alias("t"), F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.tag") == F.col("t.tag"))).select("f.doc_id", "f.tag", "f.lines", "t.text")

    def keyed(batches):
        for batch in batches:
            text, line, keys = long_keys(batch.column(3), least_chars)
            wanted = batch.column(2)
            pairs = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False)) << 32 | wanted.flatten().to_numpy()
            keep = np.flatnonzero(np.isin(text << 32 | line, pairs))
            owner = pa.array(text[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(line[keep].astype(np.int32)), keys.take(pa.array(keep))], ["doc_id", "tag", "line", "key"])

    return back.mapInArrow(keyed, schema)


# -- the operator ----------------------------------------------------------------


def drop_repeated_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least least_chars code points found in at least least_docs
    documents (distinct doc_ids) lose all their lines except in the largest
    doc_id that holds them; there all stay. A null or empty text is one empty
    line and its kept_text is empty. Rows with a null doc_id count as one
    document below all others. Repeated rows are treated alike. Texts and lines
    may be of any length. Keys are confirmed by their text; rows of one doc_id
    are told apart by 64 bits of their texts' hashes. Columns of docs with the
    three names are replaced. With up to most_broadcast filter segments these
    are broadcast, else lines go to them; the result is the same.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    tag = F.xxhash64("text")
    given = docs.select("doc_id", "text", tag.alias("tag"))

    def hashes(batches):
        for batch in slices(batches, 0):
            _, _, keys = long_keys(batch.column(0), least_chars)
            if len(keys):
                # A line that stands twice in a text counts as repeated too: it is confirmed or not like any other.
                h, n = np.unique(key_hashes(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "many"])

    seen = stored(given.select("text").mapInArrow(hashes, "h bigint, many boolean"))
    n = seen.count()
    segments = 1 << max(0, (BITS_PER_KEY * n >> SEGMENT_BITS)).bit_length()
    suspected = stored(_suspects(given, twice_seen(seen, segments), segments, least_chars, most_broadcast))
    repeated = suspected.groupBy("key").agg(F.count_distinct(F.struct("doc_id")).alias("docs"), F.max("doc_id").alias("stays"), F.count("*").alias("n"))
    repeated = cut(repeated.where(F.col("docs") >= least_docs).select("key", "stays", F.when(F.length("key") <= SHORT_KEY, F.col("n")).otherwise(0).alias("n")))
    drops = join_counted(suspected, repeated, "key", suspected.count()).where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    drops = drops.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("line").alias("_drop"))
    out = docs.withColumn("_text_tag", tag).join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_tag").eqNullSafe(F.col("_tag")), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def without(ls):
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "_drop")
        return F.struct(F.size(ls).cast("long").alias("n"), F.transform(left, lambda i: F.get(ls, i)).alias("kept"))

    whole = F.struct(F.size(lines).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("kept"))
    out = out.withColumn("_left", F.when(F.col("_drop").isNull(), whole).otherwise(F.transform(F.array(lines), without)[0]))
    kept = F.coalesce(F.array_join("_left.kept", "\n"), F.col("text"), F.lit(""))
    n_lines = F.col("_left.n")
    dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long")
    return out.withColumns({"n_lines": n_lines, "n_dropped": dropped, "kept_text": kept}).select(*docs.columns, "n_lines", "n_dropped", "kept_text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without repeated lines, in its columns; n_chars, where there is one, follows the text. Null texts stay null."""
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    packed, back = beside(docs, *used)
    out = drop_repeated_lines(packed).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in used:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back)
