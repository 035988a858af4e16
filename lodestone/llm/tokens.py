"""Token ids in wavelet matrix shards.

A shard is one binary value that needs nothing else: header, the documents'
ids and sizes, then bit planes from the highest bit down. A plane is cut into
chunks that are compressed one by one, with the number of ones before each, so
that access, rank (count of an id in a prefix) and select (the k-th place of an
id) unpack a chunk for each plane and no more. Shards are rows of a table that
Spark's own writer puts into the shared folder, so any file system that Spark
writes will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder, share
from .common import checkpoint_dir

MAGIC = b"WVM2"
#: Bytes of a plane that are compressed together; a chunk that doesn't get smaller is stored as it is.
CHUNK = 1 << 14
LEVEL = 1
#: Ids in a shard, about; a document is never split.
SHARD_IDS = 1 << 20
END_ID = 2
#: Parts whose offsets are broadcast at most: 16 bytes each.
MOST_PARTS = 1 << 20
HEADER = "<4sIQQ"


class WaveletMatrix:
    """A sequence of ids below 2**bits, with the documents that it consists of."""

    def __init__(self, data):
        """data: what pack() gave, as bytes or any buffer; it is not copied."""
        data = memoryview(data)
        magic, self.bits, self.n, docs = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("no wavelet matrix")
        at = struct.calcsize(HEADER)
        self._docs, at = data[at : at + docs], at + docs
        self._plane_bytes = -(-self.n // 8)
        chunks = -(-self._plane_bytes // CHUNK)
        self._codec, self._data = pa.Codec("zstd", LEVEL), data
        self.zeros, self.ones_before, self._places = [], [], []
        for _ in range(self.bits):
            (zeros,) = struct.unpack_from("<Q", data, at)
            sizes = np.frombuffer(data, "<u4", chunks, at + 8)
            self.zeros.append(zeros)
            self.ones_before.append(np.frombuffer(data, "<u4", chunks, at + 8 + 4 * chunks).astype(np.int64))
            at += 8 + 8 * chunks
            self._places.append(at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            at = int(self._places[-1][-1])

    @staticmethod
    def pack(ids: np.ndarray, bits: int = 16, documents: pa.RecordBatch | None = None) -> bytes:
        """documents: doc_id and size of each document in order; they add up to the ids."""
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        spare = np.empty_like(now)
        docs = _written(documents) if documents is not None else b""
        codec = pa.Codec("zstd", LEVEL)
        out = [struct.pack(HEADER, MAGIC, bits, len(ids), len(docs)), docs]
        for bit in range(bits - 1, -1, -1):
            one = (now >> bit & 1).view(bool) if now.dtype.itemsize == 1 else (now >> bit & 1).astype(bool)
            plane = np.packbits(one)
            padded = np.zeros(-(-len(plane) // CHUNK) * CHUNK, np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, CHUNK // 8).sum(axis=1, dtype=np.int64)
            parts = []
            for begin in range(0, len(plane), CHUNK):
                raw = plane[begin : begin + CHUNK].tobytes()
                small = codec.compress(raw, asbytes=True)
                parts.append(small if len(small) < len(raw) else raw)
            sizes = np.array([len(x) for x in parts], "<u4")
            before = (np.cumsum(ones) - ones).astype("<u4")
            out += [struct.pack("<Q", len(one) - int(ones.sum())), sizes.tobytes(), before.tobytes(), *parts]
            zeros = len(one) - int(ones.sum())
            np.compress(~one, now, out=spare[:zeros])
            np.compress(one, now, out=spare[zeros:])
            now, spare = spare, now
        return b"".join(out)

    def documents(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(pa.py_buffer(self._docs)).read_next_batch()

    def _chunk(self, k: int, c: int) -> np.ndarray:
        """The bytes of chunk c of plane k."""
        raw = min(CHUNK, self._plane_bytes - c * CHUNK)
        begin, end = int(self._places[k][c]), int(self._places[k][c + 1])
        held = self._data[begin:end]
        return np.frombuffer(held if end - begin == raw else self._codec.decompress(held, raw), np.uint8)

    def unpack(self) -> np.ndarray:
        """All ids in order.

        Going down, places are parted by each plane and each group of equal
        ids-so-far is split by its ones; below the last plane a group is an id.
        """
        kind = np.uint16 if self.bits <= 16 else np.uint32
        if not self.n:
            return np.empty(0, kind)
        order = np.arange(self.n, dtype=np.int32 if self.n < 1 << 31 else np.int64)
        spare = np.empty_like(order)
        value, size = np.zeros(1, kind), np.array([self.n], np.int64)
        for k in range(self.bits):
            plane = np.concatenate([self._chunk(k, c) for c in range(len(self.ones_before[k]))])
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
            # Ones before the end of each group: those of whole bytes, and of the byte that the end lies in.
            byte, bit = np.divmod(np.cumsum(size), 8)
            held = plane.take(byte, mode="clip") >> (8 - bit).astype(np.uint8)
            ones = np.diff(before[byte] + np.where(bit > 0, np.bitwise_count(held), 0), prepend=0)
            one = np.unpackbits(plane, count=self.n).view(bool)
            np.compress(~one, order, out=spare[: self.zeros[k]])
            np.compress(one, order, out=spare[self.zeros[k] :])
            order, spare = spare, order
            high = kind(1 << (self.bits - 1 - k))
            value, size = np.concatenate([value, value | high]), np.concatenate([size - ones, ones])
            value, size = value[size > 0], size[size > 0]
        out = np.empty(self.n, kind)
        out[order] = np.repeat(value, size)
        return out

    def _ones(self, k: int, i: int) -> int:
        """Ones in the first i bits of plane k."""
        c, rest = divmod(i, 8 * CHUNK)
        if c == len(self.ones_before[k]):
            return self.n - self.zeros[k]
        held = self._chunk(k, c)[: -(-rest // 8)]
        out = int(self.ones_before[k][c]) + int(np.bitwise_count(held).sum())
        return out - int(held[-1] & (0xFF >> (rest & 7))).bit_count() if rest & 7 else out

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            c, rest = divmod(i >> 3, CHUNK)
            one = int(self._chunk(k, c)[rest]) >> (7 - (i & 7)) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if one else i - ones
            out = out << 1 | one
        return out

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the value's occurrences among the first `stop` places stand below the last plane."""
        begin = 0
        for k in range(self.bits):
            a, b = self._ones(k, begin), self._ones(k, stop)
            if value >> (self.bits - 1 - k) & 1:
                begin, stop = self.zeros[k] + a, self.zeros[k] + b
            else:
                begin, stop = begin - a, stop - b
        return begin, stop

    def rank(self, value: int, stop: int) -> int:
        """How often the value stands in the first `stop` places."""
        if value >> self.bits:
            return 0
        begin, end = self._range(value, min(stop, self.n))
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the value's k-th occurrence, from 0; -1 if there are no more."""
        if value >> self.bits:
            return -1
        begin, end = self._range(value, self.n)
        if not 0 <= k < end - begin:
            return -1
        at = begin + k
        for plane in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - plane) & 1
            at = self._place(plane, at - self.zeros[plane] if one else at, one)
        return at

    def _place(self, k: int, nth: int, one: int) -> int:
        """The place of the nth (from 0) bit of plane k that equals `one`."""
        before = self.ones_before[k]
        if not one:
            before = np.arange(len(before)) * 8 * CHUNK - before
        c = int(np.searchsorted(before, nth, side="right")) - 1
        begin = c * 8 * CHUNK
        bits = np.unpackbits(self._chunk(k, c), count=min(8 * CHUNK, self.n - begin))
        return begin + int(np.flatnonzero(bits == one)[nth - int(before[c])])


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, each followed by end_id, in ascending order of doc_id, and return the table of shards.

    Rows: part and piece (their order is the order of the ids), n_ids, before
    (ids of the part's earlier pieces) and shard (the wavelet matrix with its
    documents). Null doc_ids come first; rows with one doc_id are ordered by a
    hash of their text. A null text is empty. One range partition by doc_id
    moves the texts, once; a task holds one shard and one chunk of texts at a time.
    """
    shared = share(docs.sparkSession, tokenizer)

    def run(batches):
        enc = encoder(shared.value)
        bits = max(16, (max(*enc.ids, *enc.v.special.values(), end_id)).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        ids, sizes, names, held, part, piece, before = [], [], [], 0, 0, 0, 0

        def shard():
            nonlocal ids, sizes, names, held, piece, before
            documents = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(sizes))], ["doc_id", "size"])
            row = [part, piece, held, before, WaveletMatrix.pack(np.concatenate(ids), bits, documents)]
            ids, sizes, names, held, piece, before = [], [], [], 0, piece + 1, before + held
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "piece", "n_ids", "before", "shard"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, doc = batch.column(2)[0].as_py(), 0
            for flat, stops in enc.encode_flat(batch.column(1).to_pylist(), end_id):
                flat, begin, k = flat.astype(kind), 0, 0
                while k < len(stops):  # as many documents as the shard takes
                    upto = min(len(stops), int(np.searchsorted(stops, begin + SHARD_IDS - held)) + 1)
                    stop = int(stops[upto - 1])
                    ids.append(flat[begin:stop])
                    sizes.append(np.diff(stops[k:upto], prepend=begin))
                    names.append(batch.column(0).slice(doc, upto - k))
                    held += stop - begin
                    begin, doc, k = stop, doc + upto - k, upto
                    if held >= SHARD_IDS:
                        yield shard()
        if held:
            yield shard()

    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    rows = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, piece int, n_ids bigint, before bigint, shard binary")
    rows.write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def read_shards(shards: DataFrame, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards' own ids.

    kind: the type of doc_id. start counts the ids of all documents before it:
    of earlier parts (a running sum over one row for each part), of the part's
    earlier pieces, and of the piece's earlier documents. ids_crc32 is the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    if sums.count() <= MOST_PARTS:
        first = F.broadcast(first)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(0)[k].as_buffer())
                documents = matrix.documents()
                sizes = documents.column(1).to_numpy()
                stops = np.cumsum(sizes)
                raw = memoryview(matrix.unpack().astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                start = stops - sizes + batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([documents.column(0), pa.array(start), documents.column(1), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(first, "part").select("shard", (F.col("first") + F.col("before")).alias("first"))
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' ids as shards below the shared folder, read them back and describe each document."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, tokenizer, folder), docs.schema["doc_id"].dataType.simpleString())
