"""SimHash near-dedup with Golay-code fuzzy hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind, cut, words
from .components import components

#: The (23, 12) Golay code's generator polynomial.
GENERATOR = 0b110001110101
#: The 64 bits in three segments, each shorter than a codeword.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 4
#: Groups above this size are linked by the exact ball join instead, which grows in proportion to them and gives the same components.
LARGE_GROUP = 32768
#: Pairs that a task compares at a time, and fingerprints that a task decodes.
PAIRS, DECODED = 1 << 20, 20_000


def shingle_hashes(text: Column, shingle: int) -> Column:
    """XXH64 (seed 42) of every shingle, repeats included; a shorter text has one of all its words, a blank one none."""

    def hashed(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *(ws[i + k] for k in range(shingle)))))
        return F.when(F.size(ws) >= shingle, each).when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))

    return bind(words(ascii_lower(F.coalesce(text, F.lit("")))), hashed)


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that over half of them have set; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    parts = -(-n // 255)  # byte-wide counters hold 255
    first_part = np.cumsum(parts) - parts
    begin = np.cumsum(n) - n
    starts = np.repeat(begin - 255 * first_part, parts) + 255 * np.arange(parts.sum())
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((values >> np.uint64(j)) & lanes, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums, first_part, axis=0, dtype=np.int64)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths()).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            fp = majority(values, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", shingle_hashes(F.col("text"), shingle).alias("h")).mapInArrow(run, f"doc_id {kind}, fp bigint")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error patterns of weight 4 at most for each syndrome."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            patterns[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    table = np.full((1 << 11, max(map(len, patterns))), -1, np.int64)
    for s, each in enumerate(patterns):
        table[s, : len(each)] = each
    return low, high, table


def codewords(segment: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all codewords within 4 bits of each segment; -1 pads.

    The code is perfect with radius 3, so a word between two segments that
    differ in 2 bits lies within 3 of one codeword, which both segments find.
    """
    low, high, table = _golay()
    e = table[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(e >= 0, (segment[:, None] ^ e) >> 11, -1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs. Of 4 differing bits at most one segment holds over 2, so two segments share a codeword each."""
    u = fp.view(np.uint64)
    found = [codewords(((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows, keys = [], []
    for which, (x, y) in enumerate(combinations(found, 2)):
        both = (x[:, :, None] >= 0) & (y[:, None, :] >= 0)
        key = which << 24 | x[:, :, None] << 12 | y[:, None, :]
        rows.append(np.nonzero(both)[0])
        keys.append(key[both])
    return np.concatenate(rows), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between a and b."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def links_in_groups(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs with one key that differ in `most` bits at most.

    Of most + 1 blocks that the 64 bits are cut into, two such fingerprints
    agree in one: only those that agree in a block are compared, which leaves
    of unlike ones in a group about one in two to the power of its bits. Alike
    ones are taken out as they are linked: a block's members within half of
    `most` bits of its first one need no look at each other.
    """
    got_a, got_b = [fp[:0]], [fp[:0]]
    edges = np.linspace(0, 64, most + 2).astype(int).tolist()
    for low, high in zip(edges, edges[1:], strict=False):
        if not len(fp):
            break
        part = (fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.lexsort((part, key))
        k, p, f = key[order], part[order], fp[order]
        u = f.view(np.uint64)
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hub = begins[group]
        far = np.bitwise_count(u ^ u[hub])
        link = (far <= most) & (hub != np.arange(len(f)))
        got_a.append(f[link])
        got_b.append(f[hub[link]])
        # Two within most / 2 of the hub are connected through it; every other pair has one member beyond.
        sizes = np.diff(np.append(begins, len(f)))
        beyond = np.flatnonzero((2 * far.astype(np.int64) > most) & (sizes[group] > 2))
        work = np.cumsum(sizes[group[beyond]])
        cuts = np.unique(np.searchsorted(work, np.arange(PAIRS, int(work[-1]) + PAIRS, PAIRS), side="right")) if len(work) else []
        first = 0
        for last in [*cuts, len(beyond)]:
            take = beyond[first : max(last, first + 1)]
            first += len(take)
            n = sizes[group[take]]
            row = np.repeat(take, n)
            other = np.repeat(hub[take] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            near = (row != other) & (np.bitwise_count(u[row] ^ u[other]) <= most)
            a, b = forest(f[row[near]], f[other[near]])
            got_a.append(a)
            got_b.append(b)
    return forest(np.concatenate(got_a), np.concatenate(got_b))


def linked(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the components that all pairs of at most `most` differing bits have."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} differing bits")

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 2000):
                row, key = golay_keys(fp[k : k + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[k : k + 2000][row])], ["key", "fp"])

    def compare(batches):
        empty = np.empty(0, np.int64)
        held_k, held_f, large = [], [], None

        def out(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if large is not None:  # the rest of a large group passes through
                n = int(np.searchsorted(k, large, side="right"))
                yield out(f[:n], f[:n], True)
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                large = None
            held_k.append(k)
            held_f.append(f)
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            stop = int(np.searchsorted(k, k[-1], side="left"))
            yield out(*links_in_groups(k[:stop], f[:stop], most), False)
            k, f = k[stop:], f[stop:]
            if len(k) > LARGE_GROUP:
                large = k[-1]
                yield out(f, f, True)
                k, f = k[:0], f[:0]
            held_k, held_f = [k], [f]
        yield out(*links_in_groups(np.concatenate([empty[:0].astype(np.int32), *held_k]), np.concatenate([empty, *held_f]), most), False)

    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // DECODED))
    keyed = distinct.select("fp").repartition(parts).mapInArrow(keys, "key int, fp bigint")
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint, hot boolean").distinct())
    edges = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp"))
    return edges if hot.isEmpty() else edges.unionByName(ball_links(hot, most))


def ball_links(distinct: DataFrame, most: int) -> DataFrame:
    """The same for any number of alike fingerprints, in proportion to them.

    Two differ in at most r + s bits if and only if the ball of radius r around
    one meets the ball of radius s around the other. With r and s the halves of
    `most`, s the larger, every point of an outer ball links its fingerprint to
    the least whose inner ball has that point.
    """
    inner, outer = most // 2, most - most // 2
    masks = np.array([sum(1 << p for p in places) for r in range(outer + 1) for places in combinations(range(64), r)], np.uint64)
    near = np.bitwise_count(masks) <= inner

    def balls(batches):
        for batch in batches:
            for f in batch.column(0).to_numpy(zero_copy_only=False):
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(f).view(np.uint64) ^ masks).view(np.int64)), pa.array(np.full(len(masks), f)), pa.array(near)], ["point", "fp", "near"])

    points = distinct.select("fp").mapInArrow(balls, "point bigint, fp bigint, near boolean")
    least = points.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null").drop("n")
    return points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Words are split at ASCII white space after A-Z are lower-cased; a bit of the
    fingerprint is set if over half of the shingle hashes have it. A null or
    blank text has fingerprint zero and links like any other. component_id is
    the least doc_id reachable through links of at most `most` differing bits;
    null doc_ids are skipped unless a component has no other. Repeated rows
    stay; texts may be of any length. Fingerprints are compared exactly. Other
    columns of docs are not read.
    """
    fps = cut(fingerprints(docs, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(linked(distinct, most)).withColumnRenamed("node", "fp")
    placed = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The document of each component with the least doc_id, in the columns of docs.

    Rows with a null doc_id stay only if their component has no other; all
    rows that share the doc_id that stays and its fingerprint stay.
    """
    found = near_duplicates(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
