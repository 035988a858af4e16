"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import forest

THRESHOLD = 0.93
#: The rotation is fitted on about this many vectors, those with the least hashes of their ids; every vector is indexed.
FIT_SAMPLE = 20_000
FIT_ROUNDS = 30
SEED = 7
BITS = 64
#: Of pairs exactly at the threshold, the share that no table may bring together at most, and the pairs that are drawn to see.
MOST_MISSED, DRAWN = 0.02, 4000
#: Bits of a table: so many that its buckets hold about 2**-SPARE codes each on average, and at least LEAST_WIDTH.
SPARE, LEAST_WIDTH = 1, 8
MOST_TABLES = 400
#: Vectors in a block.
BLOCK_ROWS = 512
#: Codes of a table's bucket that meet as rows, two by two; larger buckets are compared in blocks of vectors.
MOST_PAIRED = 32


def learn_rotation(x: np.ndarray, bits: int, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions and the rotation that brings them nearest to balanced binary codes."""
    rng = np.random.default_rng(SEED)
    mean = x.mean(axis=0)
    centred = x - mean
    bits = min(bits, x.shape[1])
    _, vectors = np.linalg.eigh(centred.T @ centred)
    basis = vectors[:, ::-1][:, :bits]
    v = centred @ basis
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        codes = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        turn = (left @ right).T
    return mean, basis @ turn


def _usable(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of unit vectors."""
    code = np.zeros(len(x), np.uint64)
    signs = (x - mean) @ projection >= 0
    for k in range(signs.shape[1]):
        code |= signs[:, k].astype(np.uint64) << np.uint64(k)
    return code


def hamming_tables(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int, threshold: float) -> tuple[list[int], int]:
    """(masks, bits): the bits that each table compares, and the bits in which codes of linked vectors differ at most.

    Pairs of cosine `threshold` are drawn: vectors of x and partners at that
    angle in any direction, which is the hardest case that links. Tables of
    `width` bits are drawn too, until all but MOST_MISSED of the pairs agree
    in the bits of some table. The number of tables grows as a small power of
    the number of vectors, as wider tables separate more.
    """
    rng = np.random.default_rng(SEED + 1)
    base = x[rng.integers(0, len(x), DRAWN)]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    partner = threshold * base + np.sqrt(max(0.0, 1 - threshold**2)) * np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 0)
    differ = _signs(base, mean, projection) ^ _signs(partner, mean, projection)
    bits = projection.shape[1]
    width = min(width, bits)
    while True:
        masks, missed = [], differ
        while len(masks) < MOST_TABLES and len(missed) > MOST_MISSED * DRAWN:
            masks.append(sum(1 << int(k) for k in rng.permutation(bits)[:width]))
            missed = missed[missed & np.uint64(masks[-1]) != 0]
        if len(missed) <= MOST_MISSED * DRAWN or width <= 1:
            return masks or [(1 << width) - 1], int(np.bitwise_count(differ).max())
        width -= 1  # codes of few bits can't be told apart so finely


def _classes(vectors: DataFrame, sample: int, threshold: float) -> tuple[DataFrame, dict[int, tuple[list[int], int]]]:
    """vectors (label, node, n, dim, v) with a 64-bit code each, and the tables of each dimension. Dimensions that the sample lacks get one code, and so are compared in full."""
    spark = vectors.sparkSession
    # Under this hash lie a few more than the least `sample`, however many vectors there are; a limit would send as many rows from each task.
    share = (sample + 6 * math.isqrt(sample) + 6) / max(1, vectors.count())
    drawn = vectors.select("dim", "v", F.xxhash64("node").alias("h"), "node")
    drawn = drawn if share >= 1 else drawn.where(F.col("h") < int((2 * share - 1) * 2**63))
    bounded = drawn.toPandas().sort_values(["h", "node"]).head(sample)
    most = vectors.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n"))
    most = {r["dim"]: r["n"] for r in most.where(F.col("dim").isin([int(d) for d in bounded["dim"].unique()])).collect()}
    learned, tables = {}, {}
    for d, g in bounded.groupby("dim"):
        if len(g) > 1:
            x = _unit(np.array(g["v"].tolist(), np.float64))
            learned[int(d)] = learn_rotation(x, BITS)
            width = max(LEAST_WIDTH, int(most[d]).bit_length() + SPARE)
            tables[int(d)] = hamming_tables(x, *learned[int(d)], width, threshold)
    shared = spark.sparkContext.broadcast(learned)

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            code = np.zeros(len(dims), np.uint64)
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    code[at] = _signs(_unit(_matrix(batch.column(4).take(pa.array(at)))), *shared.value[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], [*batch.schema.names, "code"])

    fields = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{fields}, code bigint"), tables


def _meetings(classes: DataFrame, tables: dict[int, tuple[list[int], int]]) -> DataFrame:
    """Which different codes of a label agree in the bits of some table: (label, dim, code_a, code_b) for two codes in a bucket of MOST_PAIRED
    codes at most, if they differ in no more bits than linked vectors do; (label, dim, code_a, t, key) for each code in a larger bucket.

    Two codes meet in the first table that brings them together and in no other. Buckets are read in order, so a task holds a batch and
    MOST_PAIRED rows more, however large they are.
    """
    found = []
    for d, (masks, _) in sorted(tables.items()):
        each = [F.struct(F.lit(k).alias("t"), F.col("code").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for k, m in enumerate(masks)]
        found.append(classes.where(F.col("dim") == d).select("label", "dim", "code", F.explode(F.array(*each)).alias("x")).select("label", "dim", "x.t", "x.key", "code"))
    kind = classes.schema["label"].dataType.simpleString()
    if not found:
        return classes.select("label", "dim", F.col("code").alias("code_a"), F.col("code").alias("code_b"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("long").alias("key")).where(F.lit(False))
    keys = reduce(DataFrame.unionByName, found).repartition("label", "dim", "t", "key").sortWithinPartitions("key", "t", "dim", "label")

    def paired(rows: pa.Table, size: np.ndarray, left: np.ndarray) -> pa.Table:
        """Pairs within runs; of a row, size is its run's and left counts the rows after it in the run."""
        dim, t, code = (rows[c].to_numpy() for c in ("dim", "t", "code"))
        firsts, seconds = [], []
        at = np.flatnonzero((size <= MOST_PAIRED) & (left > 0))
        for step in range(1, MOST_PAIRED):
            at = at[left[at] >= step]
            if not len(at):
                break
            firsts.append(at)
            seconds.append(at + step)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
        differ = (code[a] ^ code[b]).view(np.uint64)
        good = np.zeros(len(a), bool)
        for d in np.unique(dim[a]).tolist():
            masks, most = tables[d]
            here = np.flatnonzero((dim[a] == d) & (np.bitwise_count(differ) <= most))
            good[here[_first_met(differ[here], t[a][here], masks)]] = True
        a, b = a[good], b[good]
        a, b = np.where(code[a] < code[b], a, b), np.where(code[a] < code[b], b, a)
        nothing = lambda kind: pa.nulls(len(a), kind)
        return pa.table([*(rows[c].take(pa.array(a)) for c in ("label", "dim", "code")), pa.array(code[b]), nothing(pa.int32()), nothing(pa.int64())], OUT)

    def marked(rows: pa.Table) -> pa.Table:
        return pa.table([rows["label"], rows["dim"], rows["code"], pa.nulls(len(rows), pa.int64()), rows["t"], rows["key"]], OUT)

    def run(batches):
        held, large = None, None  # the open run, if it is small; one row of it, if it is large
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            before = held if held is not None else large
            rows = (pa.concat_tables([before, rows]) if before is not None else rows).combine_chunks()
            changed = np.zeros(len(rows) - 1, bool)
            for c in ("key", "t", "dim", "label"):
                changed |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)).to_numpy()
            start = np.concatenate([[0], np.flatnonzero(changed) + 1])
            size = np.diff(np.concatenate([start, [len(rows)]]))
            was_large = large is not None
            many = size > MOST_PAIRED
            many[0] |= was_large
            open_large = bool(many[-1])
            end = len(rows) if open_large else int(start[-1])
            held, large = (None, rows.slice(len(rows) - 1)) if open_large else (rows.slice(end), None)
            of = np.repeat(np.arange(len(start)), size)
            is_many = many[of]
            if was_large:
                is_many[0] = False  # went out with the batch before
            yield from marked(rows.filter(pa.array(is_many))).to_batches()
            shown = np.where(many[of], MOST_PAIRED + 1, size[of])
            left = (start + size - 1)[of] - np.arange(len(rows))
            yield from paired(rows.slice(0, end), shown[:end], left[:end]).to_batches()
        if held is not None:
            n = len(held)
            yield from paired(held.combine_chunks(), np.full(n, n), np.arange(n)[::-1]).to_batches()

    OUT = ["label", "dim", "code_a", "code_b", "t", "key"]
    return keys.mapInArrow(run, f"label {kind}, dim int, code_a bigint, code_b bigint, t int, key bigint")


def _first_met(differ: np.ndarray, t: np.ndarray | int, masks: list[int]) -> np.ndarray:
    """Places of the differences that no table before t leaves alike."""
    t, at = np.broadcast_to(t, differ.shape), np.arange(len(differ))
    for k in range(int(t.max()) if len(t) else 0):
        at = at[(k >= t[at]) | (differ[at] & np.uint64(masks[k]) != 0)]
    return at


def _bucket_blocks(marks: DataFrame, coded: DataFrame) -> DataFrame:
    """(label, dim, t, key, chunk, nodes, ns, codes, vs): the nodes of large buckets in blocks, in the order of their codes."""
    bucket = ["label", "dim", "t", "key"]
    members = marks.select(*bucket, F.col("code_a").alias("code")).hint("merge").join(coded.select("label", "dim", "code", "node", "n", "v"), ["label", "dim", "code"])
    place = F.row_number().over(W.partitionBy(*bucket).orderBy("code", "node"))
    members = members.withColumn("chunk", F.floor((place - 1) / F.lit(BLOCK_ROWS)).cast("int"))
    return members.groupBy(*bucket, "chunk").agg(*(F.collect_list(c).alias(f"{c}s") for c in ("node", "n", "code", "v")))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = FIT_SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine, in double precision,
    is at least `threshold`. Null labels, null, empty or zero vectors and those with null
    or non-finite components link with nothing; nor do vectors of unlike
    dimensions. n_links counts all other rows linked, repeated rows included.
    component_id is the least vec_id reachable; without links it is the row's
    own. Equal vectors are one node; nodes with one code are compared block by
    block, and so are those that a large bucket of a Hamming table brings
    together; only codes of small buckets meet as rows. Every link returned is exact; the tables
    may miss a link whose codes lie far apart.
    """
    node = F.xxhash64("label", "embedding")
    rows = vectors.select("vec_id", F.when(_usable(F.col("embedding")), node).alias("node"), "label", "embedding")
    nodes = rows.where("node is not null").groupBy("label", "node").agg(F.count("*").alias("n"), F.first("embedding").alias("v"), F.min("vec_id").alias("least"))
    coded, tables = _classes(cut(nodes.select("label", "node", "n", F.size("v").alias("dim"), "v", "least")), sample, threshold)
    coded = cut(coded)
    same = ["label", "dim", "code"]
    classes = cut(coded.groupBy(*same).agg(F.count("*").alias("members")))
    itself = classes.where("members > 1").select("label", "dim", F.col("code").alias("code_a"), F.col("code").alias("code_b"))
    # Sizes of files say little of such rows: none of these joins may send a side to all tasks.
    meetings = cut(_meetings(classes, tables))
    pairs = itself.unionByName(meetings.where("t is null").select("label", "dim", "code_a", "code_b"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(BLOCK_ROWS))).cast("int")
    blocks = coded.join(classes, same).groupBy(*same, chunk.alias("chunk")).agg(F.collect_list("node").alias("nodes"), F.collect_list("n").alias("ns"), F.collect_list("v").alias("vs"))
    blocks = cut(blocks)
    side = lambda s: blocks.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("code", "chunk", "nodes", "ns", "vs")))
    met = pairs.hint("merge").join(side("a"), ["label", "dim", "code_a"]).hint("merge").join(side("b"), ["label", "dim", "code_b"]).where("code_a < code_b or chunk_a <= chunk_b")
    no_codes = F.lit(None).cast("array<bigint>")
    met = met.select("nodes_a", "ns_a", "vs_a", "nodes_b", "ns_b", "vs_b", F.expr("code_a = code_b and chunk_a = chunk_b").alias("own"), "dim", F.lit(None).cast("int").alias("t"), no_codes.alias("codes_a"), no_codes.alias("codes_b"))
    large = cut(_bucket_blocks(meetings.where("t is not null"), coded))
    part = lambda s: large.select("label", "dim", "t", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "nodes", "ns", "vs", "codes")))
    both = part("a").hint("merge").join(part("b"), ["label", "dim", "t", "key"]).where("chunk_a <= chunk_b")
    met = met.unionByName(both.select("nodes_a", "ns_a", "vs_a", "nodes_b", "ns_b", "vs_b", F.expr("chunk_a = chunk_b").alias("own"), "dim", "t", "codes_a", "codes_b"))

    def others(codes: np.ndarray, codes_b: np.ndarray, near: np.ndarray, t: int, masks: list[int]) -> np.ndarray:
        """Of near pairs, those of different codes that no table before t brings together."""
        a, b = np.nonzero(near)
        differ = codes[a] ^ codes_b[b]
        at = _first_met(differ, t, masks)
        at = at[differ[at] != 0]
        out = np.zeros_like(near)
        out[a[at], b[at]] = True
        return out

    def alike(codes: np.ndarray, t: int, masks: list[int]) -> bool:
        """Whether all codes are one or meet in one table before t."""
        differ = int(np.bitwise_or.reduce(codes) ^ np.bitwise_and.reduce(codes))
        return not differ or any(not differ & m for m in masks[:t])

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ids, n, u), (ids_b, n_b, u_b) = ((np.array(batch.column(i)[k].as_py(), np.int64), np.array(batch.column(i + 1)[k].as_py(), np.int64), _unit(_matrix(batch.column(i + 2)[k].values))) for i in (0, 3))
                t = batch.column(8)[k].as_py()
                if t is not None:
                    masks = tables[batch.column(7)[k].as_py()][0]
                    codes, codes_b = (np.array(batch.column(i)[k].as_py(), np.int64).view(np.uint64) for i in (9, 10))
                    if alike(np.concatenate([codes, codes_b]), t, masks):
                        continue
                near = u @ u_b.T >= threshold
                if t is not None:
                    near = others(codes, codes_b, near, t, masks)
                if batch.column(6)[k].as_py():  # a block with itself: each pair stands on both sides
                    np.fill_diagonal(near, False)
                    found = [(ids, near @ n_b)]
                else:
                    found = [(ids, near @ n_b), (ids_b, near.T @ n)]
                a, b = np.nonzero(near)
                hub, spoke = forest(ids[a], ids_b[b])
                node = np.concatenate([x for x, _ in found])
                links = np.concatenate([x for _, x in found]).astype(np.int64)
                some = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[some], hub])), pa.array(np.concatenate([links[some], 0 * hub])), pa.array(np.concatenate([node[some], spoke]))], ["node", "links", "other"]
                )

    found = cut(met.repartition(F.xxhash64("nodes_a", "nodes_b")).mapInArrow(compare, "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = coded.select("node", "n", "least").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.select("node", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = placed.join(least, "component").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
