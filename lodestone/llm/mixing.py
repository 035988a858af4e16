"""Mixing sources to target weights by pivotal dependent rounding, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Units that one task folds at a time.
BLOCK = 256
SEED = 42


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources get the weights in turn, by code point, null last, and share all
    sizes by them; a target stops at `most` times its source's size and what
    it leaves is shared by weight among the rest, until none is above. That
    ends with target = min(weight * level, limit); the level follows from
    running sums over sources ordered by limit / weight. Windows here see one
    row for each source. A source of size 0 has target 0.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.array(*(F.lit(float(x)) for x in weights))[turn]
    rows = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(most)).withColumn("at", F.col("limit") / F.col("w"))
    every, order = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("at", "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    # The first source that the level of the rest leaves below its limit sets the level for all.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.least("limit", F.coalesce(F.col("w") * F.col("level"), F.col("limit"))).alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def _node(name: Column, place: Column) -> Column:
    """An id of a unit: two values that nothing else in its source has."""
    return F.struct(name.cast("string").alias("name"), place.cast("long").alias("place"))


def _fold(units: Column) -> Column:
    """Pivotal rounding of an array of structs (p in [0, 1), u, id): which positions get 1, and who is left with what.

    The held unit meets the next one. Below 1 in all, one of them takes the
    sum and the other 0; else one gets 1 and the other keeps the rest. Either
    happens with the odds that keep each unit's expectation.
    """
    start = F.struct(F.lit(-1).alias("held"), F.lit(0.0).alias("p"), F.array().cast("array<int>").alias("ones"), F.lit(0).alias("k"))

    def meet(a: Column, x: Column) -> Column:
        s = a["p"] + x["p"]
        new_wins = F.when(s < 1, x["u"] * s >= a["p"]).otherwise(x["u"] * (2 - s) >= 1 - x["p"])  # else the held one does
        full = s >= 1
        # Below 1 the winner is held; else the winner is done and the other held.
        held = F.when(s == 0, F.lit(-1)).when(full != new_wins, a["k"]).otherwise(a["held"])
        done = F.when(new_wins, a["k"]).otherwise(a["held"])
        return F.struct(
            held.alias("held"),
            F.when(full, s - 1).otherwise(s).alias("p"),
            F.when(full, F.concat(a["ones"], F.array(done))).otherwise(a["ones"]).alias("ones"),
            (a["k"] + 1).alias("k"),
        )

    return F.aggregate(units, start, meet)


def _level(units: DataFrame, up: Column) -> DataFrame:
    """units (source, id, p, order) folded in groups (source, up), largest first, so that what one wins another of its size
    loses and a small one is left open: a row for each unit with one (null: left open), the group's id and the open p."""
    keyed = units.select("source", "id", "p", "order", up.alias("up"))
    each = F.struct("order", "id", "p", _uniform(F.col("id"), F.lit("u")).alias("u"))
    groups = keyed.groupBy("source", "up").agg(F.array_sort(F.collect_list(each)).alias("units"))
    groups = groups.withColumn("f", F.transform(F.array("units"), _fold)[0])
    rows = groups.select("source", "up", "f", F.posexplode("units").alias("k", "x"))
    open_here = (F.col("f.held") == F.col("k")) & (F.col("f.p") > 0)
    return rows.select(
        "source", "up", F.col("x.id").alias("id"), F.col("x.order").alias("order"),
        F.when(~open_here, F.array_contains("f.ones", F.col("k")).cast("int")).alias("one"),
        F.when(open_here, F.col("f.p")).alias("left"),
    )


def _decide(units: DataFrame, most_per_source: int, depth: int = 0) -> DataFrame:
    """(source, id, one) for each of units (source, id, p, order): a reduction tree whose nodes fold BLOCK units or so."""
    groups = max(1, -(-most_per_source // BLOCK))
    up = F.lit(0) if groups == 1 else F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(groups))
    done = cut(_level(units, up))
    if groups == 1:
        # One unit is left open in a source: it gets 1 with its own probability.
        last = F.when(_uniform(F.col("id"), F.lit("last")) < F.col("left"), 1).otherwise(0)
        return done.select("source", "id", F.coalesce("one", last).alias("one"))
    node = _node(F.lit(f"tree {depth}"), F.col("up").cast("long"))
    left = done.where("left is not null").select("source", node.alias("id"), F.col("left").alias("p"), "order")
    above = _decide(left, groups, depth + 1).withColumnsRenamed({"id": "node", "one": "above"})
    shut = done.where("left is null").select("source", "id", "one")
    was_open = done.where("left is not null").withColumn("node", node)
    opened = was_open.alias("o").join(above.alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")) & F.col("o.node").eqNullSafe(F.col("a.node")))
    return shut.unionByName(opened.select("o.source", "o.id", F.col("above").alias("one")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, row_hash, size, source, source_size, target, copies, rows): how often `rows` equal rows of docs are each taken.

    A row's size is its words (null text: none). Each row of a source gets
    target / source_size copies in expectation: the whole part for certain and
    the fraction by pivotal rounding, in which rows of like size meet first,
    so a source's words come near its target. Rows that are equal (doc_id,
    source, text) are dealt the whole part of what they get together, as evenly
    as can be, and only the rest meets the tree; where their copies differ they
    have two result rows. copies never exceeds `most`. The outcome depends on
    the rows alone: reruns agree, whatever the partitioning. A null doc_id and
    a null source are values like any other; texts may be of any length, and
    texts of one doc_id and source are told apart by 64 bits of their hashes.
    No rows: no rows. Other columns are not read.
    """
    size = F.size(words(F.col("text"))).cast("long")
    rows = docs.select("doc_id", "source", _row_hash().alias("row_hash"), size.alias("size"))
    rows = cut(rows.groupBy("doc_id", "source", "row_hash", "size").agg(F.count("*").alias("rows")))
    totals = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("units")))
    aims = targets(totals.select("source", "source_size"), weights, most)
    sources = cut(aims.join(totals.select(F.col("source").alias("of"), "units"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    known = sources.withColumnRenamed("source", "of").withColumn("share", share)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # What equal rows get together; `even` copies go to each of them, and `over` of them get one more.
    together = F.col("share") * F.col("rows")
    rows = rows.withColumn("whole", F.floor(together).cast("long")).withColumn("p", together - F.col("whole"))
    # A large source is dealt out by classes of sizes within a quarter of each other, and what they leave open meets in one more tree.
    grade = F.when(F.col("units") > BLOCK, F.floor(3 * F.log2(F.col("size") + 1)).cast("int")).otherwise(0)
    units = rows.where((F.col("p") > 0) & (F.col("size") > 0)).select(
        F.struct("source", grade.alias("grade")).alias("source"), _node(F.col("doc_id"), F.col("row_hash")).alias("id"), "p", (-F.col("size")).alias("order"))
    found = _by_grade(cut(units)).withColumnsRenamed({"source": "_of", "id": "_id"})
    rows = rows.withColumn("id", _node(F.col("doc_id"), F.col("row_hash")))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")), "left")
    taken = F.col("whole") + F.coalesce("one", F.lit(0))
    even = F.floor(taken / F.col("rows")).cast("int")
    over = taken - even * F.col("rows")
    dealt = F.array(F.struct((even + 1).alias("copies"), over.alias("rows")), F.struct(even.alias("copies"), (F.col("rows") - over).alias("rows")))
    out = out.withColumn("dealt", F.explode(F.filter(dealt, lambda d: d["rows"] > 0)))
    return out.select("doc_id", "row_hash", "size", "source", "source_size", "target", "dealt.copies", "dealt.rows")


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _by_grade(units: DataFrame) -> DataFrame:
    """(source, id, one): first each (source, grade) in blocks, then what those leave open, for each source, in the reduction tree."""
    per_grade = units.groupBy("source").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    sized = units.join(per_grade.select(F.col("source").alias("of"), blocks.alias("blocks")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    done = cut(_level(sized, block))
    node = _node(F.concat(F.lit("grade "), F.col("source.grade").cast("string")), F.col("up"))
    left = done.where("left is not null").select(F.col("source.source").alias("source"), node.alias("id"), F.col("left").alias("p"), "order")
    most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    above = _decide(left, most).select(F.col("source").alias("_of"), F.col("id").alias("node"), F.col("one").alias("above"))
    opened = done.where("left is not null").withColumn("_node", node).join(above, F.col("_node").eqNullSafe(F.col("node")) & F.col("source.source").eqNullSafe(F.col("_of")))
    return done.where("left is null").select("source.source", "id", "one").unionByName(opened.select("source.source", "id", F.col("above").alias("one")))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, in the columns of docs. Rows with no words are never taken.

    Equal rows (doc_id, source, text) are numbered only where there are several
    of them, in the order of a hash of the row.
    """
    found = mix(docs).where("size > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("row_hash").alias("_row"), "copies", "rows")
    # One row for each set of equal rows: the first `_over` of `_rows` get `_more` copies, the rest `_even`.
    found = found.groupBy("_id", "_of", "_row").agg(F.sum("rows").alias("_rows"), F.min("copies").alias("_even"), F.max("copies").alias("_more"), F.max_by("rows", "copies").alias("_over")).where("_more > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_row"))
    met = docs.withColumn("_hash", _row_hash()).join(found, same)
    alone = met.where(F.col("_even") == F.col("_more")).withColumn("_n", F.col("_more"))
    turn = F.row_number().over(W.partitionBy("_id", "_of", "_row").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))))))
    several = met.where(F.col("_even") < F.col("_more")).withColumn("_n", F.when(turn <= F.col("_over"), F.col("_more")).otherwise(F.col("_even"))).where("_n > 0")
    out = alone.unionByName(several)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*(F.col(f"`{c}`") for c in docs.columns))
