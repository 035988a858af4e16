"""Expressions and helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where driver and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def beside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs as the used columns and a struct of the rest, and what brings all columns back in order under their own names."""
    rest = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("_rest"))
    return packed, [F.col(f"`{c}`") if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet below the shared folder and read again: its lineage is cut, and what a lost executor held is read again.

    Work before it keeps its own partitions; those without rows leave no file.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


cut = stored

#: A key with more than a thousandth of the rows is hot: of such keys there are a thousand at most.
HOT_SHARE, HOT_ROWS = 1000, 100_000


def join_counted(rows: DataFrame, groups: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined with groups, which has one row for each key and its number of rows in `rows` as column n.

    A shuffled join would deal all rows of a hot key to one task, and Spark can't
    split it where the groups were aggregated by the same key. So the groups of
    keys with over a thousandth of all `total` rows, a thousand at most, are
    broadcast; the rest are joined by key. Few rows need neither.
    """
    if total < HOT_ROWS:
        return rows.join(groups, key)
    hot = groups.where(F.col(n) * HOT_SHARE > total)
    if hot.isEmpty():
        return rows.join(groups, key)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(n) * HOT_SHARE <= total), key)
    return met.unionByName(rest)
