"""A change log applied to a snapshot collection, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import paths
from ..errors import fail
from ..sources.collections import MOST_DELTAS, Database

OPERATIONS = ("upsert", "delete")


def apply_batch(db: Database, name: str, changes: DataFrame) -> int:
    """Apply changes (op, seq and the collection's columns): of each id the change with the highest seq ever seen counts.

    One aggregation by id picks a batch's last change. The seq that an id has
    reached is kept beside the collection, deletes included, so a batch that
    comes late or twice changes nothing that a later change decided. What is
    written is in proportion to the batch. Returns the version.
    """
    source = db.source(name)
    (key,) = source.id
    if not {"op", "seq", key} <= set(changes.columns):
        fail("VAL_INVALID_SHAPE", "changes have op, seq and the id")
    columns = source.shown().columns
    last = changes.groupBy(key).agg(F.max(F.col("seq").cast("long")).alias("seq"), F.max_by(F.struct("op", *(c for c in columns if c != key)), F.col("seq").cast("long")).alias("c"))
    marks = db.manifests[name].marks
    if marks:
        seen = db.spark.read.parquet(*marks).groupBy(key).agg(F.max("seq").alias("__seen"))
        last = last.join(seen, key, "left").where("__seen is null or seq > __seen").drop("__seen")
    held = db._write(name, "batch", last)
    last = db.spark.read.schema(last.schema).parquet(held)
    if last.isEmpty():
        return db.version(name)
    new = last.where(F.col("c.op") == "upsert").select(*(F.col(key) if c == key else F.col(f"c.`{c}`").alias(c) for c in columns))
    if paths.SEEN in source.df.columns:  # a change brings all its fields
        later = [f"+{f.name}" for f in source.df.schema if f.metadata.get(paths.PRESENCE) == "+"]
        new = new.withColumn(paths.SEEN, F.array(*(F.lit(x) for x in later)).cast("array<string>"))
    mark = db._write(name, "mark", last.select(key, "seq"))
    if len(marks) >= MOST_DELTAS:
        mark = db._write(name, "mark", db.spark.read.parquet(*marks, mark).groupBy(key).agg(F.max("seq").alias("seq")))
        marks = []
    db._append(name, db._write(name, "part", new), db._write(name, "gone", last.select(key)), marks=[*marks, mark])
    return db.version(name)


def follow(db: Database, name: str, changes: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that applies a stream of changes; a batch that comes again changes nothing, as it is applied by id and seq."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(db, name, df) and None)
