"""Where snapshots of scratch collections and stored intermediate rows go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import fail


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        fail("CAP_UNSUPPORTED_FEATURE", "a cluster needs spark.checkpoint.dir, a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="lodestone-")).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written below the shared folder and read again: later reads see the same rows and places, also after an executor is lost."""
    folder = f"{scratch(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _file(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, which only one writer can; False if it exists."""
    fs, at = _file(spark, path)
    try:
        out = fs.create(at, False)
    except Exception:
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True
