"""Tables that are published whole or not at all: a staged write, then one small file that names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file that names the version which counts.
CURRENT = "_CURRENT"


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, folder: str) -> str:
    """Writes a version that does not count yet, and returns its name."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return name


def commit(spark: SparkSession, folder: str, name: str) -> None:
    """Makes a staged version the one that counts. Its name goes to a file of its own, which then takes the place of the old
    one by a rename, so that a reader finds the old version or the new one, whole."""
    jvm, fs = _files(spark, folder)
    part, current = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f"{CURRENT}.{uuid.uuid4().hex}.part", CURRENT))
    out = fs.create(part, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(current), options)


def publish(df: DataFrame, folder: str) -> None:
    """A write that is killed before its end leaves the version before it readable."""
    commit(df.sparkSession, folder, staged(df, folder))


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the version that counts, or None if there is none that can be read."""
    jvm, fs = _files(spark, folder)
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}")
    if not fs.exists(at):
        return None
    found = fs.open(at)
    try:
        name = bytes(found.readAllBytes()).decode()
    finally:
        found.close()
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    return name if name and fs.exists(done) else None


def published(default: DataFrame, folder: str) -> DataFrame:
    """The version that counts, in the columns of `default`; `default` itself where none can be read. A column that an older
    version lacks is null."""
    name = current(default.sparkSession, folder)
    return default if name is None else default.sparkSession.read.schema(default.schema).parquet(f"{folder}/{name}")
