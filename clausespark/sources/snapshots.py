"""Tables that are replaced as a whole or by key, so that readers see the old rows or the new ones and never a part of either.

A snapshot is a folder of its own, and a small file names the current one. It is written beside the old name and renamed over it
once all rows are there, so a write that breaks off leaves the old snapshot as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _context(spark: SparkSession, path: str):
    p, _ = _at(spark, path)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current snapshot under path, None before the first."""
    p, fs = _at(spark, f"{path}/{POINTER}")
    return spark.read.text(f"{path}/{POINTER}").first().value if fs.exists(p) else None


def publish(df: DataFrame, path: str, format: str = "parquet", keep: int = 1) -> str:
    """Write df as the new snapshot under path; the `keep` snapshots before it stay for readers that have begun, older ones go."""
    spark = df.sparkSession
    before, name = current(spark, path), f"at={uuid.uuid4().hex}"
    df.write.format(format).save(f"{path}/{name}")
    _point(spark, path, name)
    p, fs = _at(spark, path)
    old = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("at=") and s.getPath().getName() not in (name, before)), key=lambda s: -s.getModificationTime())
    for s in old[max(0, keep - 1) :]:
        fs.delete(s.getPath(), True)
    return name


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm = spark.sparkContext._jvm
    new, fs = _at(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    _context(spark, path).rename(new, _at(spark, f"{path}/{POINTER}")[0], options)


def published(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of the current snapshot under path."""
    name = current(spark, path)
    if name is None:
        raise ValueError(f"nothing is published under {path}")
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{name}")


def replace_keys(spark: SparkSession, path: str, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The published table with the rows of changed keys taken out and new rows put in, published; a key may only go."""
    publish(published(spark, path).join(changed, key, "left_anti").unionByName(new), path)
    return published(spark, path)
