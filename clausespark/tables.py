"""Tables in the folder that driver and executors share, and connected components of links."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where that is unset, the checkpoint folder of the session.

    In local mode, where driver and executor are one, a temporary folder is set if neither is; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clausespark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go at its end, rather than once the driver's JVM has collected its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str, group: int | None = None) -> DataFrame:
    """df written as a table and read again; its shuffle files are gone then, as nothing but the table is read later.

    group: so many rows at most are written, and read, at once. Parquet looks at the size of what it holds after 100 rows only.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer if group is None else writer.option("parquet.block.row.count.limit", group)).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again; cuts the lineage and survives lost executors."""
    return _written(df, new_path(df.sparkSession, name))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n partitions, so that rows dealt by them with repartition(n, key) fill each by one key alone."""
    if n > 10_000:
        return list(range(n))  # keys share partitions then
    tried = 20 * n
    while True:
        own = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("key")).collect()
        if len(own) == n:
            return [r.key for r in own]
        tried *= 4


class Scratch:
    """Tables in the shared folder that go once what needs them is stored."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, name: str, group: int | None = None) -> DataFrame:
        """As stored(), until clear(); rows of megabytes are written `group` at once."""
        spark = df.sparkSession
        path = new_path(spark, name)
        self.paths.append((spark, path))
        return _written(df, path, group)

    def clear(self) -> None:
        for spark, path in self.paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges, component being the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots, and contracts
    the edges to roots; rounds go on until no edge between different roots is left. Nothing is collected but the
    number of edges left, and no table is broadcast, as compressed files say little of the memory that takes in the driver. Edges with a null end and loops are ignored, and so are repeated edges.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    scratch, last = Scratch(), Scratch()
    e = scratch.stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    label: DataFrame | None = None
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
        hook = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
        hook = scratch.stored(hook, "cc-hook")
        while True:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = hook.hint("merge").join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
            jumped = scratch.stored(jumped, "cc-jump")
            hook = jumped.select("node", "parent")
            if not jumped.where("moved").limit(1).count():
                break
        if label is None:
            label = hook.select("node", F.col("parent").alias("component"))
        else:
            root = hook.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            label = label.join(root.hint("merge"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        before, last = last, Scratch()
        label = last.stored(label, "cc-label")
        before.clear()
        ra = hook.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rb = hook.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        e = e.join(ra.hint("merge"), "a").join(rb.hint("merge"), "b").where("ra <> rb")
        after = Scratch()
        e = after.stored(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        more = e.limit(1).count()
        scratch.clear()
        if not more:
            after.clear()
            return label
        scratch = after


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the running sum of value by key in an order; rows equal in order count one after another.

    Ranges of keys and order are summed apart and then added up, so a key with any number of rows is no single task's.
    """
    ranged = rows.withColumn(name, value.cast("long")).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    total = F.sum(name).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    named = [f"__k{i}" for i in range(len(keys))]
    sums = ranged.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("__part").alias("__p")).agg(F.sum(name).alias("__sum"))  # a row for each key and range
    before = F.sum("__sum").over(Window.partitionBy(*named).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__sum")
    same = (F.col("__part") == F.col("__p")) & reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)])
    joined = ranged.withColumn("__own", total).join(sums, same)
    return joined.select(*[F.col(c) for c in rows.columns if c != name], (F.col("__own") + F.col("__before")).alias(name))
