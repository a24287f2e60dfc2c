"""Streams over task events, changed clauses and review rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausespark.functions.text import chunks, plain_text, tokenize
from clausespark.sources.readers import scratch
from clausespark.tables import Scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LIFECYCLE = "task_id bigint, status string, outcome string, ms bigint"


class TaskTimer(StatefulProcessor):
    """A task's status and the time of its last event, with a timer for how long it may stay so; both go once the timer fires."""

    def __init__(self, keep_ms: dict[str, int]):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, at = self.task.get() if self.task.exists() else ("", -1)
        watermark = timerValues.getCurrentWatermarkInMs()
        for b in rows:
            for s, t in zip(b["status"], b["ms"], strict=True):
                if t >= max(at, watermark):
                    status, at = s, int(t)
        if at < 0:
            return iter([])  # nothing but late events
        self.task.update((status, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in self.keep_ms:
            self.handle.registerTimer(max(at + self.keep_ms[status], watermark + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, at = self.task.get()
        self.task.clear()
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "outcome": ["drop_files" if status == "review_needed" else "drop_row"], "ms": [at]})

    def close(self) -> None:
        pass


def task_lifecycle(events: DataFrame, late: str = "1 hour", terminal_s: int = 1800, review_s: int = 86_400) -> DataFrame:
    """(task_id, status, outcome, ms): tasks that stayed in a state for longer than it may last.

    events: a stream of task_id, status, ts (timestamp). A task waits for review a day and stays done or failed for half
    an hour of event time, then it is dropped once; events older than the watermark do not count. State and timers are in
    the RocksDB store, so run this with rocksdb_state.
    """
    keep = {"review_needed": review_s * 1000, "done": terminal_s * 1000, "error": terminal_s * 1000}
    e = events.select("task_id", "status", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return e.groupBy("task_id").transformWithStateInPandas(TaskTimer(keep), LIFECYCLE, "Append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in the RocksDB store, as timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def upkeep_index(changes: DataFrame, path: str, checkpoint: str, encoder: Callable[[DataFrame, str, str], DataFrame], limit: int = 512):
    """Keep postings, chunks and vectors of clauses under path up to date with a stream of changes.

    changes: clause_id, version, text, deleted; of a clause's changes in a batch that of the largest version counts. Tables are
    clauses (clause_id, batch, deleted), postings (clause_id, token, tf, batch) and chunks (clause_id, chunk_index, chunk,
    embedding, batch), a folder for each batch, written anew if the batch is run again. The batch's clauses come last: until
    they are there, readers take what earlier batches have. encoder: (df, id_col, text_col) -> (id, embedding).
    """

    def write(df: DataFrame, batch: int) -> None:
        put = lambda t, name: t.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/{name}/at={batch}")
        kept = Scratch()
        last = df.groupBy("clause_id").agg(F.max_by(F.struct("text", F.coalesce("deleted", F.lit(False)).alias("deleted")), "version").alias("c")).select("clause_id", "c.*")
        last = kept.stored(last, "last-changes")  # the stream is read once a batch
        live = last.where("not deleted").select("clause_id", "text")
        put(live.select("clause_id", F.explode(tokenize("text")).alias("token")).groupBy("clause_id", "token").agg(F.count("*").alias("tf")), "postings")
        # cut once for the encoder and the rows
        plain = live.select("clause_id", plain_text("text").alias("plain"))  # a column of its own, as chunks() takes it several times
        pieces = plain.select("clause_id", F.posexplode(chunks("plain", limit)).alias("chunk_index", "chunk")).withColumn("key", F.concat_ws("#", "clause_id", "chunk_index"))
        pieces = kept.stored(pieces, "pieces")
        put(pieces.join(encoder(pieces, "key", "chunk"), "key", "left").drop("key"), "chunks")
        put(last.select("clause_id", "deleted"), "clauses")
        kept.clear()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of postings or chunks of each clause's last batch; of deleted clauses none."""
    last = spark.read.parquet(f"{path}/clauses").groupBy("clause_id").agg(F.max_by("deleted", "batch").alias("deleted"), F.max("batch").alias("batch")).where("not deleted").drop("deleted")
    return spark.read.parquet(f"{path}/{name}").drop("at").join(last, ["clause_id", "batch"]).drop("batch")


def pending_counters(rows: DataFrame) -> DataFrame:
    """(dimension, status, n) of a stream of review rows."""
    return rows.groupBy("dimension", "status").count().withColumnRenamed("count", "n")


def run_to_table(stream: DataFrame, mode: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """All that is available now, run to the end; the rows written, those of the last batch in complete mode."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/data/__at={batch}")

    prepare(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("__batch").alias("__batch")), "__batch")
    return rows.drop("__batch", "__at")
