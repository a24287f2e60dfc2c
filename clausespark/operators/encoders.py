"""Plug points: functions from batches of texts to vectors, and from pairs to scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.functions.text import tokenize


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(id, embedding) by an encoder that turns a list of texts into rows of floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "embedding": list(np.asarray(encoder([t or "" for t in b[text_col]]), np.float32))})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>")


def token_weights(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, weight): the inverse document frequency of every token, ln((n + 1) / (df + 1)) of n rows of which df have it."""
    seen = df.select(id_col, F.explode(F.array_distinct(tokenize(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    return seen.join(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("weight"))  # one row


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dims: int = 512, weights: DataFrame | None = None) -> DataFrame:
    """The built-in encoder: signed hashing of token counts, of length 1 (all zeros without tokens).

    Where all slots cancel, as two tokens of one slot and unlike signs can, the counts are taken without signs.

    With weights (token, weight), as token_weights has them, each token counts by its weight; unknown ones count by the largest.

    Texts are shuffled by id before they are cut, so counts and vectors are made where they are; tokens are counted by row
    before they meet weights, and go back to their rows in one shuffle. A row's slots are set in its vector one by one.
    """
    parts, most_rows = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, (1 << 20) // dims)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, embedding array<double>"
    texts = df.select(id_col, text_col).repartition(parts, id_col)
    slot_of, negative = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"), lambda t: F.pmod(F.hash(t), F.lit(2)) != 0

    def vectors(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims), pa.array(v.ravel()))
        return pa.RecordBatch.from_arrays([ids, lists], [id_col, "embedding"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one id are one after another; the last id of what is taken at once may go on."""
        held = None

        def made(ids, x, y):
            some = y.any(axis=1)
            signed = x.any(axis=1)[:, None]
            v = np.where(signed, x, y)[some]
            return vectors(ids.filter(pa.array(some)), v / np.sqrt((v * v).sum(axis=1))[:, None])

        for b in (b.slice(s, most_rows) for b in batches for s in range(0, b.num_rows, most_rows)):
            ids, code = b.column(0), b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh = np.r_[True, code[1:] != code[:-1]]
            n = pc.list_value_length(b.column("slots")).to_numpy()
            slots = b.column("slots").flatten().to_numpy().astype(np.int64)  # -1 and below: of sign -1
            at = np.repeat(np.cumsum(fresh) - 1, n) * dims + np.where(slots < 0, ~slots, slots)
            x, y = (np.bincount(at, w, fresh.sum() * dims).reshape(-1, dims) for w in (np.where(slots < 0, -1.0, 1.0), None))
            ids = ids.take(pa.array(np.flatnonzero(fresh)))
            if held is not None:
                if held[0][0].as_py() == ids[0].as_py():
                    x[0] += held[1][0]
                    y[0] += held[2][0]
                else:
                    yield made(*held)
            held = ids[-1:], x[-1:].astype(np.float64), y[-1:].astype(np.float64)
            if len(ids) > 1:
                yield made(ids[:-1], x[:-1].astype(np.float64), y[:-1].astype(np.float64))
        if held is not None:
            yield made(*held)

    if weights is None:
        slots = F.transform(tokenize(text_col), lambda t: F.when(negative(t), F.bitwise_not(slot_of(t))).otherwise(slot_of(t)))
        return texts.select(id_col, slots.alias("slots")).sortWithinPartitions(id_col).mapInArrow(counted, schema)
    tokens = texts.select(id_col, F.explode(tokenize(text_col)).alias("token"))
    most = weights.agg(F.max("weight").alias("most"))
    tokens = tokens.groupBy(id_col, "token").agg(F.count("*").alias("n"))
    tokens = tokens.join(weights, "token", "left").join(F.broadcast(most)).withColumn("weight", F.coalesce("weight", "most"))  # one row
    sign = F.when(negative("token"), -1.0).otherwise(1.0)
    tokens = tokens.select(id_col, slot_of("token").alias("slot"), sign.alias("sign"), (F.col("n") * F.col("weight")).alias("size")).repartition(parts, id_col)
    counts = tokens.groupBy(id_col, "slot").agg(F.sum(F.col("sign") * F.col("size")).alias("x"), F.sum("size").alias("y"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    packed = counts.groupBy(id_col).agg(F.collect_list(F.struct("slot", "x", "y")).alias("slots"), norm("x").alias("nx"), norm("y").alias("ny"))
    # weighted sums that cancel may leave some of their last digits
    none = F.col("nx") <= 1e-12 * F.col("ny")
    least = lambda c: F.greatest(F.col(c), F.lit(1e-300))
    packed = packed.select(id_col, F.col("slots.slot").alias("slot"), F.when(none, F.col("slots.y")).otherwise(F.col("slots.x")).alias("value"), F.when(none, least("ny")).otherwise(least("nx")).alias("norm"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(s, most_rows) for b in batches for s in range(0, b.num_rows, most_rows)):
            slots, n = b.column("slot"), pc.list_value_length(b.column("slot")).to_numpy()
            v = np.zeros((b.num_rows, dims))
            v[np.repeat(np.arange(b.num_rows), n), slots.flatten().to_numpy()] = b.column("value").flatten().to_numpy() / np.repeat(b.column("norm").to_numpy(), n)
            yield vectors(b.column(0), v)

    return packed.mapInArrow(filled, schema)


def score_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, pair_scorer: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """(keys, pair_score) by a scorer that turns two lists of texts into floats; a scorer that fails gives null scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                s = np.asarray(pair_scorer([t or "" for t in b[left]], [t or "" for t in b[right]]), np.float64)
            except Exception:  # the next level of the cascade takes over, whatever the model's trouble
                s = np.full(len(b), np.nan)
            yield b[keys].assign(pair_score=pd.Series(s, index=b.index).astype(object).where(np.isfinite(s), None))

    types = dict(pairs.dtypes)
    return pairs.select(*keys, left, right).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "pair_score double"]))
