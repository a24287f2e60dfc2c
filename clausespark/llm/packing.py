"""Operator 2: optimal length buckets and token-budget batches.

A global histogram of lengths is bounded whatever the data, so the driver can choose the bucket boundaries that pad
least by dynamic programming. Documents are then numbered within their bucket by a range partition and the counts of
the partitions before, and a batch takes as many as its token budget holds at the bucket's padded length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausespark.llm.common import WORD, documents, shuffle_partitions, stored

#: Lengths up to EXACT have a histogram cell each; longer ones share 64 cells an octave and pad to the cell's end.
EXACT = 65_536
_ROWS = "doc_id string, n_tokens long, cell long, bucket int, part int, place long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_cell(n: Column) -> Column:
    """The histogram cell of a length: the largest length in it."""
    step = F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) * 64) / 64)).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.greatest(step, n))


def optimal_boundaries(cells: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` boundaries with the least sum of padded lengths; cells ascend.

    A bucket from cell i+1 to j costs cells[j] for each document in it. That cost is Monge, so the best split only moves
    to the right, and each layer is filled by halving.
    """
    m = len(cells)
    if not m:
        return []
    size = np.maximum(cells.astype(np.float64), 1)
    total = np.concatenate(([0], np.cumsum(counts.astype(np.float64))))
    best = size * total[1:]
    cuts = []
    for _ in range(min(buckets, m) - 1):
        new, cut = np.empty(m), np.zeros(m, np.int64)
        before = np.concatenate(([0.0], best))
        todo = [(0, m - 1, 0, m)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(j, b)
            costs = before[a : end + 1] + size[j] * (total[j + 1] - total[a : end + 1])
            k = a + int(np.argmin(costs))
            new[j], cut[j] = costs[k - a], k
            todo += [(lo, j - 1, a, k), (j + 1, hi, k, b)]
        best = new
        cuts.append(cut)
    out, j = [], m - 1
    for cut in [*reversed(cuts), np.zeros(m, np.int64)]:
        out.append(int(cells[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack_documents(docs: DataFrame, buckets: int = 8, budget: int = 65_536, length: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot) of every document.

    length: its tokens (words of `text` by default). bucket_tokens is the length that the documents of a bucket are
    padded to (above EXACT tokens the end of the length's cell); a batch holds budget // bucket_tokens documents, one at
    least, in doc_id order, so documents longer than the budget are alone in theirs. Null texts have 0 tokens and are
    packed as well; null ids come first; repeated rows have a slot each. Other columns are left out.
    """
    spark = docs.sparkSession
    n = word_count(F.col("text")) if length is None else length
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n_tokens"))
    sized = stored(sized.withColumn("cell", length_cell(F.col("n_tokens"))), "lengths")
    # bounded by EXACT and 64 cells for each octave above
    histogram = sized.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
    ends = optimal_boundaries(np.array([r.cell for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), buckets)
    bucket, wide = F.lit(len(ends) - 1), F.lit(ends[-1] if ends else 0).cast("long")
    for i in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("cell") <= ends[i], i).otherwise(bucket)
        wide = F.when(F.col("bucket") == i, F.lit(ends[i]).cast("long")).otherwise(wide)

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            b["part"] = part
            b["place"] = b.groupby("bucket").cumcount() + b["bucket"].map(lambda x: seen.get(x, 0))
            for x, k in b["bucket"].value_counts().items():
                seen[x] = seen.get(x, 0) + k
            yield b

    ranged = sized.withColumn("bucket", bucket.cast("int")).repartitionByRange(shuffle_partitions(spark), "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id")
    placed = stored(ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "n_tokens", "cell", "bucket").mapInPandas(number, _ROWS), "places")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bucket and partition at most
    offsets = placed.groupBy("bucket", "part").agg(F.count("*").alias("n")).select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    at = F.col("offset") + F.col("place")
    out = placed.join(F.broadcast(offsets), ["bucket", "part"]).withColumn("bucket_tokens", wide).withColumn("capacity", capacity).withColumn("at", at)
    return out.select(F.col("doc_id").cast("long").alias(id_col), "n_tokens", "bucket", "bucket_tokens", F.expr("at div capacity").alias("batch"), F.expr("at % capacity").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed by its words into 8 buckets and batches of 65,536 tokens."""
    return pack_documents(documents(spark, sf_dir))
