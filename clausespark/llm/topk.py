"""Operator 8: exact top-k by inner product with block-at-a-time pruning.

Candidates are packed in id order into tiles, each tile a row with a forward index of document-range blocks and, for
every term, the largest and smallest weight in each block. Every tile of queries meets every tile of candidates through
an equi-join on slots, which hold several tiles each, so queries are copied once a slot. There each query bounds every block by
its summed term maxima, scores blocks in that order through the forward index, and stops once the next bound is below its k-th
score. Of a slot's tiles each query hands on its k best candidates.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausespark.llm.common import stored

TILE, BLOCK, QUERIES = 8192, 64, 512
#: Slots if there are as many tiles, and tiles of a slot at most where that makes more.
SLOTS, SLOT_TILES = 24, 64
_PACK = "part int, number int, n int, dims int, ids binary, weights binary, kind string"
_FOUND = "query_part int, query_number int, query_at int, query_id long, vec_id long, score long"


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector without null, NaN or infinite components."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def _packed(rows: DataFrame, most: int, scale: float) -> DataFrame:
    """Runs of at most `most` vectors of each partition as one row each; weights are floor(scale * x)."""

    def pack(batches):
        from pyspark import TaskContext

        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def close():
            dims = max(map(len, vectors))
            w = np.zeros((len(vectors), dims), np.int64)
            for i, v in enumerate(vectors):
                w[i, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
            # the fewest bytes that hold all
            low, high = int(w.min(initial=0)), int(w.max(initial=0))
            kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return pd.DataFrame({"part": [part], "number": [number], "n": [len(ids)], "dims": [dims], "ids": [np.array(ids, np.int64).tobytes()], "weights": [w.astype(kind).tobytes()], "kind": [kind]})

        for b in batches:
            for i, v in zip(b["id"], b["v"], strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == most:
                    yield close()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield close()

    return rows.mapInPandas(pack, _PACK)


class Tile:
    """Candidates with their block maxima and minima; dims: the terms to hold at least."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, dims: int, block: int = BLOCK):
        self.ids, self.weights = ids, np.pad(weights, ((0, 0), (0, max(0, dims - weights.shape[1]))))
        self.starts = np.arange(0, len(ids), block)
        self.block = block
        self.top = np.maximum.reduceat(self.weights, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.weights, self.starts, axis=0)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the places of its k best candidates here, ties to the smaller id, never its own id; and scores."""
        queries = np.pad(queries, ((0, 0), (0, self.weights.shape[1] - queries.shape[1])))
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(self.weights).max(initial=0)) * self.weights.shape[1]
        kind = np.float64 if largest < 2.0**53 else np.int64  # both are exact here
        q, w = queries.astype(kind), self.weights.astype(kind)
        bound = np.maximum(q, 0) @ self.top.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        order = np.argsort(-bound, axis=1, kind="stable")
        least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        scores = np.full((len(q), len(self.ids)), least, kind)
        kth = np.full(len(q), least, kind)
        scored = np.zeros((len(q), len(self.ids)), bool)
        active, done, wave = np.arange(len(q)), 0, 1
        while len(active) and done < len(self.starts):
            upto = min(done + wave, len(self.starts))
            blocks = order[active, done:upto]
            need = np.take_along_axis(bound[active], blocks, 1) >= kth[active, None]
            who, which = np.nonzero(need)
            block_of = blocks[who, which]
            by = np.argsort(block_of, kind="stable")
            who, block_of = active[who[by]], block_of[by]
            cuts = np.flatnonzero(np.r_[True, block_of[1:] != block_of[:-1]]) if len(block_of) else np.zeros(0, np.int64)
            for s, e in zip(cuts, [*cuts[1:], len(block_of)], strict=True):
                a = self.starts[block_of[s]]
                z = min(a + self.block, len(self.ids))
                got, rows = q[who[s:e]] @ w[a:z].T, who[s:e]
                other = query_ids[rows, None] != self.ids[None, a:z]
                scores[rows, a:z] = np.where(other, got, least)
                scored[rows, a:z] = other
            if len(self.ids) > k:
                kth[active] = np.partition(scores[active], len(self.ids) - k, axis=1)[:, len(self.ids) - k]
            done, wave = upto, wave * 4
            if done < len(self.starts):
                active = active[np.take_along_axis(bound[active], order[active, done : done + 1], 1)[:, 0] >= kth[active]]
        out = []
        for i in range(len(q)):
            at = np.flatnonzero(scored[i] & (scores[i] >= kth[i]))
            at = at[np.lexsort((self.ids[at], -scores[i, at]))[:k]]
            out.append((at, scores[i, at].astype(np.int64)))
        return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), ties to the smaller id.

    A candidate with the query's own id takes no part, nor do rows with a null id, a null vector, or a null, NaN or
    infinite component. Shorter vectors count as if filled up with zeros. A repeated query row has its k rows again, a
    repeated candidate row is a candidate again. Other columns are left out; either side may be empty.
    """
    c, q = _vectors(candidates, id_col, vector_col), _vectors(queries, id_col, vector_col)
    parts = max(1, ceil(c.count() / TILE))
    slots = max(min(parts, SLOTS), ceil(parts / SLOT_TILES))
    tiles = stored(_packed(c.repartitionByRange(parts, "id").sortWithinPartitions("id"), TILE, scale), "tiles").withColumn("slot", F.pmod("part", F.lit(slots)))
    asked = stored(_packed(q.repartition(max(1, ceil(q.count() / QUERIES))), QUERIES, scale), "queries")
    asked = asked.select(*[F.col(x).alias(f"query_{x}") for x in ("part", "number", "dims", "ids", "weights", "kind")], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))

    def arrays(ids, weights, kind, dims):
        return np.frombuffer(ids, np.int64), np.frombuffer(weights, kind).reshape(-1, dims).astype(np.int64)

    def search(batches):
        pack, query_ids, own, held = None, None, None, []

        def best():
            at, ids, scores = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((ids, -scores, at))
            at, ids, scores = at[by], ids[by], scores[by]
            top = np.arange(len(at)) - np.searchsorted(at, at) < k
            return at[top], ids[top], scores[top]

        def cut():
            at, ids, scores = best()
            return pd.DataFrame({"query_part": pack[0], "query_number": pack[1], "query_at": at, "query_id": query_ids[at], "vec_id": ids, "score": scores})

        # rows of a pack of queries follow each other in a join; where they do not, the rank below merges them
        for b in batches:
            for r in b.itertuples():
                if pack != (r.query_part, r.query_number):
                    if held:
                        yield cut()
                    pack, held = (r.query_part, r.query_number), []
                    query_ids, own = arrays(r.query_ids, r.query_weights, r.query_kind, r.query_dims)
                ids, weights = arrays(r.ids, r.weights, r.kind, r.dims)
                found = Tile(ids, weights, r.query_dims).best(query_ids, own, k)
                places = np.concatenate([x for x, _ in found]).astype(np.int64)
                held.append((np.repeat(np.arange(len(own)), [len(x) for x, _ in found]), ids[places], np.concatenate([x for _, x in found])))
                if len(held) == 16:
                    held = [best()]
        if held:
            yield cut()

    # never broadcast: files say little of what copies of packs take
    found = asked.hint("merge").join(tiles, "slot").mapInPandas(search, _FOUND)
    w = Window.partitionBy("query_part", "query_number", "query_at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth embedding against all others, by the contract of operator 8."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(e.where(F.col("vec_id") % 20 == 0), e)


OP8_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.w, c.w)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
