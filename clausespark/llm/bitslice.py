"""Operator 12: ranked lexical search over bit-sliced Bloom signatures.

Documents of about as many terms form blocks, a row each. A block has a bit matrix of which each column is the Bloom filter of
one document, kept as slices: slice j tells which of the documents have bit j. A term's slices ANDed overestimate the documents
that hold it; filters also hold (term, 2, 4, ...) for terms that occur as often, so term counts are bounded from above too.
Sums of such slices, weighted by terms, bound the score of every document. A query scores documents in order of bounds through
the block's forward index and leaves out those only whose bound is below its k-th score.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import Scratch, documents, stored
from clausespark.tables import partition_keys

#: Documents of a block at most, documents dealt to blocks at once and different terms of those, bits of a block's matrix at most, but for a document alone.
BLOCK, HELD, HELD_TERMS, MATRIX = 1024, 8192, 1 << 22, 1 << 26
#: Terms whose hashes are remembered, places in filters that are made at once, texts taken from a batch at once, blocks written and read at once.
KNOWN, PLACES, TEXTS, GROUP = 1 << 17, 1 << 17, 256, 4
#: Bits of a filter for each of its keys, and hashes of a key.
BITS, HASHES = 8, 3
#: Term counts told apart: 1, 2, 4 and so on.
LEVELS = 5
#: Queries of a tile, documents scored before the first cut, bytes of blocks that a task holds, which sorting and Arrow hold several times, results merged at once.
TILE, FIRST, TASK_BYTES, FAN = 1024, 64, 16 << 20, 32
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCK = "slot_key long, docs long, total long, ids binary, lengths binary, vocabulary binary, df binary, starts binary, at binary, tf binary, bits int, slices binary"
_ASKED = "tile long, item_ids array<long>, counts binary, terms binary, repeats binary"
_BEST = "tile long, counts binary, ids binary, scores binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


class _Hashes(dict):
    """64-bit hashes of terms, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


def filter_places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The places (n, HASHES) of terms that occur 2 ** level times, in filters of so many bits."""
    g = (hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(31)
    low, step = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) % np.uint64(bits)).astype(np.int64)


def _pack(docs: list[tuple]) -> dict:
    """The row of a block of documents (id, length, hashes, counts)."""
    ids, lengths = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
    flat, tf = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    sizes = np.array([len(d[2]) for d in docs])
    row = np.repeat(np.arange(len(docs)), sizes)
    vocabulary, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    keys = np.zeros(len(docs), np.int64)
    for level in range(LEVELS):
        keys += np.bincount(row[tf >= 1 << level], minlength=len(docs))
    bits = int(BITS * keys.max())
    slices = np.zeros((bits, -(-len(docs) // 8)), np.uint8)
    for level in range(LEVELS):
        some = np.flatnonzero(tf >= 1 << level)
        for s in range(0, len(some), PLACES):
            own = some[s : s + PLACES]
            bit = (128 >> (row[own] & 7)).astype(np.uint8)
            places = filter_places(flat[own], level, bits)
            for i in range(HASHES):
                np.bitwise_or.at(slices, (places[:, i], row[own] >> 3), bit)
    small = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
    return {
        "docs": len(docs), "total": int(lengths.sum()), "ids": ids.tobytes(), "lengths": lengths.tobytes(), "vocabulary": vocabulary.tobytes(),
        "df": df.astype(np.uint32).tobytes(), "starts": np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes(), "at": at.astype(small).tobytes(),
        "tf": tf.astype(np.uint8 if tf.max() < 256 else np.uint32).tobytes(), "bits": bits, "slices": slices.tobytes(),
    }


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents with an id and a term, each with its documents' filters and forward index."""

    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int32() if t == "int" else pa.int64()) for n, t in (f.split() for f in _BLOCK.split(", "))])

    def run(batches):
        from pyspark import TaskContext

        number, hashes, held, size = TaskContext.get().partitionId() << 32, _Hashes(), [], 0

        def cut(held):
            nonlocal number
            held.sort(key=lambda d: len(d[2]))
            while held:
                n = 1
                while n < min(len(held), BLOCK) and (n + 1) * BITS * len(held[n][2]) <= MATRIX:
                    n += 1
                yield pa.RecordBatch.from_pylist([{"slot_key": number, **_pack(held[:n])}], schema)
                number, held = number + 1, held[n:]

        for at in (b.slice(s, TEXTS) for b in batches for s in range(0, b.num_rows, TEXTS)):
            for i, text in zip(at.column("id").to_pylist(), at.column("text").to_pylist(), strict=True):
                counted = Counter(terms_of(text))
                if counted:
                    tf = np.fromiter(counted.values(), np.int64, len(counted))
                    held.append((int(i), int(tf.sum()), np.fromiter(map(hashes.__getitem__, counted), np.uint64, len(counted)), tf))
                    size += len(tf)
                if len(held) == HELD or size >= HELD_TERMS:
                    yield from cut(held)
                    held, size = [], 0
        yield from cut(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    return rows.mapInArrow(run, _BLOCK)


def query_tiles(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Queries in tiles, a row each: their ids, their different terms and how often each is repeated."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for s in range(0, len(b), TILE):
                found = [Counter(terms_of(t)) for t in b["text"].iloc[s : s + TILE]]
                ids = [None if i is None else int(i) for i in b["id"].iloc[s : s + TILE]]
                terms = np.array([xxhash.xxh64_intdigest(t) for c in found for t in c], np.uint64)
                repeats = np.array([n for c in found for n in c.values()], np.int64)
                yield pd.DataFrame({"tile": [number], "item_ids": [ids], "counts": [np.array([len(c) for c in found], np.int64).tobytes()], "terms": [terms.tobytes()], "repeats": [repeats.tobytes()]})
                number += 1

    rows = queries.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.repartition(max(1, ceil(rows.count() / TILE))).mapInPandas(run, _ASKED)


class Block:
    """A block's row as arrays."""

    def __init__(self, row):
        self.ids, self.lengths, self.starts = (np.frombuffer(x, np.int64) for x in (row.ids, row.lengths, row.starts))
        self.vocabulary = np.frombuffer(row.vocabulary, np.uint64)
        self.at = np.frombuffer(row.at, np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32)
        self.tf = np.frombuffer(row.tf, np.uint8 if len(row.tf) == len(self.at) else np.uint32)
        self.bits = row.bits
        self.slices = np.frombuffer(row.slices, np.uint8).reshape(row.bits, -1)

    def presence(self, terms: np.ndarray) -> list[np.ndarray]:
        """For each level the documents (a bit each) that may hold the terms as often."""
        out: list[np.ndarray] = []
        for level in range(LEVELS):
            places = filter_places(terms, level, self.bits)
            found = self.slices[places[:, 0]]
            for i in range(1, HASHES):
                found = found & self.slices[places[:, i]]
            out.append(found & out[-1] if out else found)
        return out


class Tile:
    """Queries with the best documents found so far."""

    def __init__(self, counts: np.ndarray, terms: np.ndarray, repeats: np.ndarray, df: np.ndarray, docs: int, total: int, k: int):
        self.starts = np.r_[0, np.cumsum(counts)]
        self.terms, self.own = np.unique(terms, return_inverse=True)
        weight = np.array([floor(1000 * log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weights = weight[self.own] * repeats
        self.docs, self.total, self.k = docs, total, k
        self.least = np.ones(len(counts), np.int64)  # scores are above 0
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(counts)

    def offer(self, b: Block) -> int:
        """Score the documents of a block that bounds do not exclude; returns how many."""
        m = 75 + 25 * b.lengths * self.docs // self.total
        part = lambda tf, m: 1_000_000_000 * tf // (1000 * tf + 12 * m)
        caps = [part(np.minimum((2 << level) - 1, b.lengths), m) for level in range(LEVELS - 1)] + [part(b.lengths, m)]
        more = [x.astype(np.float64) for x in [caps[0], *[y - x for x, y in zip(caps, caps[1:], strict=False)]]]
        present = b.presence(self.terms)
        where = np.minimum(np.searchsorted(b.vocabulary, self.terms), len(b.vocabulary) - 1)
        held = b.vocabulary[where] == self.terms
        weight_of, scored = np.zeros(len(b.vocabulary), np.int64), 0

        def score(docs: np.ndarray) -> np.ndarray:
            sizes = b.starts[docs + 1] - b.starts[docs]
            row = np.repeat(np.arange(len(docs)), sizes)
            entry = np.arange(len(row)) + np.repeat(b.starts[docs] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            w = weight_of[b.at[entry]]
            some = w > 0
            row, w, tf = row[some], w[some], b.tf[entry[some]].astype(np.int64)
            out = np.zeros(len(docs), np.int64)
            np.add.at(out, row, w * part(tf, m[docs[row]]))
            return out

        for q in range(len(self.best)):
            own = self.own[self.starts[q] : self.starts[q + 1]]
            weights = self.weights[self.starts[q] : self.starts[q + 1]]
            bound = np.zeros(len(b.ids))  # sums stay under 2 ** 53, so they are exact
            for level in range(LEVELS):
                slices = present[level][own]
                some = slices.any(axis=1)
                if not some.any():
                    break
                bound += more[level] * (weights[some].astype(np.float64) @ np.unpackbits(slices[some], axis=1)[:, : len(b.ids)])
            open_ = np.flatnonzero(bound >= self.least[q])
            if not len(open_):
                continue
            here = held[own]
            weight_of[where[own[here]]] = weights[here]
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            n = FIRST
            while len(open_):
                now, open_ = open_[:n], open_[n:]
                got = score(now)
                scored += len(now)
                ok = got >= self.least[q]
                ids, scores = np.r_[self.best[q][0], b.ids[now[ok]]], np.r_[self.best[q][1], got[ok]]
                by = np.lexsort((ids, -scores))[: self.k]
                self.best[q] = ids[by], scores[by]
                if len(by) == self.k:
                    self.least[q] = max(1, scores[by[-1]])
                open_, n = open_[bound[open_] >= self.least[q]], 4 * n
            weight_of[where[own[here]]] = 0
        return scored

    def row(self, number: int) -> pd.DataFrame:
        counts = np.array([len(ids) for ids, _ in self.best], np.int64)
        ids, scores = (np.concatenate([x[i] for x in self.best]).astype(np.int64) for i in (0, 1))
        return pd.DataFrame({"tile": [number], "counts": [counts.tobytes()], "ids": [ids.tobytes()], "scores": [scores.tobytes()]})


def merged(rows: DataFrame, schema: str, combine, parts: int) -> DataFrame:
    """One row of each tile of rows: combine(pdf) makes a row of several, FAN at once."""
    while True:
        parts = max(1, ceil(parts / FAN))
        rows = rows.withColumn("fan", F.pmod(F.monotonically_increasing_id(), F.lit(parts)) if parts > 1 else F.lit(0))
        rows = rows.groupBy("tile", "fan").applyInPandas(combine, schema)
        if parts == 1:
            return rows
        rows = stored(rows, "merged")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k highest-scoring documents with a score above 0, ties to the smaller doc_id.

    Null and empty texts have no terms. Documents with a null doc_id take no part; repeated rows each do. A query with a null
    item_id has its rows under null, a repeated one has them again. Other columns are left out; either side may be empty. Terms
    are compared by 64-bit hashes.
    """
    spark, scratch = docs.sparkSession, Scratch()
    made = scratch.stored(blocks(docs, doc_id, text_col), "signature-blocks", GROUP)
    asked = scratch.stored(query_tiles(queries, item_id, text_col), "query-tiles")
    size = F.length("slices") + F.length("at") + F.length("tf") + 12 * F.length("vocabulary") / 8
    whole = made.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    tiles = asked.count()
    if not whole.docs or not tiles:
        scratch.clear()
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    total_docs, total = whole.docs, whole.total
    # every tile meets every slot of blocks, so queries are copied, as they are the few
    slots = max(1, min(whole.n, ceil(whole.bytes * tiles / TASK_BYTES)))
    own = F.array(*[F.lit(key).cast("long") for key in partition_keys(spark, slots)])
    made = made.withColumn("slot", F.element_at(own, (F.pmod(F.xxhash64("slot_key"), F.lit(slots)) + 1).cast("int")))
    copies = F.explode(own).alias("slot")

    def counted(batches):
        tile = None
        for b in batches:
            for r in b.itertuples():
                if r.tile != tile:
                    if tile is not None:
                        yield pd.DataFrame({"tile": [tile], "df": [df.tobytes()]})
                    tile, terms = r.tile, np.unique(np.frombuffer(r.terms, np.uint64))
                    df = np.zeros(len(terms), np.int64)
                vocabulary, n = np.frombuffer(r.vocabulary, np.uint64), np.frombuffer(r.df, np.uint32)
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                df += np.where(vocabulary[at] == terms, n[at], 0)
        if tile is not None:
            yield pd.DataFrame({"tile": [tile], "df": [df.tobytes()]})

    def summed(rows):
        return pd.DataFrame({"tile": rows["tile"][:1], "df": [np.sum([np.frombuffer(x, np.int64) for x in rows["df"]], axis=0, dtype=np.int64).tobytes()]})

    # a partition for each slot, however few the session has, as a slot is what a task may hold
    copied = lambda *columns: asked.select("tile", *columns, copies).repartition(slots, "slot").hint("merge")
    met = copied("terms").join(made.select("slot", "vocabulary", "df").repartition(slots, "slot"), "slot")
    df = merged(met.drop("slot").sortWithinPartitions("tile").mapInPandas(counted, "tile long, df binary"), "tile long, df binary", summed, slots)
    asked = scratch.stored(asked.join(df, "tile"), "weighted-tiles")

    def ranked(batches):
        tile = now = None
        for b in batches:
            for r in b.itertuples():
                if r.tile != tile:
                    if tile is not None:
                        yield now.row(tile)
                    tile = r.tile
                    counts, repeats, df = (np.frombuffer(x, np.int64) for x in (r.counts, r.repeats, r.tile_df))
                    now = Tile(counts, np.frombuffer(r.terms, np.uint64), repeats, df, total_docs, total, k)
                now.offer(Block(r))
        if tile is not None:
            yield now.row(tile)

    def best(rows):
        found = [[np.frombuffer(x, np.int64) for x in (r.counts, r.ids, r.scores)] for r in rows.itertuples()]
        query = np.concatenate([np.repeat(np.arange(len(c)), c) for c, _, _ in found])
        ids, scores = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        by = np.lexsort((ids, -scores, query))
        query, ids, scores = query[by], ids[by], scores[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        counts = np.bincount(query[place < k], minlength=len(found[0][0])).astype(np.int64)
        return pd.DataFrame({"tile": rows["tile"][:1], "counts": [counts.tobytes()], "ids": [ids[place < k].tobytes()], "scores": [scores[place < k].tobytes()]})

    fields = ["ids", "lengths", "vocabulary", "starts", "at", "tf", "bits", "slices"]
    met = copied("counts", "terms", "repeats", F.col("df").alias("tile_df")).join(made.select("slot", *fields).repartition(slots, "slot"), "slot")
    found = merged(met.drop("slot").sortWithinPartitions("tile").mapInPandas(ranked, _BEST), _BEST, best, slots)

    def rows(batches):
        for b in batches:
            for r in b.itertuples():
                counts, ids, scores = (np.frombuffer(x, np.int64) for x in (r.counts, r.ids, r.scores))
                items = pd.Series([None if i is None or i != i else int(i) for i in r.item_ids], dtype="Int64")
                rank = np.arange(len(ids)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts) + 1
                yield pd.DataFrame({"item_id": items.repeat(counts).reset_index(drop=True), "rank": rank.astype(np.int32), "doc_id": ids, "score": scores})

    out = stored(found.join(asked.select("tile", "item_ids"), "tile").mapInPandas(rows, "item_id long, rank int, doc_id long, score long"), "ranked")
    scratch.clear()
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, by the contract of operator 12."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, g GROUP BY term, docs),
s AS (SELECT q.item_id, c.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * n.n * g.docs) // g.total)))) AS BIGINT) AS score
      FROM q JOIN c USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY q.item_id, c.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
