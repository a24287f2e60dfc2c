"""Operator 9: SimHash near-duplicates with pivot distance tables.

Every document has a 64-bit fingerprint of its word shingles. Different fingerprints within max_bits of each other
agree on all bits of some combination of blocks, so an equi-join on those blocks brings every such pair together. There
a table of Hamming distances to many reference fingerprints discards pairs whose largest coordinate difference is over
max_bits (the triangle inequality), and the survivors are verified bit by bit. Links become connected components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausespark.llm.common import connected_components, documents, shuffle_partitions, stored
from clausespark.operators.quality import numbered

SEED = 42
PIVOTS = 24
#: Fingerprints that agree on a block combination are compared in one task up to this many; beyond, on more bits.
GROUP = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a text, 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], ">u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        votes += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits. Null texts have no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    rows = docs.selectExpr(f"cast(`{id_col}` as string) as doc_id", f"`{text_col}` as text")
    return rows.mapInPandas(run, "doc_id string, fp long").selectExpr("cast(doc_id as long) as doc_id", "fp")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, spread by hashing their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def block_masks(free: int, blocks: int, max_bits: int) -> list[int]:
    """Masks of all combinations of `blocks - max_bits` of the blocks that the set bits of free are cut into."""
    bits = [i for i in range(64) if free >> i & 1]
    own = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, object), blocks)]
    return [sum(c) for c in combinations(own, blocks - max_bits)]


def best_blocks(n: int, max_bits: int) -> int:
    """The number of blocks with the fewest rows and expected chance pairs for n fingerprints."""
    cost = lambda m: comb(m, max_bits) * (8.0 * n + n * n / 2 / 2.0 ** (64 // m * (m - max_bits)))
    return min(range(max_bits + 1, max_bits + 7), key=cost)


def _links(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: edges that connect all linked rows of equal keys, a path through each component."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    label = np.arange(len(fp))
    at, shift = np.arange(len(fp)), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        shift += 1
        at = at[at + shift < len(fp)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        i, j = at, at + shift
        for p in range(table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= max_bits
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        i, j = i[near], j[near]
        if len(i):
            found.append((i, j))
            if sum(len(x) for x, _ in found) > 1 << 20:
                found = [_forest(label, found)]
    if not found:
        return label[:0], label[:0]
    return _forest(label, found)


def _forest(label: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A path through the rows of each component of the found edges."""
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    root = label.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rows = np.unique(np.concatenate((i, j)))
    by = rows[np.argsort(root[rows], kind="stable")]
    same = root[by[1:]] == root[by[:-1]]
    return by[:-1][same], by[1:][same]


def fingerprint_links(fps: DataFrame, max_bits: int = 4, n: int | None = None, group: int = GROUP) -> DataFrame:
    """(a, b): edges between the distinct non-null fps (long) that connect whatever is within max_bits.

    Every pair within max_bits is joined by a path of edges, each itself within a component. Fingerprints that agree on
    a block combination with over `group` others are compared again on more bits, where the same argument holds, until
    their groups are small or all their bits are fixed.
    """
    pivots = reference_fingerprints()

    def compare(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            last = b["mask"].iloc[-1], b["key"].iloc[-1]
            ends = ((b["mask"] == last[0]) & (b["key"] == last[1])).to_numpy()
            if not ends.all():
                yield path(pd.concat([*held, b[~ends]]))
                held = []
            held.append(b[ends])
        if held:
            yield path(pd.concat(held))

    def path(rows):
        mask, key, fp = (rows[c].to_numpy(np.int64) for c in ("mask", "key", "fp"))
        change = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        i, j = _links(np.cumsum(change), fp.view(np.uint64), pivots, max_bits)
        return pd.DataFrame({"a": fp[i], "b": fp[j]})

    n = fps.count() if n is None else n
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(m) for m in block_masks((1 << 64) - 1, best_blocks(n, max_bits), max_bits)]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    parts, links = shuffle_partitions(fps.sparkSession), None
    while True:
        rows = stored(rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), "blocks")
        crowded = stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("mask", "key"), "crowded")
        more = crowded.limit(1).count() > 0
        few = rows.join(crowded, ["mask", "key"], "left_anti") if more else rows
        found = few.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(compare, "a long, b long").distinct()
        links = found if links is None else links.union(found)
        if not more:
            return links
        rows = rows.join(crowded, ["mask", "key"], "left_semi")
        finer = []
        # masks in use: block combinations, however large the table
        for r in crowded.select("mask").distinct().collect():
            fixed = r.mask & ((1 << 64) - 1)
            free = ~fixed & ((1 << 64) - 1)
            blocks = min(2 * max_bits, free.bit_count())
            # with no more free bits than max_bits, whatever agrees on the others is linked
            own = [m | fixed for m in block_masks(free, blocks, max_bits)] if blocks > max_bits else [fixed]
            finer += [(r.mask, signed(m)) for m in own]
            group = group if blocks > max_bits else 1 << 62
        finer = fps.sparkSession.createDataFrame(finer, "mask long, finer long")
        rows = rows.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id reachable over links.

    Links are fingerprints at max_bits or fewer differing bits; texts of fewer words than width have one shingle, those
    without words (null ones too) the fingerprint 0, linked like any other. A null doc_id is kept in its row but never a
    component_id unless the component has no other. Repeated rows stay. Other columns are left out.
    """
    d = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = stored(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    label = connected_components(fingerprint_links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    tied = stored(fps.join(label, "fp"), "tied-fps")
    component = stored(tied.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    joined = stored(tied.select("fp", "component").join(component, "component").select("fp", "component_id"), "fp-components")
    own = stored(fps.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fp-ids")
    return d.join(own, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


#: MinHash keys of a document and hashes in each: a pair at a similarity of 0.8 has no equal key once in 8 million.
KEYS, HASHES = 40, 5


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different shingles; of a text without words, those of one empty shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], np.uint64))


def minhash_keys(hashes: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, KEYS * HASHES), np.uint64)
    least = np.array([((hashes ^ x) * y).min() for x, y in zip(flips, factors | np.uint64(1), strict=True)], np.uint64).reshape(KEYS, HASHES)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64)


def similar_links(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): links between the non-null doc_ids of docs (doc_id, text) that connect all with similar sets of shingles.

    Similar are sets of which the common part is `similarity` or more of the union. Equal sets are linked to the smallest
    doc_id that has them. Of the sets with an equal MinHash key, each is verified against one; pairs of those that this
    leaves in different components are then verified all, as other pairs cannot connect anything.
    """

    def signed(batches):
        for b in batches:
            found = [shingle_hashes(t, width) for t in b["text"]]
            own = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "own": own, "n": [len(h) for h in found], "keys": [minhash_keys(h) for h in found]})

    def whole(batches):
        for b in batches:
            yield pd.DataFrame({"gid": b["gid"], "hashes": [shingle_hashes(t, width).tobytes() for t in b["text"]]})

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y, strict=True):
            u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
            common = len(np.intersect1d(u, v, assume_unique=True))
            out.append(common >= similarity * (len(u) + len(v) - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = stored(docs.mapInPandas(signed, "doc_id long, own long, n long, keys array<long>"), "signatures")
    least = signs.groupBy("own", "n").agg(F.min(F.struct("doc_id", "keys")).alias("s")).select("own", "n", "s.*")
    sets = stored(least.withColumn("gid", F.monotonically_increasing_id()), "shingle-sets")
    equal = signs.join(sets.select("own", "n", F.col("doc_id").alias("b")), ["own", "n"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    w = Window.partitionBy("key")
    keys = sets.select(F.explode("keys").alias("key"), "gid", "n").withColumns({"one": F.min("gid").over(w), "high": F.max("gid").over(w)})
    keys = stored(keys.where("one < high").drop("high"), "shared-keys")
    wanted = keys.select("gid").distinct().join(sets, "gid").select("gid", "doc_id", "own", "n")
    # a doc_id may have several texts: each set takes the one with its hash
    text_of = F.pandas_udf(lambda t: pd.Series([xxhash.xxh64_intdigest(shingle_hashes(x, width).tobytes()) for x in t], dtype="uint64").astype("int64"), "long")
    texts = docs.join(wanted, "doc_id").select("gid", "own", "text", text_of("text").alias("found")).where("own = found")
    hashes = stored(texts.groupBy("gid").agg(F.first("text").alias("text")).mapInPandas(whole, "gid long, hashes binary"), "shingles")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        both = pairs.join(hashes.select(F.col("gid").alias("a"), F.col("hashes").alias("ha")), "a").join(hashes.select(F.col("gid").alias("b"), F.col("hashes").alias("hb")), "b")
        return stored(both.where(alike("ha", "hb")).select("a", "b"), f"{name}-alike")

    first = verified(keys.where("gid <> one").select(F.col("gid").alias("a"), F.col("one").alias("b")), "copies-firsts")
    label = connected_components(first).withColumnRenamed("node", "gid")
    keys = stored(keys.drop("one").join(label, "gid", "left").withColumn("component", F.coalesce("component", "gid")), "labelled-keys")
    mixed = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    keys = stored(keys.join(mixed, "key", "left_semi"), "mixed-keys")
    apart = F.expr(f"a.key = b.key and a.gid < b.gid and a.component <> b.component and least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9")
    pairs = keys.alias("a").join(keys.alias("b"), apart).select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"))
    links = first.union(verified(pairs, "copies-pairs"))
    of = sets.select("gid", "doc_id")
    links = links.join(of.select(F.col("gid").alias("a"), F.col("doc_id").alias("da")), "a").join(of.select(F.col("gid").alias("b"), F.col("doc_id").alias("db")), "b")
    return equal.union(links.select("da", "db"))


def copy_links(docs: DataFrame, width: int, similarity: float, max_bits: int | None) -> DataFrame:
    """(a, b): links between the non-null doc_ids of docs (doc_id, text): those of similar_links, and by fingerprints.

    Fingerprints meet in the block join, pivots and bits decide as in near_duplicates. At a similarity of 0.8 most
    fingerprints are further apart than max_bits, so the sets of shingles link what fingerprints do not reach. With
    max_bits None the sets alone count.
    """
    if max_bits is None:
        return similar_links(docs, width, similarity)
    near = near_duplicates(docs, max_bits=max_bits).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return near.union(similar_links(docs, width, similarity))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """docs without near copies: of every connected group of copy_links the document with the smallest doc_id stays.

    A document is a doc_id and a text: rows that repeat both stay or go together, and a doc_id with unlike texts has a
    document for each, the one of the smaller text hash first. Null and empty texts are alike. Rows with a null doc_id
    stay. All columns stay.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    twice = texts.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    if not twice.limit(1).count():
        found = connected_components(copy_links(texts.drop("h"), width, similarity, max_bits))
        return docs.join(found.where("node <> component").select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    nodes = stored(numbered(texts.select("doc_id", "h").distinct(), [F.asc("doc_id"), F.asc("h")], "node"), "documents")
    found = connected_components(copy_links(texts.join(nodes, ["doc_id", "h"]).select(F.col("node").alias("doc_id"), "text"), width, similarity, max_bits))
    gone = stored(found.where("node <> component").join(nodes, "node").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_hash")), "copies")
    # the row as one column, so that no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"))
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("own") == F.col("gone_hash")), "left_anti").select("doc.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, by the contract of operator 9."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
