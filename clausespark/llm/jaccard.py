"""Operator 11: n-gram Jaccard join over signature trees.

A document is the set of its word shingles; equal sets are one. To bring similar sets together without all pairs, the hashes of
shingles are dealt to parts: sets that link differ in a bounded number of shingles, so among one more parts of the smaller one
that hold any, one is the same in both (pigeonhole). A set's parts are its keys.

Sets that share a key are compared with one of them first, and in further rounds with another one, which connects copies. Pairs
that bitmaps of shingles rule out go no further. Of keys whose sets are still in different components, the sets form a signature tree: leaves are bitmaps of shingles, inner nodes OR them and hold ranges of sizes and
components. Pairs of nodes are descended into together unless the largest overlap that they allow is too small, their sizes
differ too much, or all below them is one component. Pairs of leaves that are left are verified on the texts.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import Scratch, connected_components, documents, stored

SEED = 42
#: Children of a node, sets of a block, pairs of nodes looked at together.
FANOUT, BLOCK, FRONTIER = 8, 1024, 1 << 15
#: Rounds in which the sets of a key are compared with another one of them, before trees.
ROUNDS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """The sorted hashes of a text's different shingles; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def differing(n: int, percent: int) -> int:
    """Shingles at most in one of two linked sets alone, of which the smaller has n."""
    return n * (100 - percent) // percent


def part_keys(h: np.ndarray, percent: int = 85) -> np.ndarray:
    """The keys of a set: any other set that links has one of them, unless it is equal.

    Classes are sizes from a power of two to the next; a set that links with larger ones of the next class has keys there too.
    """
    n = len(h)
    most = differing(n, percent)
    if not most:
        return np.zeros(0, np.int64)
    own, keys = n.bit_length() - 1, []
    value = _mixed(h)
    for c in (own, own + 1) if 100 * n >= percent << own + 1 else (own,):
        parts = differing((2 << c) - 1, percent) * 13 // 10 + 3
        part = (h % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(part[by]) > 0])
        sums = np.add.reduceat(value[by], starts)[: most + 1]
        where = part[by][starts][: most + 1].astype(np.uint64) + np.uint64(c << 40)
        keys.append(_mixed(sums ^ _mixed(where)))
        if len(starts) <= most:
            # too few parts hold shingles for the pigeonhole: all such sets of a class meet
            keys.append(_mixed(np.array([(c << 40) - 1], np.uint64)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in four to eight times as many as the set has."""
    bits = 4 << len(h).bit_length()
    wide = np.zeros(max(64, bits), bool)
    wide[(_mixed(h) % np.uint64(len(wide))).astype(np.int64)] = True
    return np.packbits(wide, bitorder="little").tobytes()


class SignatureTree:
    """Levels of nodes over sets, from leaves to the root: OR-combined bitmaps, ranges of sizes and of components."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        surplus = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, component, component, surplus)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, first, last, surplus = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), np.maximum.reduceat(surplus, at),
            ))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets below nodes i and j of a level may link and are not known to be connected."""
        bits, low, high, first, last, surplus = self.levels[level]
        one = (first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j])
        ok = ~one & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        at = np.flatnonzero(ok)
        x, y = bits[i[at]], bits[j[at]]
        need = percent * (low[i[at]] + low[j[at]])
        if level:
            overlap = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + np.minimum(surplus[i[at]], surplus[j[at]])
        else:
            alone = [np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((x, y), (y, x))]
            overlap = np.minimum(low[i[at]] - alone[0], low[j[at]] - alone[1])
        ok[at[(100 + percent) * overlap < need]] = False
        return ok

    def pairs(self, percent: int):
        """Pairs of leaves that may link, in batches, by dual descent from the root."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        while stack:
            level, i, j = stack.pop()
            if not level:
                yield i, j
                continue
            n = len(self.levels[level - 1][0])
            step = max(1, FRONTIER // FANOUT**2)
            if len(i) > step:
                stack.append((level, i[step:], j[step:]))
                i, j = i[:step], j[:step]
            child = np.arange(FANOUT)
            a = np.repeat(i[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            b = np.tile(j[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            real = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            a, b = a[real], b[real]
            ok = self.may_link(level - 1, a, b, percent)
            if ok.any():
                stack.append((level - 1, a[ok], b[ok]))


def _folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to so many bytes, a power of two."""
    own = np.frombuffer(bits, np.uint8)
    return own if len(own) == size else np.bitwise_or.reduce(own.reshape(-1, size), axis=0)


def tree_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): pairs of the rows of one key (key, gid, n, bits, component, side, keys) that may link.

    Rows of two sides pair across alone. keys are a set's keys in use; a pair counts under the smallest that both have.
    """
    size = min(map(len, rows["bits"]))
    bits = np.stack([_folded(b, size) for b in rows["bits"]])
    by = np.lexsort((bits.view(">u8")[:, 0], rows["n"].to_numpy(), rows["component"].to_numpy()))
    gid, side, key = rows["gid"].to_numpy()[by], rows["side"].to_numpy()[by], rows["key"].iloc[0]
    keys = [frozenset(k) for k in rows["keys"].to_numpy()[by]]
    tree = SignatureTree(bits[by].view(np.uint64), rows["n"].to_numpy(np.int64)[by], rows["component"].to_numpy()[by])
    across, found = side.min() != side.max(), []
    for i, j in tree.pairs(percent):
        met = (side[i] != side[j]) if across else (i < j)
        found += [(x, y) for x, y in zip(i[met].tolist(), j[met].tolist(), strict=True) if min(keys[x] & keys[y]) == key]
    i, j = (np.array([f[x] for f in found], np.int64) for x in (0, 1))
    return pd.DataFrame({"a": np.minimum(gid[i], gid[j]), "b": np.maximum(gid[i], gid[j])})


def _by_group(rows_of, columns: list[str]):
    """A function of batches sorted by columns that applies rows_of to each run of equal ones."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            change = np.zeros(len(b), bool)
            for c in columns:
                own = b[c].to_numpy()
                change[1:] |= own[1:] != own[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = b.iloc[s:e]
                if held and any(held[-1][c].iloc[-1] != part[c].iloc[0] for c in columns):
                    yield rows_of(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield rows_of(pd.concat(held))

    return run


def bitmaps_allow(percent: int):
    """A function of sizes and bitmaps of two sets: whether they may link."""

    @F.pandas_udf("boolean")
    def allow(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for n_, u, m_, v in zip(n, x, m, y, strict=True):
            size = min(len(u), len(v))
            u, v = _folded(u, size).view(np.uint64), _folded(v, size).view(np.uint64)
            overlap = min(n_ - int(np.bitwise_count(u & ~v).sum()), m_ - int(np.bitwise_count(v & ~u).sum()))
            out.append((100 + percent) * overlap >= percent * (n_ + m_))
        return pd.Series(out, dtype=bool)

    return allow


def alike_texts(width: int, percent: int):
    """A function of two columns of texts: whether their sets link."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        held = lru_cache(64)(lambda t: shingle_set(t, width))
        out = []
        for u, v in zip(x, y, strict=True):
            u, v = held(u), held(v)
            common = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * common >= percent * (len(u) + len(v) - common))
        return pd.Series(out, dtype=bool)

    return alike


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: component_id is the smallest doc_id reachable by links.

    Two rows link if the intersection of their sets of shingles is percent in 100 or more of the union. A text with fewer words
    than width has one shingle; one without words (null ones too) has none and links with nothing. Every row counts by itself,
    repeated doc_ids too; a null doc_id is a component_id only where a component has no other. Other columns are left out.
    Shingles are compared by 64-bit hashes, sets by 128-bit ones. No join broadcasts: all sides grow with docs, and the sizes of
    compressed files, by which Spark would choose, say little of the memory that a side takes in the driver.
    """

    def signed(batches):
        for b in batches:
            for s in range(0, len(b), 1024):
                part = b.iloc[s : s + 1024]
                sets = [shingle_set(t, width) for t in part["text"]]
                own = np.array([[xxhash.xxh64_intdigest(h.tobytes(), x) for x in (0, 1)] for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "t1": part["t1"], "t2": part["t2"], "n": np.array([len(h) for h in sets], np.int64), "o1": own[:, 0], "o2": own[:, 1],
                    "keys": [part_keys(h, percent) for h in sets], "bits": [bitmap(h) for h in sets],
                })

    scratch, first = Scratch(), Scratch()
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = d.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), "t1", "t2", "text")
    full = rows.mapInPandas(signed, "doc_id string, t1 long, t2 long, n long, o1 long, o2 long, keys array<long>, bits binary")
    full = first.stored(full.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")
    signs = scratch.stored(full.select("doc_id", "n", "o1", "o2"), "documents")
    some = full.where("n > 0").groupBy("o1", "o2", "n")
    sets = some.agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    full = first.stored(sets.withColumn("gid", F.monotonically_increasing_id()), "sets-and-keys")
    sets = scratch.stored(full.drop("keys"), "shingle-sets")
    keys = full.select(F.explode("keys").alias("key"), "gid")
    shared = keys.groupBy("key").agg(F.min("gid").alias("one"), F.count("*").alias("sets")).where("sets > 1")
    keys = scratch.stored(keys.join(shared.hint("merge"), "key"), "shared-keys")
    first.clear()

    alike, allow, texts = alike_texts(width, percent), bitmaps_allow(percent), []

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, ...) that bitmaps allow."""
        sides = [sets.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"]
        return scratch.stored(pairs.hint("merge").join(sides[0], "a").hint("merge").join(sides[1], "b").where(allow("na", "bitsa", "nb", "bitsb")).select(*pairs.columns), f"near-{name}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The near pairs whose texts link; each text is fetched once."""
        if not pairs.limit(1).count():
            return pairs.select("a", "b")
        wanted = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()
        for held in texts:
            wanted = wanted.join(held.hint("merge"), "gid", "left_anti")
        wanted = scratch.stored(wanted.hint("merge").join(sets.select("gid", "row.*"), "gid").select("gid", F.col("doc_id").alias("of"), F.col("t1").alias("u1"), F.col("t2").alias("u2")), "wanted")
        same = (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("of"))
        texts.append(scratch.stored(d.join(wanted.hint("merge"), same).groupBy("gid").agg(F.first("text").alias("text")), "texts"))
        every = reduce(DataFrame.union, texts)
        both = pairs.hint("merge").join(every.select(F.col("gid").alias("a"), F.col("text").alias("ta")), "a").hint("merge").join(every.select(F.col("gid").alias("b"), F.col("text").alias("tb")), "b")
        return scratch.stored(both.where(alike("ta", "tb")).select("a", "b"), name)

    def mixed(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Of rows (key, gid) those of keys whose sets are in several components, with these; keys of the same sets once."""
        label = connected_components(links).withColumnRenamed("node", "gid")
        now = scratch.stored(rows.join(label.hint("merge"), "gid", "left").select("key", "gid", F.coalesce("component", "gid").alias("component")), "labelled-keys")
        of = now.groupBy("key").agg(F.count("*").alias("sets"), *[F.bit_xor(F.xxhash64(F.lit(i), "gid")).alias(f"all{i}") for i in (0, 1)], F.min("component").alias("low"), F.max("component").alias("high"))
        of = of.where("low < high").groupBy("sets", "all0", "all1").agg(F.min("key").alias("key"))
        return scratch.stored(now.join(of.select("key", "sets").hint("merge"), "key"), "mixed-keys")

    # the set with which each shares most keys, then all others that it shares keys with as the first of them
    star = keys.where("gid <> one").groupBy(F.col("gid").alias("b"), F.col("one").alias("a")).agg(F.count("*").alias("n"))
    star = near(star.select("a", "b", "n"), "firsts")
    most = star.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    links = verified(most, "links-most")
    label = connected_components(links)
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = star.join(most.hint("merge"), ["a", "b"], "left_anti").join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.union(verified(apart, "links-firsts"))

    # in each round another set of each key stands for it
    left = mixed(keys.where("sets > 2").select("key", "gid"), links)
    for at in range(ROUNDS):
        if not left.limit(1).count():
            break
        one = left.groupBy("key").agg(F.min_by(F.struct("gid", "component"), F.xxhash64(F.lit(at), "key", "gid")).alias("one"))
        met = left.join(one.hint("merge"), "key").where("component <> one.component").select(F.least("gid", "one.gid").alias("a"), F.greatest("gid", "one.gid").alias("b")).distinct()
        links = links.union(verified(near(met, f"round-{at}"), f"links-{at}"))
        left = mixed(left.select("key", "gid"), links)

    own = left.groupBy("gid").agg(F.collect_set("key").alias("keys"))
    left = left.join(own.hint("merge"), "gid").join(sets.select("gid", "n", "bits").hint("merge"), "gid")
    # blocks of a key's sets, and every pair of blocks
    left = left.withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("gid", "key"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "gid", "n", "bits", "component", "side", "keys")
    group = ["key", "x", "y"]
    found = left.repartition(*group).sortWithinPartitions(*group).mapInPandas(_by_group(lambda rows: tree_pairs(rows, percent), group), "a long, b long")
    links = links.union(verified(scratch.stored(found, "tree-pairs"), "links-trees"))

    ids = sets.select("gid", "o1", "o2", "n", "least").join(connected_components(links).withColumnRenamed("node", "gid").hint("merge"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    ids = scratch.stored(ids, "set-components")
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.join(least.hint("merge"), "component").select("o1", "o2", "n", "component_id")
    out = signs.select("doc_id", "o1", "o2", "n").join(ids.hint("merge"), ["o1", "o2", "n"], "left")
    # a set without shingles has no component
    out = out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = stored(out, "jaccard")
    scratch.clear()
    return out


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component, by the contract of operator 11."""
    return jaccard_components(documents(spark, sf_dir))
