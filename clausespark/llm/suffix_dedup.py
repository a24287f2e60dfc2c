"""Operator 6: removal of repeated passages by two-stage suffix sorting.

A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller doc_id.

1. Texts are packed into blocks. Every string of LENGTH bytes has one minimizer: of the hashes of its GRAM-byte parts the
   least, the leftmost of equal ones. Equal strings have equal minimizers, so only strings whose minimizer occurs in two
   documents can repeat. Each block sends its different minimizers to hash buckets and hears which are shared.
2. Consecutive strings with one minimizer form a run. The different runs of shared minimizers, with the least doc_id of
   each in its block, are sent to the buckets of their minimizers, so equal strings meet in one bucket. Runs of a
   minimizer that has very many are sent string by string to the buckets of those strings instead.
3. A bucket joins its different runs, sorts their suffixes in two stages (those smaller than their successors directly,
   the others induced by scanning the buckets of first bytes) and computes adjacent common prefixes. Strings with common
   prefixes of LENGTH or more form a class; its least doc_id decides, and each block hears a bit for every string.
4. Blocks cut their runs again, mark the strings that repeat and cut out their bytes.

Nothing is sampled or capped: blocks and buckets only deal out the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark.llm.common import documents, shuffle_partitions, stored

LENGTH = 50
GRAM = 20
#: Bytes of text in a block; a longer document is a block alone.
BLOCK = 1 << 20
#: Runs of one minimizer, over all blocks, above which they are dealt out string by string.
CROWDED = 2000
_M = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block long, n int, ids binary, known binary, sizes binary, text binary, carried array<string>"
_KEYS = "bucket int, block long, keys binary, several binary, runs binary"
_SHARED = "block long, bucket int, keys binary, crowded binary"
_RUNS = "bucket int, block long, texts binary, sizes binary, least binary"
_BITS = "block long, bucket int, bits binary"
END = 0xFF  # never a byte of UTF-8


_PACKER, _OPENER = zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor()


def _squeezed(raw: bytes) -> bytes:
    """Compressed bytes, as the codec of shuffles leaves texts at twice the size."""
    return _PACKER.compress(raw)


def _loosened(packed: bytes) -> bytes:
    return _OPENER.decompress(packed)


# --- blocks ---------------------------------------------------------------------------------------------------------


def _pack_blocks(batches):
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, 0
    ids, texts, carried = [], [], []
    packer = zstandard.ZstdCompressor(3)

    def close():
        known = np.array([i is not None for i in ids], bool)
        return pd.DataFrame({
            "block": [(part << 32) + number], "n": [len(ids)], "ids": [np.array([int(i) if i is not None else 0 for i in ids], np.int64).tobytes()], "known": [known.tobytes()],
            "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "text": [packer.compress(b"".join(texts))], "carried": [list(carried)],
        })

    for b in batches:
        for i, t, c in zip(b["doc_id"], b["text"], b["carried"], strict=True):
            t = t.encode("utf-8", "surrogatepass") if t is not None else b""
            if texts and held + len(t) > BLOCK:
                yield close()
                number, held = number + 1, 0
                ids, texts, carried = [], [], []
            ids.append(i)
            texts.append(t)
            carried.append(c)
            held += len(t)
    if texts:
        yield close()


class Block:
    """One packed block: ids, which of them are known (not null), sizes and the joined text."""

    def __init__(self, row):
        self.number = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.known = np.frombuffer(row.known, bool)
        self.sizes = np.frombuffer(row.sizes, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row.text, max_output_size=max(1, int(self.sizes.sum())))
        self.ends = np.cumsum(self.sizes)


def gram_hashes(t: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from every place on, by doubling."""
    h, width, out, done = (t.astype(np.uint64) + np.uint64(1)) * _M, 1, None, 0
    h ^= h >> np.uint64(29)
    n = len(t) - gram + 1
    left = gram
    while left:
        if left & 1:
            out = h[done : done + n] if out is None else out * _power(width) + h[done : done + n]
            done += width
        left >>= 1
        if left:
            h = h[: len(h) - width] * _power(width) + h[width:]
            width *= 2
    out = out ^ (out >> np.uint64(32))
    out *= _M
    return out ^ (out >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


def runs_of(block: Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, document, minimizer hash) of every run of strings with one minimizer; null ids have none."""
    return _runs_and_hashes(block, length, gram)[:4]


def _runs_and_hashes(block: Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """runs_of, and the hashes of the GRAM-byte parts from every place on."""
    empty = np.zeros(0, np.int64)
    n = len(block.raw) - length + 1
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    t = np.frombuffer(block.raw, np.uint8)
    h = gram_hashes(t, gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, length - gram + 1
    while width * 2 <= want:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < want:
        key = np.minimum(key[: len(key) - (want - width)], key[want - width :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(n + 1, np.int8)  # strings within one document
    starts = block.ends - block.sizes
    whole = (block.sizes >= length) & block.known
    fits[starts[whole]] += 1
    fits[block.ends[whole] - length + 1] -= 1
    fits = np.cumsum(fits[:-1], dtype=np.int8).astype(bool)
    new = fits.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~fits[:-1]
    new[starts[whole]] = True
    first = np.flatnonzero(new)
    stop = np.flatnonzero(fits & ~np.r_[fits[1:], False])
    last = np.r_[first[1:], n] - 1
    if len(stop):
        last = np.minimum(last, stop[np.searchsorted(stop, first)])
    return first, last, np.searchsorted(block.ends, first, side="right"), h[place[first]], h


def _bucket_key(h: np.ndarray, bits: int) -> np.ndarray:
    """Of each hash its bucket and 32 more bits, in one number. Minimizers are small hashes, so they are mixed anew."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(32 - bits)


# --- suffix sorting -------------------------------------------------------------------------------------------------


def _words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, the first byte highest; zeros after the end, 64 more of them."""
    w = np.concatenate((t, np.zeros(64 + 8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        w = (w[: len(w) - width] << np.uint64(8 * width)) | w[width:]
    return w


def _sort_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """The places in order of the `depth` bytes from them on: by 8 bytes, then equal ones by the next 8, and so on."""
    order = np.argsort(w[at], kind="stable")
    at = at[order]
    first = w[at]
    tied = np.flatnonzero(np.r_[first[1:] == first[:-1], False] | np.r_[False, first[1:] == first[:-1]])
    group = np.cumsum(np.r_[True, first[1:] != first[:-1]])
    for k in range(8, depth, 8):
        if not len(tied):
            break
        own = at[tied]
        g, x = group[tied], w[own + k]
        by = np.lexsort((x, g))
        at[tied] = own[by]
        x, g = x[by], g[by]
        same = (x[1:] == x[:-1]) & (g[1:] == g[:-1])
        group[tied] = np.cumsum(np.r_[True, ~same])
        tied = tied[np.r_[same, False] | np.r_[False, same]]
    return at


def suffix_order(t: np.ndarray, w: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All places of t in order of their suffixes, right to `depth` bytes at least (suffixes equal so far in any order).

    First stage: suffixes smaller than their successors are sorted directly. Second stage: the buckets of first bytes
    are scanned in order; each suffix found puts the one before it, if that is larger than its successor, into the next
    place of its own bucket.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    step = np.flatnonzero(np.r_[t[1:] != t[:-1], True])  # where the next byte differs, and the last place
    rises = np.r_[t[1:] > t[:-1], False]
    smaller = np.repeat(rises[step], np.diff(np.r_[-1, step]))  # equal bytes go as the first different one after them
    direct = _sort_directly(np.flatnonzero(smaller), w, depth)
    cuts = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        own = []
        while len(wave):
            own.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~smaller[before]]
        own.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(own)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        keep = (byte > c) & ~smaller[before]
        before, byte = before[keep], byte[keep]
        if len(before):
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for s, e in zip(starts, [*starts[1:], len(byte)], strict=True):
                waiting[byte[s]].append(before[s:e])
    return np.concatenate(out)


def adjacent_prefixes(order: np.ndarray, w: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """The bytes that each suffix but the first has in common with the one before it in order, up to `most`."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for k in range(0, most, 8):
        x = w[a[going] + k] ^ w[b[going] + k]
        same = x == 0
        bits = np.frexp((x[~same] >> np.uint64(11)).astype(np.float64))[1] + 11  # the highest bit that differs, exact above 2**11
        low = x[~same] < np.uint64(1 << 11)
        bits[low] = np.frexp(x[~same][low].astype(np.float64))[1]
        out[going[~same]] = k + (64 - bits) // 8
        going = going[same]
        out[going] = k + 8
        if not len(going):
            break
    return np.minimum(out, most)


def least_of_classes(texts: list[bytes], least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every string of `length` bytes in the texts, in order, the least value of all texts it occurs in; and how many
    strings each text has."""
    sizes = np.array([len(x) for x in texts], np.int64)
    t = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)
    w = _words(t)
    order = suffix_order(t, w, length)
    begin = np.cumsum(sizes + 1) - sizes - 1
    strings = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(t)) - begin[text] < strings[text]
    order = order[inside[order]]
    fresh = np.r_[True, adjacent_prefixes(order, w, length) < length]
    lowest = np.minimum.reduceat(least[text[order]], np.flatnonzero(fresh))
    out = np.empty(len(t), np.int64)
    out[order] = lowest[np.cumsum(fresh) - 1]
    return out[inside], strings


# --- the job --------------------------------------------------------------------------------------------------------


def _minimizers(bits: int, length: int, gram: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples():
                block = Block(row)
                _, _, doc, h = runs_of(block, length, gram)
                if not len(h):
                    continue
                key = _bucket_key(h, bits)
                by = np.lexsort((doc, key))
                key, doc = key[by], doc[by]
                fresh = np.r_[True, key[1:] != key[:-1]]
                at = np.flatnonzero(fresh)
                several = np.logical_or.reduceat(np.r_[False, (doc[1:] != doc[:-1])] & ~fresh, at)
                count = np.minimum(np.diff(np.r_[at, len(key)]), 65_535).astype("<u2")
                key = key[at]
                bucket = (key >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                low = key.astype("<u4")
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True))
                yield pd.DataFrame({
                    "bucket": bucket[cut], "block": block.number, "keys": [low[s:e].tobytes() for s, e in spans],
                    "several": [several[s:e].tobytes() for s, e in spans], "runs": [count[s:e].tobytes() for s, e in spans],
                })

    return run


def _shared(crowded: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = [len(k) // 4 for k in rows["keys"]]
        key = np.frombuffer(b"".join(rows["keys"]), "<u4")
        several = np.frombuffer(b"".join(rows["several"]), bool)
        runs = np.frombuffer(b"".join(rows["runs"]), "<u2").astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        many = np.diff(np.r_[starts, len(key)])
        repeats = (many > 1) | np.logical_or.reduceat(several[by], starts)
        full = np.add.reduceat(runs[by], starts) > crowded
        keep, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        keep[by], hot[by] = np.repeat(repeats, many), np.repeat(full, many)
        at, key, hot = at[keep], key[keep], hot[keep]
        cut = np.searchsorted(at, np.arange(len(n) + 1))
        out = [(b, k, key[s:e].tobytes(), hot[s:e].tobytes()) for b, k, s, e in zip(rows["block"], rows["bucket"], cut[:-1].tolist(), cut[1:].tolist(), strict=True) if e > s]
        return pd.DataFrame(out, columns=["block", "bucket", "keys", "crowded"])

    return run


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of which there are n[i], one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Runs(NamedTuple):
    """Runs of shared minimizers, in order of buckets: of the different ones of a bucket the bucket, the start of the first, bytes
    and least id; of all runs the start and the place among the different ones."""

    bucket: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    def buckets(self) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of the different runs of each bucket."""
        cut = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(self.bucket) else np.zeros(0, np.int64)
        return list(zip(self.bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(self.bucket)], strict=False))


def shared_runs(block: Block, shared: pd.DataFrame, bits: int, length: int, gram: int) -> Runs:
    """The block's runs of shared minimizers; runs of crowded minimizers are single strings.

    Equal runs have equal hashes of their parts, which are compared byte by byte before they count as one.
    """
    none = np.zeros(0, np.int64)
    if not len(shared):
        return Runs(*[none] * 6)
    first, last, doc, minimizer, h = _runs_and_hashes(block, length, gram)
    key = _bucket_key(minimizer, bits)
    known = np.concatenate([np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(int(b) << 32) for b, k in zip(shared["bucket"].tolist(), shared["keys"], strict=True)])
    hot = np.frombuffer(b"".join(shared["crowded"]), bool)
    by = np.argsort(known)
    known, hot = known[by], hot[by]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    mine = known[at] == key
    first, last, doc, hot = first[mine], last[mine], doc[mine], hot[at[mine]]
    bucket = (key[mine] >> np.uint64(32)).astype(np.int64)
    if hot.any():
        single = _spread(first[hot], (last - first + 1)[hot])
        owner = np.repeat(doc[hot], (last - first + 1)[hot])
        own = np.array([xxhash.xxh64_intdigest(block.raw[a : a + length]) >> 64 - bits for a in single.tolist()], np.int64)
        first, last, doc, bucket = np.r_[first[~hot], single], np.r_[last[~hot], single], np.r_[doc[~hot], owner], np.r_[bucket[~hot], own]
    sizes, ids = last - first + length, block.ids[doc]
    if not len(first):
        return Runs(*[none] * 6)
    # parts side by side, and the last one, cover a run
    whole = sizes.astype(np.uint64) * _M
    for k in range(0, int(sizes.max()), gram):
        whole = (whole ^ (whole >> np.uint64(31)) ^ h[first + np.minimum(k, sizes - gram)]) * _M
    by = np.lexsort((first, ids, whole, bucket))  # so that the first of equal runs has the least id
    first, sizes, ids, whole, bucket = (x[by] for x in (first, sizes, ids, whole, bucket))
    t = np.frombuffer(block.raw, np.uint8)
    fresh = np.r_[True, (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1]) | (sizes[1:] != sizes[:-1])]
    again = np.flatnonzero(~fresh)
    unlike = t[_spread(first[again], sizes[again])] != t[_spread(first[again - 1], sizes[again])]
    if unlike.any():  # unlike runs of one hash: each that differs from the one before it is one more
        fresh[again[np.logical_or.reduceat(unlike, np.cumsum(sizes[again]) - sizes[again])]] = True
    place = np.cumsum(fresh) - 1
    bucket, start, sizes, least = bucket[fresh], first[fresh], sizes[fresh], ids[fresh]
    by = np.lexsort((start, least, bucket))  # neighbours in the text are packed better
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return Runs(bucket[by], start[by], sizes[by], least[by], first, rank[place])


def _cut_runs(bits: int, length: int, gram: int):
    def run(blocks: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            block = Block(row)
            own = shared_runs(block, shared, bits, length, gram)
            texts, ends = np.frombuffer(block.raw, np.uint8)[_spread(own.first, own.sizes)].tobytes(), np.r_[0, np.cumsum(own.sizes)].tolist()
            for b, s, e in own.buckets():
                out.append((b, block.number, _squeezed(texts[ends[s] : ends[e]]), _squeezed(own.sizes[s:e].astype("<u2").tobytes()), _squeezed(own.least[s:e].tobytes())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _RUNS.split(", ")])

    return run


def _resolve(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        lowest: list[int] = []
        own, leasts = [], [np.frombuffer(_loosened(x), np.int64) for x in rows["least"]]
        for texts, sizes, least in zip(rows["texts"], rows["sizes"], leasts, strict=True):
            texts, ends = _loosened(texts), np.cumsum(np.frombuffer(_loosened(sizes), "<u2").astype(np.int64)).tolist()
            mine, start = [], 0
            for end, i in zip(ends, least.tolist(), strict=True):
                at = number.setdefault(texts[start:end], len(lowest))
                if at == len(lowest):
                    lowest.append(i)
                elif i < lowest[at]:
                    lowest[at] = i
                mine.append(at)
                start = end
            own.append(np.array(mine, np.int64))
        value, strings = least_of_classes(list(number), np.array(lowest, np.int64), length)
        begin = np.cumsum(strings) - strings
        bits = []
        for mine, least in zip(own, leasts, strict=True):
            n = strings[mine]
            at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bits.append(_squeezed(np.packbits(value[at] < np.repeat(least, n)).tobytes()))
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "bits": bits})

    return run


def removed_bytes(block: Block, found: pd.DataFrame, bits: int, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which bytes of the block go. found: rows of the block's shared minimizers, and rows of the bits that came back for its runs."""
    edge = np.zeros(len(block.raw) + 1, np.int64)
    answer = found["bits"].notna()
    told = dict(found.loc[answer, ["bucket", "bits"]].itertuples(index=False))
    own = shared_runs(block, found[~answer], bits, length, gram)
    if not len(own.bucket):
        return edge[:-1] > 0
    strings = own.sizes - length + 1
    begin = np.cumsum(strings) - strings
    repeats = np.concatenate([np.unpackbits(np.frombuffer(_loosened(told[bucket]), np.uint8), count=int(strings[s:e].sum())) for bucket, s, e in own.buckets()]).astype(bool)
    later = block.ids[np.searchsorted(block.ends, own.starts, side="right")] > own.least[own.places]  # the block itself has it earlier
    n = strings[own.places]
    inner = _spread(np.zeros(len(n), np.int64), n)
    gone = repeats[np.repeat(begin[own.places], n) + inner] | np.repeat(later, n)
    at = (np.repeat(own.starts, n) + inner)[gone]
    edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + length, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def removals(docs: DataFrame, of_document: Callable, schema: str, carry: Column | None = None, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """of_document(doc_id, text as bytes, which of them go, carried string) as a tuple for each document, in schema.

    docs: doc_id and text. A null text is empty. Rows with a null doc_id are kept whole and are nobody's earlier
    document; rows with one doc_id are not earlier than each other. carry: a string that comes along. Texts shorter than
    `length` bytes stay whole.
    """
    n = shuffle_partitions(docs.sparkSession)
    bits = min(20, max(6, ceil(log2(4 * n))))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    blocks = stored(rows.mapInPandas(_pack_blocks, _BLOCKS), "blocks")
    minimizers = blocks.select("block", "n", "ids", "known", "sizes", "text").mapInPandas(_minimizers(bits, length, gram), _KEYS)
    shared = stored(minimizers.groupBy("bucket").applyInPandas(_shared(crowded), _SHARED), "shared")
    # one plan from here, so that both steps read one shuffle of the texts; runs are cut again rather than kept
    runs = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_cut_runs(bits, length, gram), _RUNS)
    told = runs.groupBy("bucket").applyInPandas(_resolve(length), _BITS)
    found = shared.unionByName(told, allowMissingColumns=True)
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def finish(own: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            block = Block(row)
            gone = removed_bytes(block, its, bits, length, gram)
            for i, known, s, e, c in zip(block.ids.tolist(), block.known.tolist(), (block.ends - block.sizes).tolist(), block.ends.tolist(), row.carried, strict=True):
                out.append(of_document(i if known else None, block.raw[s:e], gone[s:e], c))
        return pd.DataFrame(out, columns=names)

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(finish, schema)


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of removed bytes."""
    step = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True))


def kept_characters(text: bytes, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes go."""
    if not gone.any():
        return text.decode("utf-8", "surrogatepass")
    b = np.frombuffer(text, np.uint8)
    lead = np.flatnonzero((b & 0xC0) != 0x80)
    whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.r_[lead, len(b)]))
    return b[~whole].tobytes().decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with text cut to the characters that stay, and a column spans: the removed (start, end) in bytes.

    A character goes if all its bytes go. See removals for nulls and ties. All other columns come along as they are,
    through JSON; n_chars, if there, is counted anew, and a column named spans is replaced.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text", "spans")]
    packed = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in others])) if others else F.lit("{}")

    def of_document(i, text, gone, carried):
        return (None if i is None else str(i), kept_characters(text, gone), [{"start": s, "end": e} for s, e in spans(gone)], carried)

    out = removals(docs, of_document, "doc_id string, text string, spans array<struct<start:int,end:int>>, carried string", packed, length)
    out = out.withColumn("carried", F.from_json("carried", T.StructType(others)))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"carried.`{f.name}`").alias(f.name) for f in others if f.name != "n_chars"]]
    if "n_chars" in docs.columns:
        columns.append(F.length("text").cast("long").alias("n_chars"))
    return out.select(*columns, "spans").select(*docs.columns, "spans") if "spans" not in docs.columns else out.select(*columns, "spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated passages of 50 bytes, by the digest contract of operator 6."""

    def of_document(i, text, gone, _):
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return (None if i is None else str(i), len(text), int(gone.sum()), len(spans(gone)), hashlib.sha256(kept).hexdigest())

    out = removals(documents(spark, sf_dir).select("doc_id", "text"), of_document, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
