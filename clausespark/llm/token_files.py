"""Operator 4: token ids in files of canonical length-limited Huffman codes.

File format. A folder holds `codes` (id, bits): the code length of every id that occurs, from global counts; codes are
canonical, so lengths say all. `blocks` holds the packed ids, part files in ascending doc_id order, one row a block:
part, block (its number within the part), local_start (ids of the part before it), n_tokens, doc_ids and doc_tokens
(whole documents), bits (codes, first bit highest) and checkpoints (bit offset of every CHECKPOINT-th id, as unsigned
32-bit integers). Blocks decode independently; the decoder takes all checkpoints of a block forward side by side, one
table look-up an id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from math import ceil, log2
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import documents, new_path, shuffle_partitions, stored

MAX_BITS = 16
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 256
END = 2
#: Pieces and their characters that a worker remembers at most; then it starts anew. It bounds memory, not results.
REMEMBER, REMEMBER_CHARS = 1_000_000, 16 << 20
_BLOCKS = "part int, block int, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, bits binary, checkpoints binary"
_WORKER: dict = {}


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (more if that many codes need it) by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(max_bits, ceil(log2(n)))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2]
        merged = np.concatenate((leaves, pairs[0::2] + pairs[1::2]))
        by = np.argsort(merged, kind="stable")
        items = merged[by]
        kinds.append(by < n)
    take = 2 * n - 2
    depth = np.zeros(n + 1, np.int64)
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        depth[0] += 1
        depth[own] -= 1
        take = 2 * (take - own)
    lengths[order] = np.cumsum(depth[:n])
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every id: shorter codes first, ids in order within a length."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    order = np.flatnonzero(lengths)
    for i in order[np.argsort(lengths[order], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints) of one block."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(n.sum())
    word = codes[ids].astype(np.int64) << (32 - (at & 7) - n)
    out = np.zeros(total // 8 + 5, np.float64)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=(word >> (24 - 8 * k)) & 255, minlength=len(out))
    return out.astype(np.uint8)[: (total + 7) // 8].tobytes(), at[::CHECKPOINT].astype("<u4").tobytes()


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each sequence of the longest code's bits: the id it starts with and the bits of that id's code."""
    width = int(lengths.max(initial=1))
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    ids[: spans.sum()] = np.repeat(order, spans)
    bits[: spans.sum()] = np.repeat(lengths[order].astype(np.int64), spans)
    return ids, bits, width


def unpack(bits: bytes, checkpoints: bytes, n_tokens: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of one block."""
    ids, lengths, width = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.int64)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    mask, last = (1 << width) - 1, len(word) - 1
    for step in range(min(CHECKPOINT, n_tokens)):
        key = (word[np.minimum(at >> 3, last)] >> (32 - width - (at & 7))) & mask
        out[step] = ids[key]
        at = at + lengths[key]
    return out.T.reshape(-1)[:n_tokens]


#: Letters, digits and white space by which a comma or full stop is a pretoken of its own, whatever normalising does: ASCII,
#: and Latin letters that stay one letter in lower case.
_PLAIN = r"0-9A-Za-z \n\t\rÀ-ÖØ-öø-įı-ɏ"
#: A comma or full stop next to anything else: such texts, and those with apostrophes, keep their symbols in place.
_BOUND_SYMBOLS = re.compile(f"[,.](?:(?<=[^{_PLAIN}].)|[^{_PLAIN}])").search


def _pieces(text: str) -> list[str]:
    """The text cut at white space, where no pretoken crosses, and written alike where that leaves its ids alone.

    Lower-casing first gives the same ids for normalized texts without final sigma or the added tokens' "<|"; commas and
    full stops between _PLAIN characters are pretokens of their own.
    """
    if "<|" not in text and "Σ" not in text:
        low = text.lower()
        if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low):
            text = low
        if "'" not in text and not _BOUND_SYMBOLS(text):
            text = text.replace(",", " , ").replace(".", " . ")
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _library(vocabulary: str):
    """The tokenizer, which of its ids end a pretoken, the pieces known so far and how many characters they have."""
    if vocabulary not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.no_truncation()
        t.no_padding()
        suffix = json.loads(t.to_str())["model"].get("end_of_word_suffix")
        ends = np.array([bool(suffix) and (t.id_to_token(i) or "").endswith(suffix) for i in range(t.get_vocab_size())])
        _WORKER[vocabulary] = (t, ends, {"": b""}, [0])
    return _WORKER[vocabulary]


def encode_texts(texts: list[str], vocabulary: str, kind: str) -> list[bytes]:
    """The library's ids of each text; a piece between white space is encoded once, words of letters many at a time."""
    tokenizer, ends, known, held = _library(vocabulary)
    if len(known) > REMEMBER or held[0] > REMEMBER_CHARS:
        known.clear()
        known[""] = b""
        held[0] = 0
    cut = [_pieces(t) for t in texts]
    new = set().union(*cut).difference(known)
    held[0] += sum(map(len, new))
    words = [w for w in new if w.isalpha()]
    for s in range(0, len(words), 2000):
        part = words[s : s + 2000]
        ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, kind)
        last = np.flatnonzero(ends[ids])
        if len(last) == len(part):  # a pretoken each
            raw, width, at = ids.tobytes(), ids.itemsize, 0
            for w, e in zip(part, ((last + 1) * width).tolist(), strict=True):
                known[w] = raw[at:e]
                at = e
    words = [w for w in new if w not in known]
    for s in range(0, len(words), 20_000):
        part = words[s : s + 20_000]
        known.update((w, np.array(x.ids, kind).tobytes()) for w, x in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
    return [b"".join(map(known.__getitem__, own)) for own in cut]


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = END, vocabulary_size: int = 49_408) -> DataFrame:
    """(doc_id, ids) of documents: the library's ids, then end_id; 2 bytes an id, 4 if the vocabulary needs that.

    A null text is empty and has end_id alone. Null and repeated doc_ids are kept. Other columns are left out.
    """
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            for s in range(0, len(texts), 1000):
                ids = encode_texts(texts[s : s + 1000], vocabulary, kind)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s : s + 1000].to_numpy(), "ids": [x + end for x in ids]})

    rows = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    return rows.mapInPandas(run, "doc_id string, ids binary").selectExpr("cast(doc_id as long) as doc_id", "ids")


def write_token_files(ids: DataFrame, path: str, vocabulary_size: int = 49_408, max_bits: int = MAX_BITS) -> None:
    """Write (doc_id, ids) to path in the file format above, null doc_ids first, repeated ones by their ids."""
    spark = ids.sparkSession
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def count(batches):
        n = np.zeros(vocabulary_size, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b["ids"]), kind), minlength=vocabulary_size)
        yield pd.DataFrame({"id": np.flatnonzero(n), "n": n[n > 0]})

    counts = np.zeros(vocabulary_size, np.int64)
    # as many rows as the vocabulary has at most
    for r in ids.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    codes = canonical_codes(lengths)
    book = pd.DataFrame({"id": np.flatnonzero(lengths), "bits": lengths[lengths > 0].astype(np.int32)})
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = start = held = 0
        docs, sizes, own = [], [], []

        def close():
            nonlocal number, start, held, docs, sizes, own
            bits, checkpoints = pack(np.concatenate(own), codes, lengths)
            row = pd.DataFrame({"part": [part], "block": [number], "local_start": [start], "n_tokens": [held], "doc_ids": [docs], "doc_tokens": [sizes], "bits": [bits], "checkpoints": [checkpoints]})
            number, start, held, docs, sizes, own = number + 1, start + held, 0, [], [], []
            return row

        for b in batches:
            for i, x in zip(b["doc_id"], b["ids"], strict=True):
                a = np.frombuffer(x, kind)
                docs.append(None if i is None else int(i))
                sizes.append(len(a))
                own.append(a)
                held += len(a)
                if held >= BLOCK_TOKENS:
                    yield close()
        if docs:
            yield close()

    ranged = ids.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    packed = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(blocks, _BLOCKS)
    packed.write.option("compression", "none").parquet(f"{path}/blocks")


def _decoded(spark: SparkSession, path: str, row_of, schema: str) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    # a row for each part file: their number is bounded by the partitions written
    before, starts = 0, {}
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[r.part] = before
        before += r.n
    book = spark.read.parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy(np.uint8)

    def run(batches):
        table = decoding_table(lengths)
        for b in batches:
            for part, local, n, docs, sizes, bits, checkpoints in zip(*(b[c] for c in ("part", "local_start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints")), strict=True):
                ids = unpack(bytes(bits), bytes(checkpoints), int(n), table)
                sizes = np.asarray(sizes, np.int64)
                ends = np.cumsum(sizes)
                first = starts[part] + int(local)
                own = [None if pd.isna(d) else str(int(d)) for d in docs]
                yield pd.DataFrame({"doc_id": own, "start": first + ends - sizes, "n_tokens": sizes} | row_of([ids[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]))

    out = blocks.select("part", "local_start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints").mapInPandas(run, f"doc_id string, start long, n_tokens long, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before it."""
    return _decoded(spark, path, lambda own: {"ids": [x.astype(np.int32).tolist() for x in own]}, "ids array<int>")


def op4_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every text of documents written to token files and read back, by the digest contract of operator 4."""
    import public_tokenizers

    ids = stored(token_ids(documents(spark, sf_dir), vocabulary or public_tokenizers.path("word_bpe_49k.json")), "token-ids")
    path = new_path(spark, "token-files")
    write_token_files(ids, path)
    return _decoded(spark, path, lambda own: {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own]}, "ids_crc32 long")
