"""Operator 10: byte-pair encoding by an index from pairs to their positions, and decoding.

Texts are cut into pretokens; the new distinct pretokens of a partition's batch are laid out as one sequence of
symbols. An index maps every mergeable pair, by its rank, to all its positions there. Ranks are applied in ascending
order, each to all its positions at once, and the neighbours' pairs are entered under their ranks. A merge only makes
pairs of its new symbol, so each pretoken sees the same merges in the same order as if it were encoded alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from clausespark.llm.common import documents

#: The pattern that cuts texts of this vocabulary into pretokens (a fixed value of the format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens that a worker remembers at most; then it starts anew. It bounds memory, not results.
REMEMBER = 400_000
_NONE = -1


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class PairIndexEncoder:
    """A byte-level BPE vocabulary file of the tokenizers library, encoded without that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = byte_characters()
        self.added = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda x: -len(x[0]))
        self.bytes_of = [b""] * (max([*vocab.values(), *(i for _, i in self.added)]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in self.added:
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in of.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.base = np.int64(len(self.bytes_of))
        keys = np.array([vocab[a] for a, _ in pairs], np.int64) * self.base + np.array([vocab[b] for _, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cut = regex.compile(PRETOKEN).findall
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t, _ in self.added) + ")").split if self.added else None
        self.added_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.added}
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], _NONE)

    def _enter(self, index: dict[int, list[np.ndarray]], active: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks >= 0
        at, ranks = at[keep], ranks[keep]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, s, e in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            if r in index:
                index[r].append(at[s:e])
            else:
                index[r] = [at[s:e]]
                heapq.heappush(active, r)

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        filled = sizes > 0
        nxt[ends[filled] - 1] = _NONE
        prv[(ends - sizes)[filled]] = _NONE
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        at = np.flatnonzero(nxt >= 0)
        self._enter(index, active, at, self._rank(sym[at], sym[at + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            q = nxt[p]
            ok = (sym[p] == a) & (q >= 0)
            ok[ok] = sym[q[ok]] == b
            p, q = p[ok], q[ok]
            if a == b and len(p) > 1:  # of a run of equal symbols every other pair, from the left
                if np.any(p[1:] < p[:-1]):
                    p = np.unique(p)
                    q = nxt[p]
                chained = np.r_[False, q[:-1] == p[1:]]
                starts = np.flatnonzero(~chained)
                nth = np.arange(len(p)) - starts[np.cumsum(~chained) - 1]
                p, q = p[nth % 2 == 0], q[nth % 2 == 0]
            if not len(p):
                continue
            after = nxt[q]
            sym[p] = self.made[r]
            sym[q] = _NONE
            nxt[p] = after
            inner = after >= 0
            prv[after[inner]] = p[inner]
            before = prv[p]
            lefts = np.concatenate((before[before >= 0], p[inner]))
            self._enter(index, active, lefts, self._rank(sym[lefts], sym[nxt[lefts]]))
        live = np.flatnonzero(sym >= 0)
        ids = sym[live].astype("<u4").tobytes()
        cuts = (np.searchsorted(live, ends) * 4).tolist()
        return [ids[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; added tokens in a text become their ids."""
        pieces, known = [], self.known
        for t in texts:
            if self.cut_added and any(x in t for x, _ in self.added):
                own: list[str] = []
                for i, part in enumerate(self.cut_added(t)):
                    own += [part] if i % 2 else self.cut(part)
                pieces.append((own, True))
            else:
                pieces.append((self.cut(t), False))
        if len(known) > REMEMBER:
            known.clear()
        new: dict[str, None] = {}
        for own, _ in pieces:
            new.update(dict.fromkeys(w for w in own if w not in known))
        known.update(self.added_ids)
        words = [w for w in new if w not in known]
        known.update(zip(words, self.encode_pretokens(words), strict=True))
        return [b"".join(map(known.__getitem__, own)) for own, _ in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """The encoder of a vocabulary file, one for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(path)
    return _ENCODERS[path]


#: Characters of text that are encoded together.
TOGETHER = 8 << 20


def slices(texts: list[str]):
    """Runs of texts (start, end) of about TOGETHER characters, so that long texts do not add up in memory."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= TOGETHER:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as binary of little-endian unsigned 32-bit integers, decoded text of these ids.

    A null text is empty: no ids, empty decoded text. Ids may be null or repeat; each row is encoded for itself. Other
    columns are left out. No shuffle.
    """

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            for s, t in slices(texts):
                ids = e.encode_batch(texts[s:t])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s:t].to_numpy(), "ids": ids, "decoded": [e.decode(x) for x in ids]})

    rows = docs.selectExpr(f"cast(`{id_col}` as string) as doc_id", f"`{text_col}` as text")
    return rows.mapInPandas(run, "doc_id string, ids binary, decoded string").selectExpr("cast(doc_id as long) as doc_id", "ids", "decoded")


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_documents, digested where the ids are made."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            for s, t in slices(texts):
                ids = e.encode_batch(texts[s:t])
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[s:t].to_numpy(),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(e.decode(x).encode("utf-8")).hexdigest() for x in ids],
                })

    rows = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    out = rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.selectExpr("cast(doc_id as long) as doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text of documents encoded and decoded, by the digest contract of operator 10."""
    import public_tokenizers

    return digest_documents(documents(spark, sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
