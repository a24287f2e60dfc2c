"""Operators 2, 4, 8 and 10 against brute force, on nulls, empty and long texts, ties and repeated rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausespark.llm import bpe, packing, token_files, topk

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, ids string, bits string"
TEXTS = [None, "", " ", "a", "The the, THE. it's we'll <|endoftext|>  x\n\n y", "aaaa aaaaaaa " * 50, "é́ İ ß Σ ὈΔΥΣΣΕΎΣ 日本語 😀😀 １２ \x1c\x85", "word " * 20_000, "x" * 5000, "word " * 20_000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark):
    t = library("byte_bpe_50k.json")
    got = bpe.encode_documents(docs(spark), P.path("byte_bpe_50k.json")).collect()
    want = sorted((t.encode(x or "", add_special_tokens=False).ids, x or "") for x in TEXTS)
    assert sorted((np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == want
    assert bpe.encode_documents(docs(spark).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 1000)
    t = library("word_bpe_49k.json")
    token_files.write_token_files(token_files.token_ids(docs(spark), P.path("word_bpe_49k.json")), str(tmp_path / "f"))
    got = token_files.read_token_files(spark, str(tmp_path / "f")).collect()
    ids = {i if i != 3 else None: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(TEXTS)}
    start = 0
    for r in sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id):
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids[r.doc_id]), ids[r.doc_id])
        start += r.n_tokens
    token_files.write_token_files(token_files.token_ids(docs(spark).limit(0), P.path("word_bpe_49k.json")), str(tmp_path / "g"))
    assert token_files.read_token_files(spark, str(tmp_path / "g")).count() == 0


def test_ids_equal_library_next_to_any_character():
    t, path = library("word_bpe_49k.json"), P.path("word_bpe_49k.json")
    chars = [chr(c) for c in [*range(0x3400), *range(0xA000, 0xD800, 11), *range(0xE000, 0x30000, 17)]]
    for form in ("a{}. b", "a.{}b", "{},x A", "Café {}.Y", "x, {} .É{}"):
        texts = [form.replace("{}", c) for c in chars]
        want = t.encode_batch(texts, add_special_tokens=False)
        assert [x for x, a, b in zip(texts, token_files.encode_texts(texts, path, "<u2"), want, strict=True) if a != np.array(b.ids, "<u2").tobytes()] == []


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 16), (2, 16), (5, 3), (300, 9), (4000, 14)):
        counts = (rng.pareto(1, n) * 10).astype(np.int64) + 1
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and abs(sum(2.0 ** -lengths.astype(float)) - (1 if n > 1 else 0.5)) < 1e-9
        ids = rng.integers(0, n, 1000)
        packed = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
        assert (token_files.unpack(*packed, len(ids), token_files.decoding_table(lengths)) == ids).all()
    free = token_files.code_lengths(np.array([1, 1, 2, 3, 5, 8, 13]), 16)
    assert free.tolist() == [6, 6, 5, 4, 3, 2, 1]
    assert zlib.crc32(b"") == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(30):
        cells = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 9, len(cells))
        cost = lambda ends: sum(int(n) * min(e for e in ends if e >= c) for c, n in zip(cells.tolist(), counts, strict=True))  # noqa: B023, E731
        best = min(cost((*some, int(cells[-1]))) for k in range(min(3, len(cells))) for some in combinations(cells[:-1].tolist(), k))
        assert cost(packing.optimal_boundaries(cells, counts, 3)) == best


def test_packing(spark):
    texts = [None, "", *["w " * n for n in (1, 1, 2, 3, 50, 51, 400, 70_001)]]
    got = packing.pack_documents(docs(spark, texts), buckets=3, budget=100).collect()
    assert len(got) == len(texts)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) for t in texts)
    assert all(r.bucket_tokens >= r.n_tokens for r in got)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert all((r.slot + 1) * max(1, r.bucket_tokens) <= 100 or r.slot == 0 for r in got)
    assert packing.pack_documents(docs(spark, texts).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (None, [0.5] * 8), (303, rows[0][1]), (304, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, 5).collect()
    w = {i: np.floor(64 * np.array(v + [0.0] * (8 - len(v)))).astype(int) for i, v in rows if i is not None and i not in (300, 301, 302)}
    want = []
    for q in [i for i in w if i % 20 == 0]:
        s = sorted((-int(w[q] @ w[c]), c) for c in w if c != q)[:5]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
