"""what operator 6 writes and shuffles."""

import numpy as np

from clausespark.llm import suffix_dedup
from clausespark.llm.common import stored


def test_texts_are_shuffled_once_and_runs_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: (kept.append(name), stored(df, name))[1])
    rng = np.random.default_rng(2)
    words = lambda: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 60))
    same = words()
    docs = spark.createDataFrame([(i, f"{words()} {same}") for i in range(40)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(docs)
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[0].endswith(same) and not any(same[:60] in rows[i] for i in range(1, 40))
    assert kept == ["blocks", "shared"]
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_equal_runs_of_a_block_are_one(monkeypatch):
    """Runs are told apart by their bytes: with all hashes of parts equal, which runs are the same comes out alike (F2)."""
    import numpy as np
    import pandas as pd

    from clausespark.llm import suffix_dedup as s

    class Row:
        block, text = 0, None

    words = ["the quick brown fox jumps over the lazy dog and runs away from it all ", "another passage that is long enough to be a string of fifty bytes or more "]
    docs = [(words[0] + words[1] * (i % 3) + str(i) * 9).encode() for i in range(12)]
    Row.ids, Row.known = np.arange(12).tobytes(), np.ones(12, bool).tobytes()
    Row.sizes, Row.text = np.array([len(d) for d in docs]).tobytes(), s.zstandard.ZstdCompressor().compress(b"".join(docs))
    block = s.Block(Row)
    key = np.unique(s._bucket_key(s.runs_of(block)[3], 6))
    bucket = (key >> np.uint64(32)).astype(int)
    shared = pd.DataFrame([{"bucket": b, "keys": key[bucket == b].astype("<u4").tobytes(), "crowded": bytes((bucket == b).sum())} for b in np.unique(bucket).tolist()])

    def runs():
        own = s.shared_runs(block, shared, 6, s.LENGTH, s.GRAM)
        texts = [block.raw[a : a + n] for a, n in zip(own.first.tolist(), own.sizes.tolist(), strict=True)]
        return own, texts

    own, texts = runs()
    pairs = list(zip(own.bucket.tolist(), texts, strict=True))
    assert len(set(pairs)) == len(pairs) < len(own.starts)
    assert all(block.raw[a : a + len(texts[p])] == texts[p] for a, p in zip(own.starts.tolist(), own.places.tolist(), strict=True))
    real = s._runs_and_hashes
    monkeypatch.setattr(s, "_runs_and_hashes", lambda *x: (*real(*x)[:4], np.zeros_like(real(*x)[4])))
    other, again = runs()
    assert set(zip(other.bucket.tolist(), again, strict=True)) == set(pairs)
    assert all(block.raw[a : a + len(again[p])] == again[p] for a, p in zip(other.starts.tolist(), other.places.tolist(), strict=True))
