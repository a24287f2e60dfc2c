import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from clausespark.llm import jaccard
from clausespark.llm.jaccard import bitmap, jaccard_components, op11_jaccard_join, part_keys, shingle_set, tree_pairs


def brute(rows, width=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, first = defaultdict(list), {}
    for x, s in enumerate(sets):
        if s in first:
            root[find(x)] = find(first[s])
        elif s:
            first[s] = x
            common = defaultdict(int)
            for t in s:
                for y in held[t]:
                    common[y] += 1
                held[t].append(x)
            for y, n in common.items():
                if 100 * n >= percent * (len(s) + len(sets[y]) - n):
                    root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted([(i, len(sets[x]), least.get(find(x))) for x, (i, _) in enumerate(rows)], key=str)


def check(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(parts)
    got = sorted(map(tuple, jaccard_components(docs, **options).collect()), key=str)
    assert got == brute(rows, **options)
    return got


def edited(words, n, rng):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"e{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [85, 60])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        other = np.unique(np.r_[rng.permutation(base)[: len(base) - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)), np.uint64)])
        common = len(np.intersect1d(base, other))
        if 100 * common >= percent * (len(base) + len(other) - common) and not np.array_equal(base, other):
            assert np.intersect1d(part_keys(base, percent), part_keys(other, percent)).size


def test_given_and_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    odd = [None, "", " \n\t", "one", "ONE", "two words", "a b c", "a b c d", "A B c d", "é ö ü ß x", "no break space here now", long, long + " more", "x " * 5000]
    check(spark, rows + [(9000 + i, t) for i, t in enumerate(odd)] + [(None, "a b c d"), (None, "alone of its kind here"), (9007, "a b c d"), (9007, "another text of four")])


def test_pairs_at_the_limit(spark):
    rng, rows = np.random.default_rng(5), []
    for n in (7, 8, 13, 20, 27, 40, 64, 100, 127, 128, 250, 600):
        for edits in range(0, n // 40 + 3):
            for _ in range(4):
                base = [f"{rng.integers(1 << 40)}" for _ in range(n + 3)]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, edited(base, edits, rng))]
    got = check(spark, rows)
    assert 100 < sum(c != i for i, _, c in got) < len(rows) // 2


def test_groups_shared_passages_and_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng, rows = np.random.default_rng(6), []
    base = [f"b{i}" for i in range(120)]
    rows += [(len(rows) + i, edited(base, int(rng.integers(1, 9)), rng)) for i in range(150)]
    rows += [(1000 + i, " ".join(f"p{k}" for k in range(60)) + " " + " ".join(f"{rng.integers(1 << 40)}" for _ in range(30))) for i in range(150)]
    rows += [(2000 + i, "same text many times over and over") for i in range(200)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(3000 + i, " ".join(chain[i * 5 : i * 5 + 200])) for i in range(20)]
    check(spark, rows)


def test_tree_keeps_every_pair_that_links_and_prunes():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 64, int(rng.integers(40, 160)), np.uint64))
        sets += [base] + [np.unique(np.r_[base[int(rng.integers(0, 9)) :], rng.integers(0, 1 << 64, 3, np.uint64)]) for _ in range(2)]
    rows = pd.DataFrame({"gid": np.arange(len(sets)), "n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets], "component": np.arange(len(sets)), "side": 0, "key": 7, "keys": [[7, 9]] * len(sets)})
    found = set(map(tuple, tree_pairs(rows, 85).to_numpy().tolist()))
    size = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * size(i, j) >= 85 * (len(sets[i]) + len(sets[j]) - size(i, j))}
    assert linked <= found and len(found) < 400 < len(sets) * (len(sets) - 1) // 2
    one = rows.assign(component=0)
    assert tree_pairs(one, 85).empty
    assert tree_pairs(rows.assign(keys=[[5, 7]] * len(sets)), 85).empty  # met under another key


def test_empty_table_and_registered_query(spark, tmp_path):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(4, "a b c d e f g h"), (2, "A b c d e f g h"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_jaccard_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, got.collect())) == [(2, 5, 2), (4, 5, 2), (7, 0, 7)]
    assert len(shingle_set(None)) == 0
