"""Rows of tokens and what queries find in them, in Arrow batches: an index row is a document with all its postings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.functions.text import CJK, token_text

#: Characters of texts that are cut at once, cells of queries and rows that are scored at once, and hits of those.
CHARACTERS, CELLS, HITS = 1_000_000, 1_000_000, 2_000_000
#: Steps of a score for each 1, and the last step, which has all higher scores.
STEPS, LAST_STEP = 4, 4095
INDEXED = ("len", "field", "token", "tf", "positions")
_RUNS = re.compile(f"[{CJK}]+|[^{CJK}]+")
_CJK = re.compile(f"[{CJK}]")


def _pieces(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of different pieces of text without spaces: all tokens; of each piece its first entry, entries and width; of each entry
    token and place. As token_runs has them, with a place left out behind each run."""
    n, mixed = len(pieces), pc.match_substring_regex(pieces, f"[{CJK}]").to_numpy(zero_copy_only=False)
    if not mixed.any():
        return pieces, np.arange(n), np.ones(n, np.int64), np.full(n, 2), np.arange(n), np.zeros(n, np.int64)
    whole = mixed & pc.match_substring_regex(pieces, f"^[{CJK}]{{2,}}$").to_numpy(zero_copy_only=False)
    mixed &= ~whole
    entries, width = np.ones(n, np.int64), np.full(n, 2)
    # runs of ideographs alone: pairs of code points
    own = pieces.filter(pa.array(whole))
    size = pc.utf8_length(own).to_numpy().astype(np.int64)
    code = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.repeat(np.cumsum(size) - size, size - 1) + (inner := _spread(np.zeros(len(size), np.int64), size - 1))
    pair, pair_at = np.unique((code[first] << 32) | code[np.minimum(first + 1, len(code) - 1)], return_inverse=True)
    entries[whole], width[whole] = size - 1, size
    # the others, of several runs
    words, places = [], []
    for i in np.flatnonzero(mixed).tolist():
        at, before = 0, len(words)
        for run in _RUNS.findall(pieces[i].as_py()):
            own_words = [run[k : k + 2] for k in range(len(run) - 1)] if len(run) > 1 and _CJK.match(run) else [run]
            words += own_words
            places += range(at, at + len(own_words))
            at += len(own_words) + 1
        entries[i], width[i] = len(words) - before, at
    plain = ~whole & ~mixed
    pairs = pa.array([chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in pair.tolist()], pa.string())
    coded = pa.concat_arrays([pieces.filter(pa.array(plain)).cast(pa.string()), pairs, pa.array(words, pa.string())]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    first = np.cumsum(entries) - entries
    token, place = np.zeros(entries.sum(), np.int64), np.zeros(entries.sum(), np.int64)
    token[first[plain]] = code[: plain.sum()]
    at = _spread(first[whole], entries[whole])
    token[at], place[at] = code[plain.sum() :][pair_at], inner
    at = _spread(first[mixed], entries[mixed])
    token[at], place[at] = code[plain.sum() + len(pair) :], places
    return coded.dictionary, first, entries, width, token, place


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of which there are n[i], one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lists(sizes: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _rows(ids: pa.Array, texts: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The index rows of rows that are in order of ids; those of one id make one, those without tokens none."""
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    fresh = np.r_[True, code[1:] != code[:-1]]
    group = np.cumsum(fresh) - 1
    cut = [pc.split_pattern(t, " ") for t in texts]
    n = np.stack([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in cut])  # field, row
    coded = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
    piece, different = coded.indices.to_numpy(), coded.dictionary
    own = np.repeat(np.arange(n.size), n.ravel())  # field and row of each piece
    if (none := pc.index(different, "").as_py()) >= 0:
        some = piece != none
        piece, own = piece[some], own[some]
    tokens, first, entries, width, token, place = _pieces(different)
    begin = np.cumsum(width[piece]) - width[piece]
    start = np.searchsorted(own, np.arange(n.size))
    begin = begin - np.r_[begin, 0][start][own]
    if tokens is different:
        token, at = piece, begin
    else:
        each = entries[piece]
        entry = _spread(first[piece], each)
        token, at, own = token[entry], np.repeat(begin, each) + place[entry], np.repeat(own, each)
    field, group = own // n.shape[1], group[own % n.shape[1]]
    key = (group * len(texts) + field) * max(1, len(tokens)) + token
    by = np.argsort(key, kind="stable") if fresh.all() else np.lexsort((at, key))
    key, at = key[by], at[by]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[new, len(key)])
    token, field, row = token[by][new], field[by][new], group[by][new]
    postings, length = np.bincount(row, minlength=fresh.sum()), np.bincount(row, tf, fresh.sum()).astype(np.int64)
    some = postings > 0
    arrays = [
        ids.take(pa.array(np.flatnonzero(fresh)[some])), pa.array(length[some]), _lists(postings[some], pa.array(field.astype(np.int8))),
        _lists(postings[some], tokens.take(pa.array(token))), _lists(postings[some], pa.array(tf.astype(np.int32))),
        _lists(postings[some], _lists(tf, pa.array(at.astype(np.int32)))),
    ]
    return pa.RecordBatch.from_arrays(arrays, names)


def index_rows(df: DataFrame, fields: dict[str, Column], id_col: str, parts: int) -> DataFrame:
    """(id, len, field, token, tf, positions): a row for each id with a token, with arrays that have an item for each posting.

    field is the place of a field in fields. Texts are shuffled by id once and are in order of it then, so rows of one id are
    one after another, and nothing is shuffled that is made of them.
    """
    names = [id_col, *INDEXED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            code = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = sum(pc.utf8_length(c).to_numpy().astype(np.int64) for c in t.columns[1:])
            cuts, size = [0], np.r_[0, np.cumsum(sizes)]
            for at in starts[1:]:
                if size[at] - size[cuts[-1]] >= CHARACTERS:
                    cuts.append(int(at))
            if starts[-1] > cuts[-1]:
                cuts.append(int(starts[-1]))
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield made(t.slice(s, e - s))
            held = t.slice(cuts[-1])  # the last id may go on
        if held is not None and held.num_rows:
            yield made(held)

    def made(t: pa.Table) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c.chunks) for c in t.columns]
        return _rows(columns[0], columns[1:], names)

    texts = df.select(id_col, *[token_text(c).alias(f"text{i}") for i, c in enumerate(fields.values())]).repartition(parts, id_col).sortWithinPartitions(id_col)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, len long, field array<tinyint>, token array<string>, tf array<int>, positions array<array<int>>"
    return texts.mapInArrow(run, schema)


class Asked(NamedTuple):
    """Queries: ids, of each query how many terms; of each term its feature, in order of queries and terms. A feature is a token or a phrase."""

    ids: list
    counts: np.ndarray
    features: np.ndarray
    phrases: list[tuple[str, ...]]


def asked_of(rows: list) -> Asked:
    """Queries of rows (query_id, tokens of each term in order of terms)."""
    number: dict[tuple[str, ...], int] = {}
    own = [[number.setdefault(tuple(t), len(number)) for t in r[1]] for r in rows]
    return Asked([r[0] for r in rows], np.array([len(x) for x in own], np.int64), np.array([f for x in own for f in x], np.int64), list(number))


class Hits:
    """Of a batch of index rows the features they have: rows, and in order of features and rows entries of row and weighted count."""

    def __init__(self, b: pa.RecordBatch, asked: Asked, weights: np.ndarray):
        singles = {p[0]: f for f, p in enumerate(asked.phrases) if len(p) == 1}
        phrases = {f: p for f, p in enumerate(asked.phrases) if len(p) > 1}
        words = list(dict.fromkeys(t for p in asked.phrases for t in p))
        self.rows, self.len = b.num_rows, b.column("len").to_numpy()
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("token")).to_numpy())
        at = pc.index_in(b.column("token").flatten(), value_set=pa.array(words, pa.string())).fill_null(-1).to_numpy()
        field = b.column("field").flatten().to_numpy()
        some = np.flatnonzero((at >= 0) & (weights[field] > 0))
        row, at, field = row[some], at[some].astype(np.int64), field[some].astype(np.int64)
        of = np.array([singles.get(w, -1) for w in words] or [-1], np.int64)[at]
        single = of >= 0
        tf = b.column("tf").flatten().to_numpy()[some]
        found = [(of[single], row[single], weights[field[single]] * tf[single])]
        if phrases:
            found += self._phrases(phrases, words, b.column("positions").flatten(), some, row, at, field, weights)
        feature, row, tf = (np.concatenate([x[i] for x in found]) for i in range(3))
        key = feature * max(1, self.rows) + row
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.tf = np.add.reduceat(tf[by], new) if len(new) else np.zeros(0)
        self.row = row[by][new]
        self.starts = np.searchsorted(feature[by][new], np.arange(len(asked.phrases) + 1))

    @staticmethod
    def _phrases(phrases, words, positions, some, row, at, field, weights):
        """Phrases are where their tokens follow each other: places of the rarest one, less its step, that the others have too."""
        number = {w: i for i, w in enumerate(words)}
        segment = (row * len(weights) + field) << 32
        begin = positions.offsets.to_numpy().astype(np.int64)
        n = np.diff(begin)[some]
        place = np.repeat(segment, n) + positions.flatten().to_numpy()[_spread(begin[some] - begin[0], n)]
        word = np.repeat(at, n)
        by = np.lexsort((place, word))
        place, cut = place[by], np.searchsorted(word[by], np.arange(len(words) + 1))
        for f, p in phrases.items():
            steps = sorted(((place[cut[number[t]] : cut[number[t] + 1]], s) for s, t in enumerate(p)), key=lambda x: len(x[0]))
            left = np.unique(steps[0][0]) - steps[0][1]
            for other, s in steps[1:]:
                if not len(left):
                    break
                i = np.searchsorted(other, left + s)
                left = left[np.r_[other, -1][i] == left + s]
            if len(left):
                yield np.full(len(left), f), (left >> 32) // len(weights), weights[(left >> 32) % len(weights)]

    def pairs(self, asked: Asked, parts: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, matched, score) of all pairs with a term; parts is what each entry adds to a score. The terms of a query are added in their order."""
        counts = np.diff(self.starts)[asked.features]
        ends = np.r_[0, np.cumsum(asked.counts)]
        hits = np.r_[0, np.cumsum(counts)][ends]
        most, q = max(1, CELLS // max(1, self.rows)), 0
        while q < len(asked.ids):
            stop = max(q + 1, min(q + most, int(np.searchsorted(hits, hits[q] + HITS, "right")) - 1))
            terms = slice(ends[q], ends[stop])
            n = counts[terms]
            entry = _spread(self.starts[asked.features[terms]], n)
            key = np.repeat(np.repeat(np.arange(stop - q), asked.counts[q:stop]), n) * self.rows + self.row[entry]
            matched = np.bincount(key, minlength=(stop - q) * self.rows)
            cell = np.flatnonzero(matched)
            score = np.zeros(len(cell)) if parts is None else np.bincount(key, parts[entry], (stop - q) * self.rows)[cell]
            yield q + cell // max(1, self.rows), cell % max(1, self.rows), matched[cell], score
            q = stop


def features_held(rows: DataFrame, asked: Asked, weights: list[float], columns: list[str]) -> DataFrame:
    """(feature, df): how many index rows have each feature."""
    w = np.array(weights)

    def run(batches):
        df = np.zeros(len(asked.phrases), np.int64)
        for b in batches:
            df += np.diff(Hits(b, asked, w).starts)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["feature", "df"])

    return rows.select(*columns).mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))


class Scoring(NamedTuple):
    """BM25: inverse document frequency of each feature, average length, k1, b."""

    idf: np.ndarray
    average: float
    k1: float
    b: float

    def parts(self, h: Hits) -> np.ndarray:
        idf = np.repeat(self.idf, np.diff(h.starts))
        return idf * h.tf * (self.k1 + 1) / (h.tf + self.k1 * (1 - self.b + self.b * h.len[h.row] / self.average))


class Best(NamedTuple):
    """Of each query from which score on its best rows lie, whether rows need all of its terms, and how many rows there are."""

    least: np.ndarray
    whole: np.ndarray
    total: np.ndarray


def scored_pairs(rows: DataFrame, asked: Asked, weights: list[float], scoring: Scoring | None, columns: list[str], query_type: pa.DataType, schema: str, best: Best | None = None, cut: bool = True) -> DataFrame:
    """(query_id, id, raw, matched, asked, total, near and further columns of the index rows) of all pairs with a term.

    With best those that need all terms and have not go, and with cut those that are not near, under the least score.
    """
    w, ids = np.array(weights), pa.array(asked.ids, query_type)
    names = ["query_id", columns[0], "raw", "matched", "asked", "total", "near"]
    extra = [c for c in columns[1:] if c not in INDEXED]

    def run(batches):
        for b in batches:
            h = Hits(b, asked, w)
            for query, row, matched, score in h.pairs(asked, scoring.parts(h) if scoring else None):
                near, total = np.ones(len(query), bool), np.zeros(len(query), np.int64)
                if best is not None:
                    near, total = score >= best.least[query], best.total[query]
                    some = (~best.whole[query] | (matched == asked.counts[query])) & (near | (not cut))
                    query, row, matched, score, near, total = (x[some] for x in (query, row, matched, score, near, total))
                q, r = pa.array(query), pa.array(row)
                own = [pa.array(x) for x in (score, matched.astype(np.int64), asked.counts[query], total, near)]
                yield pa.RecordBatch.from_arrays([ids.take(q), b.column(0).take(r), *own, *[b.column(c).take(r) for c in extra]], [*names, *extra])

    return rows.select(*columns).mapInArrow(run, schema)


def score_steps(rows: DataFrame, asked: Asked, weights: list[float], scoring: Scoring, columns: list[str]) -> DataFrame:
    """(query, whole, step, n): how many pairs each query has by steps of the score, with all of its terms or not."""
    w = np.array(weights)

    def run(batches):
        held = []

        def summed():
            key, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            own, at = np.unique(key, return_inverse=True)
            return own, np.bincount(at, n, len(own)).astype(np.int64)

        for b in batches:
            h = Hits(b, asked, w)
            for query, _, matched, score in h.pairs(asked, scoring.parts(h)):
                if len(query):
                    key = (2 * query + (matched == asked.counts[query])) * (LAST_STEP + 1) + np.minimum(np.floor(score * STEPS).astype(np.int64), LAST_STEP)
                    n = np.bincount(key - (low := key.min()))
                    own = np.flatnonzero(n)
                    held.append((own + low, n[own]))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held = [summed()]
        if held:
            key, n = summed()
            by = key // (LAST_STEP + 1)
            yield pa.RecordBatch.from_arrays([pa.array(by // 2), pa.array(by % 2 == 1), pa.array(key % (LAST_STEP + 1)), pa.array(n)], ["query", "whole", "step", "n"])

    return rows.select(*columns).mapInArrow(run, "query long, whole boolean, step long, n long").groupBy("query", "whole", "step").agg(F.sum("n").alias("n"))
