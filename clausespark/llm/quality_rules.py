"""Operator 5: quality rules as learned decision lists, in DataFrame functions alone.

Statistics of every text are built-in expressions. The labelled texts' statistics are cut into a few levels each and
counted into a contingency table of bounded size over all labels. Sequential covering grows conjunctions of thresholds
on one part of these counts, prunes them on the other, and the ordered rules become one Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import SPACE, documents, stored

SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: ratios of the statistics, so that they hold for any length of text.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbol_share": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines").cast("double"),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
}
#: Cut points of a feature, at most one more; the contingency table has 2 * (CUTS + 2) ** len(FEATURES) rows at most.
CUTS = 6


_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"


def _word_statistics() -> Column:
    """(n, repeated) for the column t: its words, and those within a 3-word window that occurs twice or more.

    Equal windows are next to each other once (hash, place) pairs are sorted; the places of those are sorted again, and
    each covers three words or up to the next one. aggregate() over one-element arrays binds a value to a name, so that
    no element of a lambda computes it again.
    """
    hashed = "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    pairs = f"array_sort(transform({hashed}, (h, i) -> struct(h, i)))"
    again = "filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].h = x.h))"
    covered = "aggregate(transform(at, (p, i) -> IF(i + 1 < size(at), least(3, at[least(i + 1, size(at) - 1)] - p), 3)), 0L, (a, x) -> a + x)"
    places = f"aggregate(array(array_sort(transform({again}, x -> x.i))), 0L, (zero, at) -> {covered})"
    repeated = f"CASE WHEN size(words) < 4 THEN 0L ELSE aggregate(array({pairs}), 0L, (none, s) -> {places}) END"
    return F.expr(f"aggregate(array({_WORDS}), named_struct('n', 0L, 'repeated', 0L), (none, words) -> named_struct('n', bigint(size(words)), 'repeated', {repeated}))")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    A null text has no words and zeros. Words are runs of anything but space and U+0009 to U+000D. word_chars: code
    points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a word that equal an earlier one;
    n_repeat_words: words in 3-word windows (compared by 64-bit hashes within the text) found twice or more in the text.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    t = t.select("doc_id", _word_statistics().alias("w"), F.translate("t", SPACE, "").alias("bare"), lines.alias("lines"))
    symbols = F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))
    t = t.select("doc_id", "w", F.length("bare").cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # as a generated row, so that a filter on the statistics is not pushed down to compute them for each of its conditions
    return t.select("doc_id", F.inline(F.array(F.struct(F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words")))))


def repeating() -> Column:
    return 100 * F.col("n_repeat_words") > 50 * F.col("n_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | repeating()


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = FEATURES[self.feature]()
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds that rejects."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + " -> reject"


@dataclass(frozen=True)
class Cells:
    """The contingency table: levels of each feature (a row for each cell), whether for pruning, bad and other rows."""

    levels: np.ndarray
    pruning: np.ndarray
    bad: np.ndarray
    good: np.ndarray


def contingency(labelled: DataFrame, target: str = "bad") -> tuple[dict[str, list[float]], Cells]:
    """Cut points of each feature, and the counts of all labelled rows by their levels.

    labelled: the statistics, doc_id and a boolean target. Cut points lie halfway between quantiles of the bad rows and
    the edges of the other rows. A third of the rows, by a hash of doc_id, is for pruning. The table is bounded by CUTS,
    whatever the number of labels.
    """
    named = labelled.select("doc_id", target, *[f().alias(k) for k, f in FEATURES.items()])
    shares = [0.01, *(i / CUTS for i in range(1, CUTS - 1)), 0.99]
    quantiles = lambda k, of, at: F.percentile_approx(F.when(of, F.col(k)), F.array(*map(F.lit, at)), 10_000)
    asked = [quantiles(k, F.col(target), shares).alias(f"{k}_bad") for k in FEATURES] + [quantiles(k, ~F.col(target), [0.01, 0.99]).alias(f"{k}_good") for k in FEATURES]
    row = named.agg(*asked).first()
    cuts = {}
    for k in FEATURES:
        at = sorted({*(row[f"{k}_bad"] or []), *(row[f"{k}_good"] or [])})
        cuts[k] = [(x + y) / 2 for x, y in zip(at, at[1:], strict=False)]
    level = lambda k: sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0))
    cells = named.select(target, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"), *[level(k).alias(k) for k in FEATURES])
    got = cells.groupBy("pruning", *FEATURES).agg(F.count_if(F.col(target)).alias("p"), F.count_if(~F.col(target)).alias("n")).collect()
    levels = np.array([[r[k] for k in FEATURES] for r in got], np.int64).reshape(-1, len(FEATURES))
    return cuts, Cells(levels, np.array([r.pruning for r in got], bool), np.array([r.p for r in got], np.int64), np.array([r.n for r in got], np.int64))


def learn_rules(cuts: dict[str, list[float]], cells: Cells, most: int = 8, precision: float = 0.9, support: int = 3) -> list[Rule]:
    """Sequential covering: grow a conjunction on the growing part, prune it on the other, take it while it is precise.

    A rule is kept if at least `precision` of the rows it rejects, in all and in the pruning part, are bad, and it
    rejects `support` bad rows. Rows that a rule rejects are gone for the next one.
    """
    names = list(FEATURES)
    tests = [(f, above, c) for f, k in enumerate(names) for c, above in product(range(len(cuts[k])), (False, True))]
    fits = [(cells.levels[:, f] > c) == above for f, above, c in tests]
    everywhere = np.ones(len(cells.bad), bool)

    def counts(where: np.ndarray) -> tuple[int, int]:
        return int(cells.bad[where].sum()), int(cells.good[where].sum())

    def all_of(chosen: list[int], where: np.ndarray) -> np.ndarray:
        for t in chosen:
            where = where & fits[t]
        return where

    def worth(chosen: list[int], left: np.ndarray) -> float:
        p, n = counts(all_of(chosen, left & cells.pruning))
        return (p - n) / (p + n) if p + n else -1.0

    rules, left = [], everywhere
    while len(rules) < most:
        chosen: list[int] = []
        here = left & ~cells.pruning
        p, n = counts(here)
        while p and n and len(chosen) < 4:
            best = (1e-12, -1)
            for t in range(len(tests)):
                p1, n1 = counts(here & fits[t])
                gain = p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n))) if p1 else 0.0
                if t not in chosen and gain > best[0] + 1e-12:
                    best = (gain, t)
            if best[1] < 0:
                break
            chosen.append(best[1])
            here = here & fits[best[1]]
            p, n = counts(here)
        while len(chosen) > 1 and worth(chosen[:-1], left) >= worth(chosen, left):
            chosen = chosen[:-1]
        where = all_of(chosen, left)
        (p, n), (q, m) = counts(where), counts(where & cells.pruning)
        if not chosen or p < support or p < precision * (p + n) or q < precision * (q + m):
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][c]) for f, above, c in map(tests.__getitem__, chosen))))
        left = left & ~where
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: false where a rule rejects, else true."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, statistics, base_failed, kept) of every document, and the rules behind kept.

    labels: (doc_id, quality); quality 0 is bad. Null qualities and doc_ids teach nothing, and so do rows whose base
    test fails, as no rule judges them; conflicting labels count each. Without usable labels there are no rules and kept
    is the base test alone. Repeated rows stay, null texts fail the base test. Other columns are left out.
    """
    s = stored(with_statistics(docs), "statistics").withColumn("base_failed", base_failed())
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    cuts, cells = contingency(s.where(~F.col("base_failed")).join(known, "doc_id"))
    rules = learn_rules(cuts, cells)
    return s.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def reject_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the learned rules reject and those that repeat themselves; short documents stay.

    All labelled rows teach. Rows and their statistics are stored once; labels join them, and the rules filter them as one
    expression. All columns stay; null texts are judged as empty ones, and rows with a null or repeated doc_id like others.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("t"))
    judged = stored(with_statistics(whole, "doc", "t").withColumnRenamed("doc_id", "doc"), "judged")
    rules = learn_rules(*contingency(judged.select(F.col("doc.doc_id").alias("doc_id"), *STATISTICS).join(known, "doc_id")))
    return judged.where(verdict(rules) & ~repeating()).select("doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict, by the contract of operator 5."""
    return judge_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
