"""Operator 13: fill-in-middle transformation over piece tables.

A document is a table of descriptors (buffer, start, length) over immutable buffers: its own text, and the sentinels. Cutting
splits a descriptor in two, an arrangement permutes the table with the sentinels' descriptors, and restoring cuts an output at
its sentinels and applies the inverse permutation. Tables are columns; only spelling one out, whose hash takes the pieces one
after another, reads the buffers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The buffer of sentinels, each of three characters. None begins or ends within another, so the first match is the sentinel.
MARKS = PREFIX + SUFFIX + MIDDLE
#: Places in a document's table: prefix, middle, suffix, and the three sentinels.
ORDERS = {"plain": [1, 2, 3], "psm": [4, 1, 5, 3, 6, 2], "spm": [5, 3, 4, 1, 6, 2]}
#: Rows spelled out before they are handed on.
ROWS = 128


def piece(buffer: str, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def split_piece(p: Column, at: Column) -> tuple[Column, Column]:
    """The descriptors of the first `at` characters of a piece and of the rest."""
    cut = lambda start, length: F.struct(p["buffer"].alias("buffer"), start.alias("start"), length.alias("length"))
    return cut(p["start"], at.cast("long")), cut(p["start"] + at, p["length"] - at)


def order_of(form: Column) -> Column:
    by = {k: F.array(*[F.lit(i) for i in v]) for k, v in ORDERS.items()}
    return F.when(form == "psm", by["psm"]).when(form == "spm", by["spm"]).otherwise(by["plain"])


def arrange(table: Column, order: Column) -> Column:
    """The pieces of a table in the given order of places."""
    return F.transform(order, lambda i: F.element_at(table, i))


def arrange_back(table: Column, order: Column, places: int = 3) -> Column:
    """The first places of the table that arrange() brought into this order."""
    return F.transform(F.array(*[F.lit(i) for i in range(1, places + 1)]), lambda i: F.element_at(table, F.array_position(order, i).cast("int")))


def spelled(df: DataFrame, buffer: str, table: str, text: str, digest: str) -> DataFrame:
    """df with table's pieces spelled out over the column buffer as column text, their SHA-256 as digest, and without both."""
    kept = [c for c in df.columns if c not in (buffer, table)]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                texts, digests = [], []
                for own, pieces in zip(part.column(buffer).to_pylist(), part.column(table).to_pylist(), strict=True):
                    h, found = hashlib.sha256(), []
                    for p in pieces:
                        source = own if p["buffer"] == "text" else MARKS
                        found.append(source[p["start"] : p["start"] + p["length"]])
                        h.update(found[-1].encode())
                    texts.append("".join(found))
                    digests.append(h.hexdigest())
                columns = [part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, text, digest])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    return df.mapInArrow(run, f"{fields}, `{text}` string, `{digest}` string")


def fill_in_middle(docs: DataFrame, rate: int = 90, suffix_first: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of every row of docs.

    Cuts and forms come from the SHA-256 of the seed and the doc_id: rate in 100 texts are arranged, suffix_first in 100 of them
    with the suffix first. Empty texts and those that hold a sentinel are plain; so are null texts, which count as empty. A null
    doc_id counts as an empty number. Repeated rows each have a row; other columns are left out. Lengths are in code points.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    # a column for each step, as an expression of several uses is evaluated for each
    d = d.select("doc_id", "text", F.length("text").cast("long").alias("n"), h.alias("h"))
    word = lambda i: F.conv(F.substring("h", 8 * i - 7, 8), 16, 10).cast("long")
    d = d.select("doc_id", "text", "n", *[word(i).alias(f"h{i}") for i in range(1, 5)])
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | (F.col("h3") % 100 >= rate) | marked, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    d = d.select("doc_id", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"), "text")
    head, suffix = split_piece(piece("text", F.lit(0), F.col("n")), F.col("second"))
    prefix, middle = split_piece(head, F.col("first"))
    marks = [piece("marks", F.lit(MARKS.index(m)), F.lit(len(m))) for m in (PREFIX, SUFFIX, MIDDLE)]
    cut = lambda c: F.when(F.col("form") != "plain", c)
    d = d.select(
        "doc_id", "n", "form", cut(F.col("first")).alias("prefix_chars"), cut(F.col("second") - F.col("first")).alias("middle_chars"),
        "text", arrange(F.array(prefix, middle, suffix, *marks), order_of(F.col("form"))).alias("pieces"),
    )
    return spelled(d, "text", "pieces", "output", "output_sha256")


def restore(arranged: DataFrame) -> DataFrame:
    """arranged (form, output and others) with column text, rebuilt from form and output alone, and text_sha256; without output."""
    order, after = order_of(F.col("form")), F.when(F.col("form") == "spm", PREFIX).otherwise(SUFFIX)
    # the places of the second and the third sentinel of an output; the first one starts it
    second = F.expr("instr(output, second_mark) - 1")
    d = arranged.withColumn("second_mark", after)
    d = d.withColumn("second_at", second).withColumn("third_at", F.expr(f"instr(output, '{MIDDLE}') - 1")).withColumn("length", F.length("output"))
    at = [F.lit(0), F.lit(3), F.col("second_at"), F.col("second_at") + 3, F.col("third_at"), F.col("third_at") + 3, F.col("length")]
    cut = F.array(*[piece("text", a, z - a) for a, z in zip(at, at[1:], strict=False)])
    whole = F.array(piece("text", F.lit(0), F.col("length")))
    d = d.withColumn("pieces", F.when(F.col("form") == "plain", whole).otherwise(arrange_back(cut, order)))
    return spelled(d.drop("second_mark", "second_at", "third_at", "length"), "output", "pieces", "text", "text_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and arranged, and restored from its output, by the contract of operator 13."""
    out = restore(fill_in_middle(documents(spark, sf_dir)))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("text_sha256").alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
