"""Scans of the library's input formats and writes of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausespark.functions.text import build_embed_text, chunks, plain_text
from clausespark.tables import new_path, stored

# Fixed values that results depend on.
KINDS = {"同义词": "synonym", "别名": "alias", "易混": "confusable", "synonym": "synonym", "alias": "alias", "confusable": "confusable"}
HEADERS = {"kind": ["kind", "类型"], "canonical": ["canonical", "标准词"], "variants": ["variants", "变体"], "distinguish": ["distinguish", "区别"]}
RECORD = (
    "doc_id bigint, record int, result struct<layoutParsingResults: array<struct<prunedResult: struct<width: int, height: int, parsing_res_list: "
    "array<struct<block_label: string, block_content: string, block_bbox: array<int>, block_order: int, global_block_id: int>>>>>>"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return new_path(spark, name)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file as one document."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_hash): every file with the SHA-256 of its bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("file_hash"))


def known_files(files: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, file_hash, spec_id): files with the spec that came from the same bytes, null for a new file; the smallest id of several."""
    known = specs.where("file_hash <> ''").groupBy("file_hash").agg(F.min("id").alias("spec_id"))
    return files.select("path", "file_hash").join(known, "file_hash", "left").select("path", "file_hash", "spec_id")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Records of recognised pages, malformed lines left out."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def ocr_blocks(records: DataFrame) -> DataFrame:
    """(doc_id, page, at, label, content, bbox, order, block_id): pages are numbered on across a document's records."""
    pages = records.select("doc_id", "record", F.posexplode_outer("result.layoutParsingResults").alias("in_record", "p")).where("p is not null")
    w = Window.partitionBy("doc_id").orderBy("record", "in_record")
    pages = pages.withColumn("page", F.row_number().over(w))
    b = pages.select("doc_id", "page", F.posexplode("p.prunedResult.parsing_res_list").alias("at", "b"))
    return b.select("doc_id", "page", "at", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), F.col("b.block_bbox").alias("bbox"), F.col("b.block_order").alias("order"), F.col("b.global_block_id").alias("block_id"))


def read_lexicon_csv(spark: SparkSession, path: str, default_kind: str = "synonym") -> DataFrame:
    """(kind, canonical, variants, distinguish): of the header's two languages the first that is not blank."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    value = lambda k: F.coalesce(*[F.nullif(F.trim(F.col(f"`{names[a]}`")), F.lit("")) for a in HEADERS[k] if a in names], F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = value("kind")
    return raw.select(F.when(kind == "", default_kind).otherwise(F.coalesce(F.try_element_at(kinds, kind), kind)).alias("kind"), *[value(k).alias(k) for k in ("canonical", "variants", "distinguish")])


def rebuild_vectors(clauses: DataFrame, encoder, limit: int = 512, floor: int = 128) -> DataFrame:
    """(clause_id, spec, chunk_index, text, embedding): every clause cut into embed texts of at most `limit` and encoded.

    clauses: id, spec, title, content. encoder: (df, id_col, text_col) -> (id, embedding).
    """
    prefix = build_embed_text(F.col("spec"), F.lit(""), F.col("id").cast("string"), F.col("title"), F.lit(""), F.lit(""))
    room = F.greatest(F.lit(limit) - F.length(prefix) - 1, F.lit(floor)).cast("int")
    c = clauses.withColumns({"body": plain_text("content"), "room": room}).where("body <> ''")
    pieces = c.select("id", "spec", "title", F.posexplode(chunks("body", F.col("room"))).alias("chunk_index", "piece"))
    t = build_embed_text(F.col("spec"), F.lit(""), F.col("id").cast("string"), F.col("title"), F.col("piece"), F.lit(""))
    rows = pieces.select(F.col("id").alias("clause_id"), "spec", "chunk_index", t.alias("text"), F.concat_ws("#", "id", "chunk_index").alias("key"))
    rows = stored(rows, "pieces")  # cut once for the encoder and the rows
    return rows.join(encoder(rows, "key", "text"), "key", "left").select("clause_id", "spec", "chunk_index", "text", "embedding")
