"""Helpers that several operators share; tables in the shared folder and components are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausespark.tables import Scratch, connected_components, new_path, shared_dir, stored  # noqa: F401

#: What counts as white space between words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
