"""The given tables in their roles of a clause library."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as clauses: source is the spec, lang a dimension."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("spec"), F.col("lang").alias("dim4"), F.col("text").alias("content"))


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list) -> str:
    """The same rows for DuckDB."""

    def one(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
