"""Where documents come from and where citations go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_documents(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text of a Parquet table; only these columns are read."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file; doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, path: str, key: str = "id", text: str = "text") -> DataFrame:
    """One document for each JSON line; the schema is given, not inferred."""
    return spark.read.schema(f"`{key}` string, `{text}` string").json(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def write_citations(cites: DataFrame, path: str) -> None:
    """Citations as Parquet, partitioned by type so that a reader of one type skips the others."""
    cites.write.mode("overwrite").partitionBy("type").parquet(path)


def projection(cites: DataFrame) -> DataFrame:
    """The regression view: doc_id, cite_idx, type, key, start, end, resolved_key."""
    target = cites.select("doc_id", F.col("cite_idx").alias("to"), F.col("matched_text").alias("resolved_key"))
    rows = cites.select("doc_id", "cite_idx", "type", F.col("matched_text").alias("key"), F.col("source_span.start").alias("start"), F.col("source_span.end").alias("end"), F.col("resolution.resolved_to").alias("to"))
    return rows.join(target, ["doc_id", "to"], "left").drop("to")
