"""Citations from a stream of documents: the batch engine on readStream, stateless for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.citations import extract_citations
from ..operators.documents import Options


def stream_citations(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """A streaming DataFrame of citations; docs is a streaming DataFrame with doc_id and text."""
    return extract_citations(docs, options)


def run_to_table(spark: SparkSession, docs: DataFrame, path: str, checkpoint: str, options: Options = Options()) -> None:
    """All that is available now, appended as Parquet with exactly-once file commits."""
    query = stream_citations(docs, options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
