"""Documents as they arrive: an extension, for the batch operators over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators.chunking import chunks


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Chunks of new documents, appended as Parquet; exactly once by the file sink's log."""
    return chunks(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
