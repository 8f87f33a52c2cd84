"""Incremental ingest of landed page files: an extension beyond full rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.corpus import line_chunks


def ingest_documents(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str = "document_id long, language string, topic string, text string") -> StreamingQuery:
    """Appends the chunks of documents in newly landed Parquet files, each file once."""
    rows = spark.readStream.schema(schema).parquet(landing)

    def put(batch: DataFrame, batch_id: int) -> None:
        # a batch that runs again replaces its own folder
        line_chunks(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
