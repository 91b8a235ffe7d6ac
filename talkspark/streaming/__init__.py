"""Transcripts arriving as files, parsed as a stream.

Turns close on content, not on time, and a conversation is whole in its file; so each file is
parsed and merged within its micro-batch, without state between batches. A batch has a folder of its
own in the sink (column ``batch``), which it overwrites: a batch that is tried again is not there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, path: str, to_rows: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Reads whole text files as they appear in ``path``; ``to_rows`` makes rows of (file, content); writes them as Parquet, a folder a batch."""
    lines = spark.readStream.format("text").option("wholetext", "true").load(path).selectExpr("_metadata.file_name as file", "value as content")

    def each(batch: DataFrame, number: int) -> None:
        to_rows(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
