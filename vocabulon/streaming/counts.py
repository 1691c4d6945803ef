"""Word counts of a stream of documents, the same as those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.corpus import tokens


def streaming_counts(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps (word, cnt) of a streaming (doc_id, text) in the in-memory table ``name``."""
    counts = tokens(stream).groupBy("word").count().withColumnRenamed("count", "cnt")
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
