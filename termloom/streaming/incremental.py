"""Index building from a stream of documents: each micro-batch appends a block of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import append_block
from ..operators.tokenize import plain_tokens, term_frequencies


def index_stream(docs: DataFrame, path: str, checkpoint: str, low: int = 3, high: int = 25) -> StreamingQuery:
    """Start appending postings of new documents (doc_id, text) under the path, all available ones, then stop.

    A batch is written under its own number, so a repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        tf = term_frequencies(plain_tokens(batch, low, high))
        tf.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The postings of all blocks so far."""
    return spark.read.parquet(f"{path}/postings").drop("batch")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, value``: tumbling windows over (ts, event_type, value) with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "value")


__all__ = ["append_block", "event_counts", "index_stream", "indexed"]
