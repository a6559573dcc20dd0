"""Incremental indexing of a stream of texts: each micro-batch is chunked, embedded and appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import chunking, embed


def index_stream(files: DataFrame, out: str, checkpoint: str, budget: int = 120, overlap: int = 18, make=embed.HashedWords):
    """Start a query that reads a streaming table (path, content) and writes chunks with vectors under ``out``.

    Each batch goes to a folder of its own number, overwritten if the batch is run again, so a restart repeats nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        cut = chunking.with_ids(chunking.chunk_files(batch, budget=budget, overlap=overlap, make=make).filter("part IS NOT NULL"))
        cut.withColumn("vec", embed.embedded(F.col("text"), make)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by key and tumbling window of a streaming or plain table, late rows dropped after the watermark."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    return timed.groupBy(F.window(time_col, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
