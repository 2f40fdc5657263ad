"""Incremental ingest: new chapter files are gated and chunked as they come, and each is worked on once.

An extension: the batch form of the same work is the anti-join on what is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.payload import read_payload
from ..operators.chunking import chunk_chapters
from ..settings import ChunkSettings

SCHEMA = "book_id STRING, chapter_index INT, payload STRING, received_at TIMESTAMP"


def stream_chapters(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Adapted chapters that arrive in ``folder`` as Parquet; a chapter delivered again within ``delay`` counts once."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["book_id", "chapter_index"])


def chunk_stream(spark: SparkSession, folder: str, out: str, state: str, cfg: ChunkSettings | None = None) -> StreamingQuery:
    """Starts the query that chunks all files there are now and stops; started again, it goes on with the new ones."""
    rows = stream_chapters(spark, folder).withColumn("p", read_payload("payload")).filter("p.state = 'object' AND p.adapted_text IS NOT NULL")
    chunks = chunk_chapters(rows.select("book_id", "chapter_index", F.col("p.adapted_text").alias("adapted_text")), ["book_id", "chapter_index"], "adapted_text", cfg=cfg)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
