"""Linking of documents as they arrive: a stream joined with the static dictionary, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import detect as D


def read(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Documents (doc_id, text) from Parquet files that appear in a folder."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(path)


def linked(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, sf, entity, score: the best candidates are chosen once, on the static side."""
    best = D.best(dictionary, ["sf"], "n", "entity").select("sf", "entity", F.round(10 * F.sqrt("n"), 6).alias("score"))
    words = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("sf"))
    return words.join(best, "sf").select("doc_id", "sf", "entity", "score")


def start(docs: DataFrame, dictionary: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return linked(docs, dictionary).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts of events by type in tumbling windows, late ones within the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
