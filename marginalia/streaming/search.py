"""Searches over streams of documents. A search is a per-row, stateless step, so it appends as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.phrase_search import search_phrases
from marginalia.plans.config import SearchConfig
from marginalia.plans.model import PhraseModel


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Documents from files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_matches(docs: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of a stream of documents; the same columns as a batch search."""
    return search_phrases(docs, model, config, id_col, text_col)


def write_matches(matches: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends matches to Parquet, exactly once by the checkpoint."""
    writer = matches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(matches: DataFrame, time_col: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Matches per phrase and time window of documents that carry an event time; late ones count within the delay."""
    w = F.window(time_col, window)
    return matches.withWatermark(time_col, delay).groupBy(w, "phrase").agg(F.count("*").alias("matches"))
