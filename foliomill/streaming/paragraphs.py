"""Structured Streaming over documents and events; nothing here is in the batch operators' way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pipeline import ANONYMIZE, Pipeline


def anonymize_stream(docs: DataFrame, pipeline: Pipeline = ANONYMIZE) -> DataFrame:
    """The stateless pipeline under ``readStream`` as it stands."""
    return pipeline(docs)


def first_seen(paragraphs: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so state stays bounded."""
    return paragraphs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
