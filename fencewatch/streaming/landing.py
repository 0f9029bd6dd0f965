"""The page operators over a landing folder that keeps filling.

The work is the same as in batch and keeps no state; only the source and the sink differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from fencewatch.operators.details import read_details
from fencewatch.settings import DetailPageSelectors, PhoneRule

PAGE_SCHEMA = "url string, html string"


def stream_pages(
    spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(
    pages: DataFrame,
    selectors: DetailPageSelectors = DetailPageSelectors(),
    phone: PhoneRule = PhoneRule(),
) -> DataFrame:
    return read_details(pages, selectors, phone)


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has landed so far, then stop; run again to go on from there."""
    return (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
