"""RSS result lists from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.sources.landed import read_page_files


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """One feed per file as ``(url, xml)``; the item order is kept by the feed operators."""
    return read_page_files(spark, path).withColumnRenamed("html", "xml")


def read_feed_items(spark: SparkSession, path: str, row_tag: str = "rdf:li") -> DataFrame:
    """Item links of feed files through Spark's XML reader, large files split; order not kept."""
    items = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .schema("`_rdf:resource` string")
        .load(path)
    )
    return items.select(
        F.col("_metadata.file_path").alias("url"), F.col("`_rdf:resource`").alias("link_url")
    )
