"""Landed page snapshots: what a crawler left behind, read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencewatch.functions.encodings import charset_of, decoded


def read_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    """Page table in Parquet as ``(url, html)`` and, where present, ``fetched_at``."""
    pages = spark.read.parquet(path)
    more = ["fetched_at"] if "fetched_at" in pages.columns else []
    return pages.select(F.col(url).alias("url"), F.col(html).alias("html"), *more)


def read_page_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A folder with one page per file, as ``(url, html)``; ``url`` is the address of the file.

    Many small files are packed into each task by ``spark.sql.files.maxPartitionBytes``.
    """
    if encoding.upper() == "UTF-8":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", encoding).alias("html"))


def read_page_bytes(spark: SparkSession, path: str) -> DataFrame:
    """A folder with one page per file, each in a charset of its own, as ``(url, charset, html)``.

    A byte-order mark decides, then the charset that the page declares, then whether it is valid
    UTF-8; anything else is Windows-1252. No page fails the read.
    """
    files = spark.read.format("binaryFile").load(path)
    return decoded_pages(files.select(F.col("path").alias("url"), "content"))


def decoded_pages(pages: DataFrame) -> DataFrame:
    """Pages landed as bytes in ``content`` with ``charset`` and ``html`` instead; other columns stay."""
    charset = charset_of(F.col("content"))
    told = pages.withColumn("charset", charset)
    return told.withColumn("html", decoded(F.col("content"), F.col("charset"))).drop("content")


def read_match_page_table(spark: SparkSession, path: str) -> DataFrame:
    """Image-search answers: ``(image_uri, http_status, html)``."""
    pages = spark.read.parquet(path)
    more = ["fetched_at"] if "fetched_at" in pages.columns else []
    return pages.select("image_uri", "http_status", "html", *more)


def within_size(pages: DataFrame, max_bytes: int) -> DataFrame:
    """Pages that a client with a response limit would have accepted."""
    return pages.where(F.octet_length("html") <= max_bytes)
