"""Tab-separated stolen-property registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class RegisterError(ValueError):
    """The register file has no usable header."""


def register_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names from the first line; reads that line only. A missing file raises."""
    if encoding.upper() == "UTF-8":
        lines = spark.read.text(path)
    else:
        # One column that no separator parts, so that the line is decoded but not split.
        lines = spark.read.options(sep="\x01", quote="", encoding=encoding).schema("line string").csv(path)
    first = lines.take(1)
    if not first or not first[0][0]:
        raise RegisterError(f"Could not read column names from {path}")
    names = first[0][0].removeprefix("\ufeff").rstrip("\r").split("\t")
    if any(name == "" for name in names):
        # Blank names are dropped while blank cells are kept, so every row would be ragged.
        raise RegisterError(f"Blank column name in the header of {path}")
    return names


def read_register(
    spark: SparkSession,
    path: str,
    header: list[str] | None = None,
    bad_rows: str = "fail",
    encoding: str = "UTF-8",
) -> DataFrame:
    """All columns as text, named by the header line; blank cells are NULL, quotes mean nothing.

    ``encoding`` is that of the file, by a name that Spark's CSV reader knows, such as ``windows-1252``.

    ``bad_rows='fail'``: a row with more or fewer cells than the header fails the job.
    ``bad_rows='keep'``: it stays, with its text in ``bad_row``.
    """
    names = header or register_header(spark, path, encoding)
    fields = [T.StructField(name, T.StringType()) for name in names]
    reader = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", "")
        .option("encoding", encoding)
        .option("columnPruning", False)
    )
    if bad_rows == "keep":
        schema = T.StructType([*fields, T.StructField("bad_row", T.StringType())])
        return (
            reader.option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "bad_row")
            .option("enforceSchema", True)
            .schema(schema)
            .csv(path)
        )
    return reader.option("mode", "FAILFAST").schema(T.StructType(fields)).csv(path)
