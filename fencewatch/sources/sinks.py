"""JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fencewatch.operators.output import wire_columns


def write_listings_json(listings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Listings as JSON lines with the wire names, in wire order, NULL fields written out."""
    wire_columns(listings).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_answers(answers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ready-made JSON texts (a ``json`` column), one per line."""
    answers.select("json").write.mode(mode).text(path)
