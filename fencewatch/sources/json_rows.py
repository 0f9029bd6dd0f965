"""JSON arrays of flat objects as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_rows(
    spark: SparkSession, path: str, multi_line: bool = True, schema: str | None = None
) -> DataFrame:
    """Objects as rows, every value as text.

    Columns are those of all objects, not of the first one alone. A ``multi_line`` file is read
    by one task; line-separated files are split.
    """
    reader = spark.read.option("multiLine", multi_line).option("primitivesAsString", True)
    return (reader.schema(schema) if schema else reader).json(path)


def object_fields(json: Column) -> Column:
    """Fields of a flat JSON object in a column, as a map of text."""
    return F.from_json(json, "map<string,string>")


def array_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Cells that hold a JSON array of flat objects, as ``(*keep, pos, fields)``, one row per object.

    ``fields`` lists (name, value) with the names of the cell's first object, in its order: an object that
    lacks one has NULL there, further names of later objects are not shown. Values are text; nested ones stay
    JSON. A NULL cell, an empty array and text that is no array have no rows.
    """
    entries = F.from_json(F.col(column), "array<string>")
    rows = df.select(*keep, F.json_object_keys(entries[0]).alias("__names"), F.posexplode(entries).alias("pos", "__entry"))
    values = rows.withColumn("__values", F.from_json("__entry", "map<string,string>"))
    field = F.transform("__names", lambda name: F.struct(name.alias("name"), F.try_element_at("__values", name).alias("value")))
    return values.select(*keep, "pos", field.alias("fields"))
