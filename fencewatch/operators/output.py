"""Wire forms: listings, status rows and image results as the endpoints return them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.results import OK
from fencewatch.settings import HTML_SEARCH, LISTING_WIRE_NAMES, SearchRules

_KEEP_NULLS = {"ignoreNullFields": "false"}


def with_status_fields(listings: DataFrame) -> DataFrame:
    """Turn rows of a failed request into its status row: message, description, score 0."""
    ok = F.col("status") == OK
    return listings.withColumns(
        {
            "title": F.when(ok, F.col("title")).otherwise(F.col("status_title")),
            "description": F.when(ok, F.col("description")).otherwise(
                F.col("status_description")
            ),
            "dodgy_score": F.when(ok, F.col("dodgy_score")).otherwise(F.lit(0)),
        }
    ).drop("status_title", "status_description")


def wire_date(day: Column) -> Column:
    """A date as the endpoints' JSON writes it: milliseconds since 1970 of its midnight in UTC."""
    millis = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return F.concat(F.lit("/Date("), millis.cast("string"), F.lit(")/"))


def wire_struct() -> Column:
    dated = {"date_posted_real": wire_date(F.col("date_posted_real"))}
    return F.struct(
        *[dated.get(name, F.col(name)).alias(wire) for name, wire in LISTING_WIRE_NAMES.items()]
    )


def wire_columns(listings: DataFrame) -> DataFrame:
    """The 14 wire fields, in wire order, ready for ``sources.sinks.write_json``."""
    return listings.select(wire_struct().alias("w")).select("w.*")


def wire_json(listings: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, json)`` with one JSON object per listing, NULL fields written out."""
    return listings.select(*keep, F.to_json(wire_struct(), _KEEP_NULLS).alias("json"))


def response_json(listings: DataFrame, rules: SearchRules = HTML_SEARCH) -> DataFrame:
    """``(request_id, json)``: the whole answer to each request as one JSON array, in page order.

    Only for listings of guarded searches: the guard keeps every group below its maximum number of
    rows. Rules without a maximum are refused.
    """
    if rules.max_results is None:
        raise ValueError("an answer without a maximum number of rows can't be one array")
    entry = F.struct(F.col("pos"), wire_struct().alias("w"))
    grouped = listings.groupBy("request_id").agg(
        F.sort_array(F.collect_list(entry)).alias("rows")
    )
    answer = F.transform("rows", lambda r: r["w"])
    return grouped.select("request_id", F.to_json(answer, _KEEP_NULLS).alias("json"))


def image_response_json(nested: DataFrame) -> DataFrame:
    """``(listing_id, json)``: image results in the shape the image endpoint returns."""
    answer = F.array(
        F.struct(
            F.col("listing_id").cast("string").alias("craigslistInfoId"),
            F.col("images").alias("tinEyeImageInfos"),
        )
    )
    return nested.select("listing_id", F.to_json(answer, _KEEP_NULLS).alias("json"))
