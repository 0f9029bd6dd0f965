"""Further reasons to look at an advert. Each adds columns; none changes the basic score.

``combine_signals`` turns them into points with weights that the caller chooses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.functions.advert import price_amount
from fencewatch.operators.keyed import aggregate_per_key
from fencewatch.operators.results import OK
from fencewatch.settings import PHONE_DEFAULT


def posted_after(
    listings: DataFrame, stolen_on: str | Column = "stolen_date", keep_undated: bool = False
) -> DataFrame:
    """Only adverts posted on the day of the theft or later; status rows, which are none, stay."""
    stolen = F.col(stolen_on) if isinstance(stolen_on, str) else stolen_on
    posted = F.col("date_posted_real")
    wanted = posted >= stolen
    if keep_undated:
        wanted = wanted | posted.isNull()
    if "status" in listings.columns:
        wanted = wanted | (F.col("status") != OK)
    return listings.where(wanted)


def phone_reuse(
    listings: DataFrame, default: str = PHONE_DEFAULT, stored: DataFrame | None = None
) -> DataFrame:
    """Add ``phone_adverts``, the number of adverts with the same phone number.

    NULL for the default number and for no number: neither says anything about the seller. With ``stored``,
    the same adverts as a stored table, they are counted there and ``listings`` is read once.
    """
    known = F.when(F.col("phone_number") != default, F.col("phone_number"))
    counts = aggregate_per_key(
        (stored or listings).select(known.alias("known_phone")), ["known_phone"], F.count("*").alias("phone_adverts")
    )
    return listings.withColumn("known_phone", known).join(counts, "known_phone", "left").drop("known_phone")


def price_outlier(
    listings: DataFrame, group: str = "request_id", stored: DataFrame | None = None
) -> DataFrame:
    """Add ``amount`` and ``price_ratio``: the price against the mean price of the same search.

    With ``stored``, the same listings as a stored table, prices are summed there and ``listings`` is read once.
    """
    amount = price_amount(F.col("price"))
    per_group = aggregate_per_key(
        (stored or listings).select(group, amount.alias("amount")),
        [group],
        F.sum("amount").cast("double").alias("amount_sum"),
        F.count("amount").alias("amount_count"),
    )
    sums = listings.withColumn("amount", amount).join(per_group, group, "left")
    mean = F.col("amount_sum") / F.nullif(F.col("amount_count"), F.lit(0))
    ratio = F.when(mean != 0, F.col("amount").cast("double") / mean)
    return sums.withColumn("price_ratio", ratio).drop("amount_sum", "amount_count")


def price_against_known(
    listings: DataFrame, known_prices: DataFrame, key: str = "category"
) -> DataFrame:
    """Add ``amount`` and ``known_price_ratio`` from a table ``(key, average_price)``.

    Whether the price table is broadcast is left to Spark, which knows its size.
    """
    priced = listings.withColumn("amount", price_amount(F.col("price")))
    per_key = aggregate_per_key(known_prices, [key], F.avg("average_price").alias("average_price"))
    joined = priced.join(per_key, key, "left")
    average = F.col("average_price").cast("double")
    ratio = F.when(average != 0, F.col("amount").cast("double") / average)
    return joined.withColumn("known_price_ratio", ratio).drop("average_price")


def delay_gap(
    listings: DataFrame, known_delays: DataFrame, stolen_on: str | Column = "stolen_date"
) -> DataFrame:
    """Add ``delay_days`` from theft to advert, and how far that is from the usual delay.

    ``known_delays(delay_days)`` holds past cases; only its mean and deviation are used, as two
    scalar subqueries. ``delay_gap`` is in days, ``delay_score`` in standard deviations.
    """
    stolen = F.col(stolen_on) if isinstance(stolen_on, str) else stolen_on
    mean = known_delays.select(F.avg("delay_days")).scalar()
    deviation = known_delays.select(F.nullif(F.stddev_pop("delay_days"), F.lit(0.0))).scalar()
    dated = listings.withColumn("delay_days", F.datediff(F.col("date_posted_real"), stolen))
    gap = F.abs(F.col("delay_days") - mean)
    return dated.withColumn("delay_gap", gap).withColumn("delay_score", F.col("delay_gap") / deviation)


def area_weight(listings: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``area_weight`` from a table ``(area, weight)``; brackets, blanks and case are ignored."""

    def plain(area: Column) -> Column:
        return F.lower(F.trim(F.translate(area, "()", "")))

    renamed = weights.select(plain(F.col("area")).alias("plain_area"), "weight")
    per_area = aggregate_per_key(renamed, ["plain_area"], F.max("weight").alias("area_weight"))
    placed = listings.withColumn("plain_area", plain(F.col("sale_area")))
    return placed.join(per_area, "plain_area", "left").drop("plain_area")


def on_watch_list(listings: DataFrame, phones: DataFrame) -> DataFrame:
    """Add ``watched``: whether the advert's number is in ``phones(phone_number)``."""
    digits = F.regexp_replace("phone_number", r"\P{Nd}", "")
    listed = aggregate_per_key(
        phones.select(digits.alias("phone_number")), ["phone_number"], F.lit(True).alias("listed")
    )
    joined = listings.join(listed, "phone_number", "left")
    return joined.withColumn("watched", F.coalesce("listed", F.lit(False))).drop("listed")


def missing_fields(listings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``missing_fields``, how many of the fields are NULL, blank or the default number."""
    flags = [_is_missing(name).cast("int") for name in fields]
    total = flags[0]
    for flag in flags[1:]:
        total = total + flag
    return listings.withColumn("missing_fields", total)


def _is_missing(name: str) -> Column:
    column = F.col(name)
    if name == "images":
        return column.isNull()
    missing = column.isNull() | (F.trim(column.cast("string")) == "")
    return missing | (column == PHONE_DEFAULT) if name == "phone_number" else missing


def stock_images(listings: DataFrame, counted: DataFrame, id_column: str) -> DataFrame:
    """Add ``stock_images``, how many images of the listing were found elsewhere."""
    found = F.when(F.col("match_count") > 0, 1)
    per_listing = aggregate_per_key(counted, ["listing_id"], F.count(found).alias("stock_images"))
    renamed = per_listing.withColumnRenamed("listing_id", id_column)
    joined = listings.join(renamed, id_column, "left")
    return joined.withColumn("stock_images", F.coalesce("stock_images", F.lit(0)))


def combine_signals(listings: DataFrame, points: Mapping[str, Column]) -> DataFrame:
    """Add ``signal_points``, the named points as a map, and ``total_score`` with them included.

    A signal that is NULL for a listing counts as no points.
    """
    names = F.array(*[F.lit(name) for name in points])
    values = [F.coalesce(column.cast("int"), F.lit(0)) for column in points.values()]
    total = F.col("dodgy_score")
    for value in values:
        total = total + value
    explained = F.map_from_arrays(names, F.array(*values))
    return listings.withColumns({"signal_points": explained, "total_score": total})
