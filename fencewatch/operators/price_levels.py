"""Robust prices: where an advert's price stands among those of the same search, from sketches that can be merged.

A mean is moved by the very price that it should judge, and has to be made anew whenever adverts are added.
Quantile sketches (KLL) are kept for each search and day instead, a few kilobytes each, whatever the number of adverts;
those of the days asked for are merged when a price is judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencewatch.functions.advert import price_amount
from fencewatch.operators.keyed import aggregate_per_key

#: Size of a sketch: ranks are off by 1.3 % at most, with a chance of 99 %; up to so many prices are kept as they are.
SKETCH = 200
#: Where prices are parted into eighths.
EIGHTHS = tuple(i / 8 for i in range(1, 8))


def price_sketches(listings: DataFrame, search: str, day: str) -> DataFrame:
    """``(search, day, sketch)`` of listings with a price; partial sketches are made where the rows are read."""
    priced = listings.select(search, day, price_amount(F.col("price")).cast("double").alias("amount"))
    return priced.where(F.col("amount").isNotNull()).groupBy(search, day).agg(
        F.kll_sketch_agg_double("amount", F.lit(SKETCH)).alias("sketch")
    )


def price_level(listings: DataFrame, sketches: DataFrame, search: str) -> DataFrame:
    """Add ``amount``, ``median_ratio``, the price against the median of its search, and ``price_eighth``.

    The eighth, 0 to 7, is how many of the seven prices that part the search into eighths are lower. ``sketches`` are
    those of the days to compare with, of any number of batches. NULL without a price or without a sketch
    of the search.
    """
    merged = aggregate_per_key(sketches, [search], F.kll_merge_agg_double("sketch").alias("__sketch"))
    parts = F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(e) for e in EIGHTHS]))
    levels = merged.select(search, parts.alias("__parts"))
    priced = listings.withColumn("amount", price_amount(F.col("price")).cast("double"))
    joined = priced.join(levels, search, "left")
    lower = F.size(F.filter("__parts", lambda part: part < F.col("amount")))
    known = F.col("__parts").isNotNull() & F.col("amount").isNotNull()
    median = F.get("__parts", F.lit(len(EIGHTHS) // 2))
    return joined.withColumns(
        {
            "median_ratio": F.when(known, F.col("amount") / F.nullif(median, F.lit(0.0))),
            "price_eighth": F.when(known, lower),
        }
    ).drop("__parts")
