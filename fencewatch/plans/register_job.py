"""The register job: reported items of a year, paired with adverts that could be them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fencewatch.operators.register import match_register, register_items, reported_in


def match_reported_items(
    register: DataFrame,
    listings: DataFrame,
    year: str | int,
    id_column: str = "Occurence Number",
    misspelt_makes: bool = True,
) -> DataFrame:
    """``listings(listing_id, text)`` and a register to ``(item_id, listing_id)`` pairs."""
    items = register_items(reported_in(register, year), id_column)
    return match_register(items, listings, misspelt_makes)
