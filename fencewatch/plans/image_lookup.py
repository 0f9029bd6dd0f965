"""Image lookup: joined image ids in, match counts per listing out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fencewatch.operators.images import count_matches, image_rows, nested_image_results
from fencewatch.operators.output import image_response_json


def look_up_images(lookups: DataFrame, match_pages: DataFrame) -> DataFrame:
    """``lookups(listing_id, images)`` to ``(listing_id, part, json)``, one answer per listing."""
    counted = count_matches(image_rows(lookups), match_pages)
    return image_response_json(nested_image_results(counted))
