"""Image lookups: argument to rows, match counts, nested results, images shared by adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.keyed import aggregate_per_key, join_on_text, newest_per_key
from fencewatch.settings import IMAGE_ARGUMENT_SEPARATOR, IMAGE_HOST
from fencewatch.sources.scratch import written

_COUNT = r"<h2>\s*<span>(\d+(?:,\d{3})*)</span>\s*Results?\b"
_LOCATION = r"""(?s)class="search-results-location".*?<p>\s*<a\s[^>]*?href="([^"]*)\""""


def image_rows(
    lookups: DataFrame, separator: str = IMAGE_ARGUMENT_SEPARATOR, host: str = IMAGE_HOST
) -> DataFrame:
    """``(listing_id, images)`` with joined ids to ``(listing_id, pos, image_uri)``.

    Empty ids between two separators are kept.
    """
    ids = F.split("images", separator, -1)
    return lookups.select("listing_id", F.posexplode(ids).alias("pos", "image_id")).select(
        "listing_id", "pos", F.concat(F.lit(host), F.col("image_id")).alias("image_uri")
    )


def listing_images(listings: DataFrame, id_column: str = "link_url") -> DataFrame:
    """Images of scored listings in the same shape as :func:`image_rows`."""
    # The outer form: see result_rows.
    rows = listings.select(
        F.col(id_column).alias("listing_id"), F.posexplode_outer("images").alias("pos", "image_uri")
    )
    return rows.where(F.col("pos").isNotNull())


def match_count(html: Column) -> Column:
    """Number of matches that an image-search page states; NULL when it states none."""
    return F.translate(F.regexp_extract(html, _COUNT, 1), ",", "").try_cast("int")


def read_match_pages(pages: DataFrame) -> DataFrame:
    """``(image_uri, http_status, html)`` to ``(image_uri, match_count)``, one row per image.

    Only successful answers are read. The count is taken before the shuffle, so the pages
    themselves stay where they are.
    """
    keep = [name for name in ("fetched_at",) if name in pages.columns]
    succeeded = F.col("http_status").between(200, 299)
    counts = pages.select(
        "image_uri", *keep, F.when(succeeded, match_count(F.col("html"))).alias("match_count")
    )
    order = [F.col(name).desc_nulls_last() for name in keep]
    return newest_per_key(counts, "image_uri", order).drop(*keep)


def count_matches(images: DataFrame, match_pages: DataFrame) -> DataFrame:
    """Add ``match_count`` to image rows; 0 where the lookup failed or is missing."""
    joined = join_on_text(images, read_match_pages(match_pages), "image_uri", "left")
    return joined.select(
        "listing_id", "pos", "image_uri", F.coalesce("match_count", F.lit(0)).alias("match_count")
    )


def nested_image_results(counted: DataFrame) -> DataFrame:
    """One row per lookup with all its images in order: ``(listing_id, images)``.

    The images of a lookup came out of one cell, which bounds the row that they go back into.
    """
    entry = F.struct("pos", "image_uri", "match_count")
    grouped = counted.groupBy("listing_id").agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )
    wire = F.transform(
        "entries",
        lambda e: F.struct(
            e["image_uri"].alias("imageURI"), e["match_count"].alias("tinEyeImageCount")
        ),
    )
    return grouped.select("listing_id", wire.alias("images"))


def location_urls(html: Column) -> Column:
    """The different addresses at which an image was found, as one answer page lists them."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_LOCATION), 1))


def match_locations(pages: DataFrame) -> DataFrame:
    """Where each looked-up image was found: ``(image_uri, original_url)``, each pair once.

    Read from the newest answer for the image, so that an image looked up over and over does not
    multiply its pairs.
    """
    keep = [name for name in ("fetched_at",) if name in pages.columns]
    succeeded = F.col("http_status").between(200, 299)
    found = pages.select("image_uri", *keep, F.when(succeeded, location_urls(F.col("html"))).alias("urls"))
    order = [F.col(name).desc_nulls_last() for name in keep]
    newest = newest_per_key(found, "image_uri", order)
    return newest.select("image_uri", F.explode("urls").alias("original_url"))


def originals_used(images: DataFrame, locations: DataFrame) -> DataFrame:
    """Which listing uses which original, each pair once: ``(original_url, listing_id)``."""
    return join_on_text(images, locations, "image_uri").select("original_url", "listing_id").distinct()


def adverts_per_original(used: DataFrame) -> DataFrame:
    """Number of different listings that use each original: ``(original_url, n_listings)``."""
    return aggregate_per_key(used, ["original_url"], F.count("*").alias("n_listings"))


def shared_images(images: DataFrame, locations: DataFrame) -> DataFrame:
    """``(listing_id, shared_by)``: the widest sharing of any original that the listing uses."""
    # Needed on both sides of a join, so it is computed once.
    used = written(originals_used(images, locations), "originals-used")
    widest = join_on_text(used, adverts_per_original(used), "original_url")
    return widest.groupBy("listing_id").agg(F.max("n_listings").alias("shared_by"))
