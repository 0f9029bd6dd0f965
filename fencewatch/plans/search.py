"""The two searches, from requests and landed pages to scored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.details import join_details, read_details
from fencewatch.operators.feeds import summarise_feeds
from fencewatch.operators.keyed import newest_per_key
from fencewatch.operators.lookup import asked_snapshots
from fencewatch.operators.output import with_status_fields
from fencewatch.operators.results import (
    expand_results,
    find_result_pages,
    guard_results,
    guarded_since,
    newest_pages,
    summarise_result_pages,
    with_search_url,
)
from fencewatch.settings import HTML_SEARCH, RSS_SEARCH, SearchRules
from fencewatch.sources.scratch import written

# Summary fields that only HTML result rows state.
_SUMMARY_DEFAULTS = {
    "short_title": "string",
    "date_text": "string",
    "date_posted_real": "date",
    "date_posted_parsed": "string",
    "price": "string",
    "sale_area": "string",
    "category": "string",
}


def _fetched_at(pages: DataFrame) -> list[str]:
    return ["fetched_at"] if "fetched_at" in pages.columns else []


def newest_details(
    pages: DataFrame,
    rules: SearchRules,
    max_bytes: int | None = None,
    unique: bool = False,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Scored fields of the newest snapshot of every page.

    The page text is read first and left behind: only the extracted fields are shuffled. With
    ``unique`` the caller vouches for one snapshot per address and the shuffle is saved. With a stored
    table ``asked(link_url)``, only the newest snapshots of those addresses (and few others) are read.
    """
    if asked is not None:
        pages = asked_snapshots(pages, asked, unique)
    keep = _fetched_at(pages)
    details = read_details(pages, rules.detail, rules.phone, keep, max_bytes)
    if unique:
        return details.drop(*keep)
    order = [F.col(name).desc_nulls_last() for name in keep]
    return newest_per_key(details, "link_url", order).drop(*keep)


def _listings(
    requests: DataFrame,
    summaries: DataFrame,
    detail_pages: DataFrame,
    rules: SearchRules,
    max_bytes: int | None,
    unique: bool,
    stolen_on: Column | None = None,
) -> DataFrame:
    newest = summaries if unique else newest_pages(summaries)
    found = find_result_pages(with_search_url(requests, rules), newest)
    guarded = guard_results(found, rules)
    if stolen_on is not None:
        guarded = guarded_since(guarded, stolen_on, rules)
    rows = written(expand_results(guarded).drop("fetched_at"), "guarded-rows")
    details = newest_details(detail_pages, rules, max_bytes, unique, asked=rows.select("link_url"))
    return with_status_fields(join_details(rows, details))


def search_html(
    requests: DataFrame,
    result_pages: DataFrame,
    detail_pages: DataFrame,
    year: int | Column,
    rules: SearchRules = HTML_SEARCH,
    max_bytes: int | None = None,
    crawled_on: Column | None = None,
    unique_pages: bool = False,
    stolen_on: Column | None = None,
) -> DataFrame:
    """``requests(request_id, city, page, terms)`` and landed pages to scored listings.

    With ``stolen_on``, a date of the request, only adverts posted on that day or later are listed; a
    request of which none is left gets the status row of an empty result.

    Every request gets its listings, or one status row. Two shuffled joins: requests with page
    summaries on the result address, listings with detail fields on the advert address. Only detail pages
    that a listing names are read, and of each only the newest.
    ``unique_pages`` says that both page tables hold one snapshot per address.
    """
    summaries = summarise_result_pages(
        result_pages, year, rules, _fetched_at(result_pages), crawled_on
    )
    return _listings(requests, summaries, detail_pages, rules, max_bytes, unique_pages, stolen_on)


def search_rss(
    requests: DataFrame,
    feeds: DataFrame,
    detail_pages: DataFrame,
    rules: SearchRules = RSS_SEARCH,
    max_bytes: int | None = None,
    unique_pages: bool = False,
) -> DataFrame:
    """Like :func:`search_html` with feeds as result lists; summary fields are NULL."""
    summaries = summarise_feeds(feeds, rules, _fetched_at(feeds))
    listings = _listings(requests, summaries, detail_pages, rules, max_bytes, unique_pages)
    empty = {
        name: F.lit(None).cast(kind)
        for name, kind in _SUMMARY_DEFAULTS.items()
        if name not in listings.columns
    }
    return listings.withColumns(empty)


def in_request_order(listings: DataFrame, *ids: str) -> DataFrame:
    """Order for the sink: by request, then by place on the result page."""
    return listings.orderBy(*(ids or ("request_id",)), F.col("pos"))
