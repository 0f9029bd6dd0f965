"""Result pages: split into rows, guard their number, summarise, find the page of a request."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.functions.advert import posted_on, posted_text, trim_whitespace
from fencewatch.functions.html import (
    all_links,
    attribute_of,
    element,
    first_link,
    row_pattern,
    text_of,
)
from fencewatch.functions.web import page_number, search_url
from fencewatch.operators.keyed import newest_per_key, numbered_rows
from fencewatch.settings import (
    HTML_SEARCH,
    NO_RESULTS_TITLE,
    TOO_MANY_TITLE,
    ResultPageSelectors,
    SearchRules,
)

OK = "ok"
EMPTY = "empty"
TOO_MANY = "too_many"
PAGE_MISSING = "page_missing"
BAD_REQUEST = "bad_request"

_ROW_HTML = "__row_html"
_ROWS = "__rows"


def row_elements(row: Column, position: Column, selectors: ResultPageSelectors) -> Column:
    """The elements of a result row that are read, each searched once and inside its own row."""
    return F.struct(
        position.cast("int").alias("pos"),
        first_link(row).alias("link"),
        text_of(element(row, selectors.date)).alias("date_text"),
        element(row, selectors.price).alias("price"),
        element(row, selectors.area).alias("area"),
        first_link(element(row, selectors.category)).alias("category"),
    )


def row_summary(found: Column, year: int | Column, crawled_on: Column | None = None) -> Column:
    """The fields that a result row states itself, from its :func:`row_elements`."""
    posted = posted_on(found["date_text"], year, crawled_on)
    return F.struct(
        found["pos"].alias("pos"),
        attribute_of(found["link"], "href").alias("link_url"),
        text_of(found["link"]).alias("short_title"),
        found["date_text"].alias("date_text"),
        posted.alias("date_posted_real"),
        trim_whitespace(text_of(found["price"])).alias("price"),
        text_of(found["area"]).alias("sale_area"),
        text_of(found["category"]).alias("category"),
    )


def summarise_result_pages(
    pages: DataFrame,
    year: int | Column,
    rules: SearchRules = HTML_SEARCH,
    keep: Sequence[str] = (),
    crawled_on: Column | None = None,
) -> DataFrame:
    """``(url, html)`` pages to ``(url, *keep, n_rows, rows)``, one output row per page.

    The guard is applied to the row array before anything else happens to it: a page with too
    many rows carries its count and no rows, so nothing of it is shuffled later.
    """
    split = pages.select(
        "url",
        *keep,
        F.regexp_extract_all("html", F.lit(row_pattern(rules.rows.row)), 0).alias(_ROW_HTML),
    )
    # Two steps, so that an element used for two fields is searched for once.
    elements = F.transform(_ROW_HTML, lambda row, i: row_elements(row, i, rules.rows))
    summarised = F.transform(elements, lambda found: row_summary(found, year, crawled_on))
    return split.select(
        "url",
        *keep,
        F.size(_ROW_HTML).alias("n_rows"),
        _within_limit(F.size(_ROW_HTML), summarised, rules).alias("rows"),
    )


def _within_limit(count: Column, rows: Column, rules: SearchRules) -> Column:
    return rows if rules.max_results is None else F.when(count < rules.max_results, rows)


def newest_pages(pages: DataFrame, key: str = "url") -> DataFrame:
    """One landed page per key: the one fetched last where ``fetched_at`` says so."""
    order = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in pages.columns else []
    return newest_per_key(pages, key, order)


def with_search_url(requests: DataFrame, rules: SearchRules = HTML_SEARCH) -> DataFrame:
    """Add ``url``, the address of the result page; NULL where the page argument is no number."""
    return requests.withColumn(
        "url", search_url(F.col("city"), F.col("terms"), page_number(F.col("page")), rules)
    )


def find_result_pages(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every request meets its own page; a request without a landed page stays."""
    return requests.join(summaries, "url", "left")


def result_status(rules: SearchRules) -> Column:
    """Outcome of a request, from its address and the row count of its page."""
    count = F.col("n_rows")
    status = F.when(F.col("url").isNull(), BAD_REQUEST).when(count.isNull(), PAGE_MISSING)
    status = status.when(count == 0, EMPTY)
    if rules.max_results is not None:
        status = status.when(count >= rules.max_results, TOO_MANY)
    return status.otherwise(OK)


def status_title(status: Column, rules: SearchRules) -> Column:
    too_many = TOO_MANY_TITLE.format(limit=rules.max_results)
    return F.when(status == TOO_MANY, too_many).when(status == EMPTY, NO_RESULTS_TITLE)


def status_description(status: Column, rules: SearchRules) -> Column:
    return F.when(status == TOO_MANY, "Error").when(status == EMPTY, rules.empty_description)


def guard_results(found: DataFrame, rules: SearchRules = HTML_SEARCH) -> DataFrame:
    """One row per request: outcome, row count, and the text of its status row if it gets one."""
    status = F.col("status")
    return found.withColumn("status", result_status(rules)).withColumns(
        {
            "status_title": status_title(status, rules),
            "status_description": status_description(status, rules),
        }
    )


def guarded_since(
    guarded: DataFrame, stolen_on: Column, rules: SearchRules = HTML_SEARCH
) -> DataFrame:
    """Only rows posted on the given day or later, undated ones not among them.

    The guard has counted the whole page before; a good request without a row left is empty.
    """
    rows = F.filter("rows", lambda row: row["date_posted_real"] >= stolen_on)
    none_left = (F.col("status") == OK) & (F.size(rows) == 0)
    status = F.when(none_left, EMPTY).otherwise(F.col("status"))
    since = guarded.withColumn("rows", rows).withColumn("status", status)
    return since.withColumns(
        {
            "status_title": status_title(F.col("status"), rules),
            "status_description": status_description(F.col("status"), rules),
        }
    )


def expand_results(guarded: DataFrame) -> DataFrame:
    """Rows of every request whose outcome is good; one row without fields for all others."""
    carried = [name for name in guarded.columns if name != "rows"]
    rows = F.when(F.col("status") == OK, F.col("rows"))
    return _with_date_text(guarded.select(*carried, F.inline_outer(rows)))


def _with_date_text(rows: DataFrame) -> DataFrame:
    if "date_posted_real" not in rows.columns:
        return rows
    return rows.withColumn("date_posted_parsed", posted_text(F.col("date_posted_real")))


def result_rows(
    pages: DataFrame,
    year: int | Column,
    rules: SearchRules = HTML_SEARCH,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of all pages, however many a page has; no shuffle. The guard is the searches' business."""
    summaries = summarise_result_pages(pages, year, replace(rules, max_results=None), keep)
    # The outer form keeps Spark from testing the size of the array first, which would parse the
    # page twice.
    rows = summaries.select("url", *keep, F.inline_outer("rows")).where(F.col("pos").isNotNull())
    return _with_date_text(rows)


def page_links(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every link of a page: ``(url, *keep, pos, link_url, short_title)``."""
    links = pages.select("url", *keep, F.posexplode(all_links(F.col("html"))).alias("pos", "link"))
    return links.select(
        "url",
        *keep,
        "pos",
        attribute_of(F.col("link"), "href").alias("link_url"),
        text_of(F.col("link")).alias("short_title"),
    )


def one_page_of_rows(
    df: DataFrame, group: str, order: Sequence[Column], page: int, page_size: int
) -> DataFrame:
    """Rows ``page * page_size`` and on of every group, at most one page of them, at any page.

    The order should be total. See :func:`fencewatch.operators.keyed.numbered_rows`: no group is
    gathered whole.
    """
    first = page * page_size
    numbered = numbered_rows(df, [group], order, "row_no")
    return numbered.where((F.col("row_no") <= first + page_size) & (F.col("row_no") > first))
