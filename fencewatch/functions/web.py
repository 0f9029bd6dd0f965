"""Column functions for addresses: search requests, query parameters, cities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fencewatch.settings import DEFAULT_CITY, DEFAULT_PAGE, SearchRules


def search_url(city: Column, terms: Column, page: Column, rules: SearchRules) -> Column:
    """Address of a result page; it is the key that finds the landed page. Terms go in as given."""
    return F.concat(
        F.lit("http://"),
        city,
        F.lit(f".en.{rules.site}/search/sss?query="),
        terms,
        F.lit(f"&srchType=A{rules.extra_query}&s="),
        (page * rules.page_size).cast("string"),
    )


def url_param(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; '' when it is absent or badly encoded."""
    pattern = rf"[?&]{re.escape(name)}=([^&#]*)"
    return F.coalesce(F.try_url_decode(F.regexp_extract(url, pattern, 1)), F.lit(""))


def city_of(url: Column) -> Column:
    """First label of the host name; NULL when the address has no host."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#.:]+)"
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def in_city(url: Column, city: str) -> Column:
    """City test made of prefix tests only, so that it reaches the Parquet scan."""
    return url.startswith(f"http://{city}.") | url.startswith(f"https://{city}.")


def or_default(value: Column, default: Column | str) -> Column:
    default_column = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), default_column)


def request_city(url: Column) -> Column:
    return or_default(url_param(url, "cityName"), DEFAULT_CITY)


def request_page(url: Column) -> Column:
    return or_default(url_param(url, "pageNumber"), DEFAULT_PAGE)


def request_date(url: Column, today: Column) -> Column:
    """Theft date of a request; ``today`` when it is not given, NULL when it is not a date."""
    given = url_param(url, "stolenDate")
    compact = F.regexp_extract(given, r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s*$", 0)
    parts = F.split(F.regexp_replace(F.trim(compact), "/", "-"), "-")
    iso = F.concat_ws(
        "-", F.get(parts, 0), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0")
    )
    return F.when(given == "", today).otherwise(iso.try_cast("date"))


def date_shown(day: Column) -> Column:
    """``2013/1/5``: no zero padding, as in the search form."""
    return F.date_format(day, "yyyy/M/d")


def date_argument(day: Column) -> Column:
    """The shown date without its slashes, as it is put in the request path."""
    return F.translate(date_shown(day), "/", "")


def page_number(page: Column) -> Column:
    """Page argument as a number; NULL when it is not one."""
    return page.try_cast("int")


def holds_all_terms(lowered: Column, terms: str) -> Column:
    """Every blank-separated term occurs in a text that is in lower case already."""
    matched = F.lit(True)
    for term in dict.fromkeys(terms.lower().split()):
        matched = matched & F.contains(lowered, F.lit(term))
    return matched


def contains_all_terms(text: Column, terms: str) -> Column:
    """Every blank-separated term occurs in the text, whatever the case."""
    return holds_all_terms(F.lower(text), terms)


def contains_all_terms_of(text: Column, terms: Column) -> Column:
    """:func:`contains_all_terms` with the terms in a column."""
    lowered = F.lower(text)
    return F.forall(F.split(F.lower(F.trim(terms)), r"\s+"), lambda t: F.contains(lowered, t))
