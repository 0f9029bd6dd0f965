"""Column functions behind the table helpers: sort keys, row flag, lookup link, week number."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEEK_MS = 7 * 86_400_000


def date_sort_key(text: Column) -> Column:
    """``dd-mm-yyyy`` turned round to ``yyyymmdd``."""
    return F.concat(
        F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)
    )


def numeric_sort_key(text: Column) -> Column:
    """Number at the start of the text; anything else counts as 0."""
    number = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def text_sort_key(text: Column) -> Column:
    return F.lower(text)


def sort_kind(sample: str) -> str:
    """Kind of a column, told from one of its values: a number outranks a date, else text."""
    if re.match(r"^[\d.]+$", sample.strip()):
        return "numeric"
    if re.search(r"\d\d-+\d\d-+\d\d\d\d", sample):
        return "date"
    return "text"


def row_flag(text: Column, phrase: str, value: Column, threshold: float) -> Column:
    """``warning`` where the text is the phrase and the value is over the threshold, else NULL."""
    return F.when((text == F.lit(phrase)) & (value > F.lit(threshold)), F.lit("warning"))


def lookup_link(value: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def week_number(moment: Column) -> Column:
    """Week of the year that counts from 1 January and starts on Sundays; not the ISO week.

    A part of a day counts as time gone by, so a Saturday after midnight is in the next week.
    """
    instant = moment.cast("timestamp")
    new_year = F.date_trunc("year", instant)
    gone = F.timestamp_diff("MILLISECOND", new_year, instant)
    shifted = gone + F.dayofweek(new_year).cast("bigint") * 86_400_000
    return F.ceil(shifted / F.lit(_WEEK_MS)).cast("int")
